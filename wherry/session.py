"""Session helpers: building a session, cutting lineage, adding up small reports."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wherry", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    base = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session for data cut from its lineage: inside the one of ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; on a
    cluster a folder of one machine would be lost with it, so there the lack is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = context.getConf().get("spark.checkpoint.dir")
        if given is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="wherry-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to :func:`shared_folder` and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget_shuffles(spark: SparkSession) -> None:
    """Has Spark's cleaner delete the shuffle files of plans that nothing refers to any more, such as those of a table just written; else they stay until the driver happens to collect its garbage."""
    gc.collect()  # Python's own references first
    spark._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in :func:`shared_folder`: like :func:`checkpoint`, but compressed, and read by column.

    The tables of a session are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written/{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_shuffles(spark)
    if not getattr(spark.sparkContext, "_wherry_written", False):
        spark.sparkContext._wherry_written = True
        atexit.register(_forget, spark, f"{shared_folder(spark)}/written")
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # the session has ended already; the folder's owner clears it
        return


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that Python workers find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_wherry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wherry-")) / "wherry_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    context._wherry_shipped = True
