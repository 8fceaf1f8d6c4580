"""Line-wise JSON records and page files, as a crawler leaves them."""

from __future__ import annotations

import hashlib
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.functions import urls

DOC_MAP = "docID long, url string, file string"
URL_INDEX = "url string, file string"
PAGE_METADATA = "docID long, url string, title string, abstract string, published_date string, content_hash string"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a declared schema; malformed lines and those without url are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col("url").isNotNull()).drop("_corrupt_record")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``: the folded, non-empty lines of a word list."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


_CHARSET = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]{1,40})""", re.I)


def decode_page(page: bytes) -> str:
    """Text of a page's bytes: by byte-order mark, UTF-8, the charset a meta element names in the first 1,024 bytes, else GB 18030; bad bytes are replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if page.startswith(mark):
            return page[len(mark) :].decode(name, "replace")
    named = _CHARSET.search(page[:1024])
    for name in ("utf-8", named[1].decode() if named else "gb18030"):
        try:
            return page.decode({"gb2312": "gb18030", "gbk": "gb18030"}.get(name.lower(), name))
        except (UnicodeDecodeError, LookupError):
            continue
    return page.decode("gb18030", "replace")


def decoded(content: Column) -> Column:
    """:func:`decode_page` of a binary column; bytes that are UTF-8 (without mark) never leave the JVM's reach as such."""

    @F.pandas_udf("string")
    def other(pages: pd.Series) -> pd.Series:
        return pages.map(lambda b: None if b is None else decode_page(bytes(b)))

    return other(content)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``path, html`` of all page files; bytes that are no UTF-8 are read by :func:`decode_page`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(folder)
    plain = F.col("content").cast("string")
    valid = files.select("path", "content", (F.is_valid_utf8(plain) & (F.hex(F.substring("content", 1, 3)) != "EFBBBF")).alias("ok"))
    good = valid.where("ok").select("path", plain.alias("html"))
    return good.unionByName(valid.where("not ok").select("path", decoded(F.col("content")).alias("html")))


def page_path(url) -> F.Column:
    """Where a page is kept: host and hash of the url."""
    return F.concat(urls.host(url), F.lit("/"), F.sha2(url, 256), F.lit(".html"))


def write_records(rows: DataFrame, path: str) -> None:
    """One JSON record a line; Spark's commit makes the folder complete or absent."""
    rows.write.mode("overwrite").json(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet, each in its own folder of ``path``."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def write_bucketed(rows: DataFrame, path: str, name: str, buckets: int, order: list[str]) -> None:
    """``rows`` as Parquet at ``path/name`` in ``buckets`` by docid, sorted by ``order`` in each; one file a bucket if they come so partitioned."""
    spark, table = rows.sparkSession, f"wherry_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, "docid").sortBy(*order).option("path", f"{path}/{name}").saveAsTable(table)
    spark.sql(f"drop table {table}")  # the catalog's entry; the files stay


def read_bucketed(spark: SparkSession, path: str, name: str, buckets: int, order: list[str]) -> DataFrame:
    """The table of :func:`write_bucketed`, so that Spark knows its buckets."""
    table = f"wherry_{hashlib.sha256(f'{path}/{name}/{buckets}'.encode()).hexdigest()[:32]}"
    if not spark.catalog.tableExists(table):
        schema = spark.read.parquet(f"{path}/{name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"create table {table} ({columns}) using parquet clustered by (docid) sorted by ({', '.join(order)}) into {buckets} buckets location '{path}/{name}'")
    spark.catalog.refreshTable(table)  # the files may have been made anew
    return spark.table(table)


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file or folder in one step to a name that nothing has."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    if not a.getFileSystem(spark._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"can't move {old} to {new}")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the names, sizes and times of all files under ``paths``: changes when any of them does."""
    seen = hashlib.sha256()
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = there.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(there, True)
        rows = []
        while files.hasNext():
            f = files.next()
            rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        seen.update(repr(sorted(rows)).encode())
    return seen.hexdigest()[:24]


def load_or_build(spark: SparkSession, path: str, names: list[str], build, load, remake: bool = False) -> dict[str, DataFrame]:
    """The index tables of ``path``, as ``load(path)`` reads them; first written by ``build(folder)`` if one of ``names`` is missing or ``remake`` is set.

    A new index is written beside and moved into place, so readers see a whole one or none.
    """
    if remake or not all(exists(spark, f"{path}/{n}/_SUCCESS") for n in names):
        beside = f"{path}.{uuid.uuid4().hex}"
        build(beside)
        delete(spark, path)
        rename(spark, beside, path)
    return load(path)
