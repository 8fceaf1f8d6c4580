"""Queries on timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.functions.timestamps import iso_utc, url_host
from wherry.operators.zones import estimate_zones, normalise_published
from wherry.sources.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """``record_no, published_utc`` of each readable date of ``page_metadata``."""
    records = table(spark, folder, "page_metadata", "record_no", "url", "published_date", "extracted_at")
    return normalise_published(records, table(spark, folder, "sites")).select("record_no", iso_utc(F.col("published_at")).alias("published_utc"))


def p7_zone_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """The zone that each host's zoneless dates point to, whether or not ``sites`` has it."""
    records = table(spark, folder, "page_metadata", "url", "published_date", "extracted_at")
    rows = records.select(url_host(F.col("url")).alias("host"), F.col("published_date").alias("local_text"), F.col("extracted_at").alias("seen_at"))
    return estimate_zones(rows)


def p7_zone_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """``host, records, agreeing``: of every site, held out as if ``sites`` lacked it, how many zoneless records get the same instant by the estimated zone."""
    records = table(spark, folder, "page_metadata", "record_no", "url", "published_date", "extracted_at")
    sites = table(spark, folder, "sites")
    unknown = sites.select("host", F.lit(None).cast("string").alias("tz"), "date_order")
    guessed = p7_zone_estimates(spark, folder).select("host", F.col("zone").alias("tz"))
    held_out = unknown.drop("tz").join(guessed, "host")
    both = [normalise_published(records, s, fill_zone=False).dropDuplicates(["record_no"]).withColumnRenamed("published_at", name) for s, name in ((sites, "true_at"), (held_out, "found_at"))]
    hosts = records.select("record_no", url_host(F.col("url")).alias("host")).join(sites.select(F.lower("host").alias("host")).distinct(), "host")
    joined = both[0].join(both[1], "record_no").join(hosts, "record_no")
    return joined.groupBy("host").agg(F.count("*").alias("records"), F.count_if(F.col("true_at") == F.col("found_at")).alias("agreeing"))


QUERIES = {"p7_found": p7_found, "p7_zone_estimates": p7_zone_estimates, "p7_zone_accuracy": p7_zone_accuracy}
