"""Estimating the time zone of a source from its local timestamps and the times of ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.functions.timestamps import known_zone, tidy_date, url_host, with_published_utc

# Offset histories that are tried, in order of preference.
CANDIDATE_ZONES = [
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Moscow", "Asia/Dubai", "Asia/Tehran", "Asia/Karachi", "Asia/Kolkata", "Asia/Kathmandu", "Asia/Dhaka", "Asia/Bangkok", "Asia/Shanghai", "Asia/Tokyo", "Australia/Adelaide", "Australia/Sydney", "Pacific/Auckland",
    "Africa/Lagos", "Africa/Johannesburg", "Atlantic/Azores", "America/Sao_Paulo", "America/St_Johns", "America/Halifax", "America/New_York", "America/Bogota", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Anchorage", "Pacific/Honolulu",
]


def own_offset(text: Column, at: Column) -> Column:
    """Seconds that a date string itself names as its offset, by number or by zone name, at the instant ``at``; null for Z, other abbreviations and none."""
    tidy = tidy_date(text)
    number = F.regexp_extract(tidy, r":\d{2}(?:[.,]\d+)?\s*([+-]\d{2}:?(?:\d{2})?)$", 1)
    sign = F.when(number.startswith("-"), -1).otherwise(1)
    fixed = sign * (F.substring(number, 2, 2).try_cast("int") * 3600 + F.coalesce(F.substring(F.replace(number, F.lit(":"), F.lit("")), 4, 2).try_cast("int"), F.lit(0)) * 60)
    named = known_zone(F.regexp_extract(tidy, r"([a-z]+/[a-z_+-]+(?:/[a-z_+-]+)?)$", 1))
    return F.when(number != "", fixed).when(named.isNotNull(), offset_at(named, at))


def offset_at(zone: Column, at: Column) -> Column:
    """Seconds by which local time in ``zone`` is ahead of UTC at the instant ``at``."""
    return F.unix_seconds(F.from_utc_timestamp(at, zone)) - F.unix_seconds(at)


def estimate_zones(records: DataFrame, candidates: list[str] = CANDIDATE_ZONES) -> DataFrame:
    """For each host the candidate zone that fits its records best.

    ``records`` has ``host``, ``local_text`` (date string) and ``seen_at`` (when it
    was ingested). A record violates a zone if, read in it, it would have been
    published after it was ingested, or if it names an offset of its own that isn't
    the zone's at that instant. Among the zones with fewest violations the one with the
    least mean delay to ingestion wins, then the first of ``candidates``. One partial
    aggregate per host and candidate, so no host is gathered anywhere. Records
    with null or unreadable parts count for nothing; a host without readable
    record is absent.
    """
    rows = records.where(F.col("host").isNotNull() & F.col("seen_at").isNotNull()).select("host", "local_text", "seen_at")
    # Each string is read twice, not once a candidate: what is the same instant in two zones names its own.
    read = with_published_utc(rows, "_utc", F.col("local_text"), F.lit("UTC"), F.lit("ymd"))
    read = with_published_utc(read, "_far", F.col("local_text"), F.lit("Asia/Tokyo"), F.lit("ymd"))
    known = read.select("host", "seen_at", F.explode(F.array_compact(F.array("_utc"))).alias("_utc"), (F.col("_utc") == F.col("_far")).alias("_fixed"), own_offset(F.col("local_text"), F.col("_utc")).alias("_own"))
    tried = known.select("*", F.posexplode(F.array(*map(F.lit, candidates))).alias("preference", "zone"))
    at = F.when(F.col("_fixed"), F.col("_utc")).otherwise(F.to_utc_timestamp("_utc", F.col("zone")))
    per = tried.select("host", "zone", "preference", (F.unix_micros("seen_at") - F.unix_micros(at)).alias("delay"), (F.col("_own") != offset_at(F.col("zone"), at)).alias("other"))
    fits = per.groupBy("host", "zone", "preference").agg(F.count_if((F.col("delay") < 0) | F.coalesce("other", F.lit(False))).alias("violations"), F.avg("delay").alias("mean_delay"), F.count("delay").alias("n_records")).where("n_records > 0")
    order = F.struct(F.col("violations"), F.round(F.col("mean_delay") / 3.6e9, 3), F.col("preference"))
    return fits.groupBy("host").agg(F.min_by("zone", order).alias("zone"), F.min("violations").alias("violations"), F.max("n_records").alias("n_records"))


def normalise_published(records: DataFrame, sites: DataFrame, fill_zone: bool = True) -> DataFrame:
    """``record_no`` and ``published_at`` (UTC instant) of each record whose date string can be read.

    ``records``: ``record_no, url, published_date, extracted_at``; ``sites``: ``host,
    tz, date_order`` (one row per site; broadcast by Spark only below its own size
    threshold). Sites that ``sites`` lacks get the zone :func:`estimate_zones`
    finds in their own records, else UTC. Extra columns are ignored; null, blank, wordy and
    impossible dates give no row; repeated rows stay repeated; empty tables give
    an empty result.
    """
    host = url_host(F.col("url"))
    rows = records.select("record_no", "published_date", "extracted_at", host.alias("_host")).where(F.col("published_date").isNotNull())
    known = sites.where(F.col("host").isNotNull()).select(F.lower("host").alias("_host"), known_zone(F.col("tz")).alias("tz"), "date_order").dropDuplicates(["_host"])
    placed = rows.join(known, "_host", "left")
    if fill_zone:
        lost = rows.join(known.select("_host"), "_host", "left_anti").select(F.col("_host").alias("host"), F.col("published_date").alias("local_text"), F.col("extracted_at").alias("seen_at"))
        guess = estimate_zones(lost).select(F.col("host").alias("_host"), F.col("zone").alias("_zone"))
        # A few bytes for each unknown host, however many records it has: met by broadcast up to Spark's own threshold, else split by adaptive execution.
        placed = placed.join(guess, "_host", "left").withColumn("tz", F.coalesce("tz", "_zone"))
    dated = with_published_utc(placed, "published_at", F.col("published_date"), F.coalesce("tz", F.lit("UTC")), F.coalesce("date_order", F.lit("ymd")))
    # explode drops the nulls; a filter would be pushed below the staged projections and undo them.
    return dated.select("record_no", F.explode(F.array_compact(F.array("published_at"))).alias("published_at"))
