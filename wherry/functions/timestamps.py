"""Normalising date strings of many notations to UTC, as column expressions."""

from __future__ import annotations

from functools import cache, reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that the notations use.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
PREFIXES = ["发布时间", "发布日期", "发布于", "更新时间", "日期", "时间", "published", "updated", "posted", "date"]
#: Offsets of zone abbreviations in seconds, general and as used in single zones.
ABBREVIATIONS = {"utc": 0, "gmt": 0, "z": 0, "bst": 3600, "wet": 0, "west": 3600, "cet": 3600, "cest": 7200, "mez": 3600, "mesz": 7200, "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200, "jst": 32400, "kst": 32400, "hkt": 28800, "sgt": 28800}
LOCAL_ABBREVIATIONS = {
    ("cst", "Asia/Shanghai"): 28800, ("cst", "Asia/Taipei"): 28800, ("cst", "Asia/Macau"): 28800,
    ("cst", "America/Havana"): -18000, ("cdt", "America/Havana"): -14400,
    ("ist", "Asia/Kolkata"): 19800, ("ist", "Europe/Dublin"): 3600, ("ist", "Asia/Jerusalem"): 7200,
    ("bst", "Asia/Dhaka"): 21600,
}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[a-z]+(?:/[a-z_+-]+(?:/[a-z_+-]+)?|))?"
_TAIL = rf"(?:(?:t|\s*)(?:(上午|下午|中午|凌晨|晚上|am|pm)\s*)?{_TIME}\s*(?:(am|pm)(?![a-z]))?\s*{_ZONE})?"
#: Big-endian, little- or middle-endian digits, Chinese units, English months.
YMD = rf"^(\d{{4}})(?:[-/.]|年)(\d{{1,2}})(?:[-/.]|月)(\d{{1,2}})日?{_TAIL}$"
NUM = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TAIL}$"
MDY_WORD = rf"^(?:[a-z]+,\s*)?([a-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?{_TAIL}$"
DMY_WORD = rf"^(?:[a-z]+,\s*)?(\d{{1,2}})\s+([a-z]{{3}})[a-z]*\.?,?\s+(\d{{4}}),?{_TAIL}$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2}))?(?:()(z|[+-]\d{2}:?\d{2}))?$"


def tidy_date(text: Column) -> Column:
    """Narrow forms, no outer white space, no leading label, lower case."""
    narrow = F.translate(F.translate(text, _WIDE, _NARROW), "　 ", "  ")
    trimmed = F.regexp_replace(F.lower(narrow), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(trimmed, r"(?U)^(?:" + "|".join(PREFIXES) + r")\s*:?\s*", "")


@cache
def _zone_names() -> tuple[str, ...]:
    areas = ("Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc")
    return tuple(sorted(z for z in available_timezones() if z.split("/")[0] in areas))


def known_zone(name: Column) -> Column:
    """The tz database name that ``name`` spells in any case, else null."""
    names = F.str_to_map(F.lit(",".join(f"{z.lower()}:{z}" for z in _zone_names())))
    return F.when(F.lower(name).isin("utc", "gmt"), F.lit("UTC")).when(name.contains("/"), F.element_at(names, F.lower(name)))


#: For each pattern the groups of year, month, day, half of day, hour, minute, second, fraction and zone.
_MARK = "\u0001"
_ORDERS = {"ymd": "$1 $2 $3 $4$9 $5 $6 $7 $8 $10", "dmy": "$3 $2 $1 $4$9 $5 $6 $7 $8 $10", "mdy": "$3 $1 $2 $4$9 $5 $6 $7 $8 $10", "compact": "$1 $2 $3  $4 $5 $6  $8"}
_FIELDS = ["y", "mo", "d", "half", "h", "mi", "s", "frac", "zone"]


def _groups(text: Column, pattern: str, order: str) -> Column:
    """All groups of ``pattern`` by one replacement, in the order of ``_FIELDS``."""
    return F.split(F.regexp_replace(text, pattern, _ORDERS[order].replace(" ", _MARK)), _MARK)


def with_published_utc(df: DataFrame, name: str, text: Column, zone: Column, date_order: Column) -> DataFrame:
    """``df`` with the UTC instant that the date string ``text`` names as timestamp column ``name``, null if it names none.

    Epoch seconds and milliseconds, ISO 8601 with any offset, RFC 822, Chinese and
    English notations and all-digit dates in the ``date_order`` (ymd, dmy, mdy) of
    the source are read. Without a zone of its own the time is local in ``zone``;
    a zone abbreviation is read as used there. A local time that occurs twice is
    the earlier instant, one that is skipped moves forward by the gap. Missing
    parts of a time are zero. Null, blank, wordy or impossible input gives null;
    so does a local time whose ``zone`` is null. The steps are separate
    projections, so that each pattern is evaluated once a row.
    """
    t, g = F.col("_wherry_t"), F.col("_wherry_g")
    staged = df.select("*", tidy_date(text).alias("_wherry_t"), zone.alias("_wherry_z"), date_order.alias("_wherry_o"))
    staged = staged.withColumn(
        "_wherry_g",
        F.when(t.rlike(YMD), _groups(t, YMD, "ymd"))
        .when(t.rlike(NUM) & (F.col("_wherry_o") == "mdy"), _groups(t, NUM, "mdy"))
        .when(t.rlike(NUM), _groups(t, NUM, "dmy"))
        .when(t.rlike(MDY_WORD), _groups(t, MDY_WORD, "mdy"))
        .when(t.rlike(DMY_WORD), _groups(t, DMY_WORD, "dmy"))
        .when(t.rlike(COMPACT), _groups(t, COMPACT, "compact")),
    )
    staged = staged.select("*", *(F.get(g, F.lit(k)).alias(f"_wherry_{f}") for k, f in enumerate(_FIELDS)))
    x = {f: F.col(f"_wherry_{f}") for f in _FIELDS}
    number = {f: F.nullif(x[f], F.lit("")).try_cast("int") for f in ("y", "d", "h", "mi", "s")}
    month = F.coalesce(x["mo"].try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), x["mo"]), F.lit(0)).cast("int"))
    pm, am = x["half"].isin("下午", "晚上", "pm"), x["half"].isin("上午", "凌晨", "am")
    hour = F.coalesce(F.when(pm & (number["h"] < 12), number["h"] + 12).when(am & (number["h"] == 12), F.lit(0)).otherwise(number["h"]), F.lit(0))
    clock = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.", number["y"], month, number["d"], hour, F.coalesce(number["mi"], F.lit(0)), F.coalesce(number["s"], F.lit(0)))
    local = F.when(g.isNotNull(), F.try_to_timestamp(F.concat(clock, F.rpad(F.substring(x["frac"], 1, 6), 6, "0")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))
    sign = F.when(x["zone"].startswith("-"), -1).otherwise(1)
    seconds = sign * (F.substring(x["zone"], 2, 2).try_cast("int") * 3600 + F.coalesce(F.when(F.length(x["zone"]) > 3, F.right(x["zone"], F.lit(2)).try_cast("int") * 60), F.lit(0)))
    abbreviated = reduce(lambda c, kv: c.when((x["zone"] == kv[0][0]) & (F.col("_wherry_z") == kv[0][1]), F.lit(kv[1])), LOCAL_ABBREVIATIONS.items(), F.when(F.lit(False), F.lit(0)))
    abbreviated = reduce(lambda c, kv: c.when(x["zone"] == kv[0], F.lit(kv[1])), ABBREVIATIONS.items(), abbreviated)
    fixed = F.when(x["zone"].rlike(r"^[+-]\d{2}"), seconds).when(x["zone"] != "", abbreviated)
    staged = staged.select("*", local.alias("_wherry_local"), fixed.alias("_wherry_fixed"), F.when(x["zone"].contains("/"), known_zone(x["zone"])).alias("_wherry_named"))
    local, fixed = F.col("_wherry_local"), F.col("_wherry_fixed")
    instant = (
        F.when(t.rlike(r"^-?\d{9,10}$"), F.timestamp_seconds(t.try_cast("long")))
        .when(t.rlike(r"^-?\d{12,13}$"), F.timestamp_millis(t.try_cast("long")))
        .when(fixed.isNotNull(), F.timestamp_micros(F.unix_micros(local) - fixed.cast("long") * 1_000_000))
        .when(x["zone"].contains("/"), F.to_utc_timestamp(local, F.col("_wherry_named")))
        .when(x["zone"] == "", F.to_utc_timestamp(local, F.col("_wherry_z")))
    )
    return staged.select(*(F.col(f"`{c}`") for c in df.columns), instant.alias(name))


def iso_utc(instant: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ``."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def url_host(url: Column) -> Column:
    """Lower-case host name of a url without port; tolerant of stray spaces and case. Null for other text."""
    host = F.regexp_extract(F.lower(F.regexp_replace(url, r"(?U)\s+", "")), r"^[^a-z]*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))
