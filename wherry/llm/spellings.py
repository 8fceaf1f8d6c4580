"""Records that differ only in formatting, collapsed into one with a count of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.functions.text import WHITE
from wherry.operators.skew import hot_threshold

#: Punctuation and brackets that may surround a whole url; characters a url can end with are left out.
_AROUND = r"""[\p{Ps}\p{Pe}\p{Pi}\p{Pf}"'`´.,;:!<>|…，。、；：！？·^]+"""
_SEP = "\u0001"


def _decoded(text: Column) -> Column:
    """``text`` percent-decoded as UTF-8; left alone where that isn't valid."""
    guarded = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    plain = F.try_url_decode(guarded)
    return F.when(~text.contains("%"), text).when(plain.contains("�"), text).otherwise(F.coalesce(plain, text))


def with_url_key(df: DataFrame, url: str, name: str = "url_key") -> DataFrame:
    """``df`` with the key under which respelled urls agree.

    Not counted are letter case, white space anywhere, punctuation or brackets
    around the url, percent-encoding, default port, repeated and trailing slashes
    and a final ``/index.html`` of the path, order of parameters, empty
    parameters, a bare ``?`` and the fragment. Null stays null. Text that is no
    url gets a key by the same rules.
    """
    bare = F.regexp_replace(F.translate(F.col(url), WHITE, ""), rf"^{_AROUND}|{_AROUND}$", "")
    staged = df.select("*", F.substring_index(bare, "#", 1).alias("_u"))
    query = F.when(F.col("_u").contains("?"), F.expr("substr(_u, instr(_u, '?') + 1)")).otherwise("")
    staged = staged.select("*", F.translate(F.lower(_decoded(F.substring_index("_u", "?", 1))), WHITE, "").alias("_l"), F.filter(F.split(query, "&"), lambda x: x != "").alias("_a"))
    has_scheme = F.col("_l").contains("://")
    staged = staged.select("*", F.when(has_scheme, F.substring_index("_l", "://", 1)).otherwise("").alias("_s"), F.when(has_scheme, F.expr("substr(_l, instr(_l, '://') + 3)")).otherwise(F.col("_l")).alias("_r"))
    staged = staged.select("*", F.substring_index("_r", "/", 1).alias("_h"), F.when(F.col("_r").contains("/"), F.expr("substr(_r, instr(_r, '/'))")).otherwise("").alias("_d"))
    port = F.when(F.col("_s") == "http", ":80").when(F.col("_s") == "https", ":443").otherwise(":")
    host = F.when(F.col("_h").endswith(port), F.substring("_h", F.lit(1), F.length("_h") - F.length(port))).otherwise(F.col("_h"))
    slashes = F.regexp_replace("_d", "/{2,}", "/")
    directory = F.regexp_replace(F.regexp_replace(slashes, "/$", ""), r"(?:/index\.html)?/?$", "")
    path = F.concat("_s", F.when(F.col("_s") != "", "://").otherwise(""), host, directory)
    pairs = F.array_sort(F.transform("_a", lambda x: F.translate(F.lower(_decoded(x)), WHITE, "")))
    key = F.when(F.size("_a") > 0, F.concat(path, F.lit("?"), F.array_join(pairs, _SEP))).otherwise(path)
    return staged.select(*(F.col(f"`{c}`") for c in df.columns), key.alias(name))


def collapse(keyed: DataFrame, key: str, ident: str, hot_rows: int | None = None, salts: int = 64) -> DataFrame:
    """Each row's group: ``key, ident, keep_id`` (least ``ident`` of its key) and ``copies`` (rows of its key).

    First, partial counts of key hashes find the hot keys exactly: those with
    ``hot_rows`` rows or more, by default such that there can be at most 1000 of
    them, so that their hashes may be collected. Hot keys are salted into ``salts`` parts, aggregated in two levels and
    met with their rows by broadcast of those few groups. All other rows are
    shuffled once by key; no task gets more than ``hot_rows`` rows of one key. A
    null key makes no group; its rows are left out. Ties of ``ident`` (repeated
    rows) stay rows of their own and count as copies.
    """
    # explode drops null keys; a filter would be pushed into the projections that make the key.
    rows = keyed.select(F.explode(F.array_compact(F.array(key))).alias(key), F.col(ident)).withColumn("_h", F.xxhash64(key))
    if hot_rows is None:
        hot_rows = hot_threshold(keyed.count())
    hot_keys = rows.groupBy("_h").count().where(F.col("count") >= hot_rows).select("_h").collect()
    by_key = Window.partitionBy("_h", key)
    grouped = [F.min(ident).over(by_key).alias("keep_id"), F.count(F.lit(1)).over(by_key).alias("copies")]
    if not hot_keys:
        return rows.select(key, ident, *grouped)
    hot = F.broadcast(keyed.sparkSession.createDataFrame(hot_keys, rows.select("_h").schema))
    cold = rows.join(hot, "_h", "left_anti").select(key, ident, *grouped)
    salted = rows.join(hot, "_h", "left_semi").withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(salts)))
    level1 = salted.groupBy(key, "_salt").agg(F.min(ident).alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    level2 = level1.groupBy(key).agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    warm = salted.select(key, ident).join(F.broadcast(level2), key).select(key, ident, "keep_id", "copies")
    return cold.unionByName(warm)


def representatives(groups: DataFrame, key: str) -> DataFrame:
    """One row per group of :func:`collapse`: ``key, keep_id, copies``."""
    ident = next(c for c in groups.columns if c not in (key, "keep_id", "copies"))
    return groups.where(F.col(ident) == F.col("keep_id")).select(key, "keep_id", "copies").dropDuplicates([key])
