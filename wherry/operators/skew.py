"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many keys are treated as hot; each holds at least 1/MAX_HOT of the rows.
MAX_HOT = 1000
#: Groups below this size are never hot, whatever the total.
LEAST_HOT = 5_000


def hot_threshold(total: int, max_hot: int = MAX_HOT, least: int = LEAST_HOT) -> int:
    """Rows from which on a key counts as hot. At most ``max_hot`` keys reach it."""
    return max(least, -(-total // max_hot))


def join_by_frequency(rows: DataFrame, dictionary: DataFrame, key: str, frequency: Column, threshold: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``dictionary`` (one row per ``key``) without a skewed shuffle.

    Entries whose ``frequency`` (number of matching rows) reaches ``threshold`` are
    broadcast: with ``threshold`` from :func:`hot_threshold` there are at most
    ``MAX_HOT`` of them. All other entries meet their rows in one shuffle in which
    no key has more than ``threshold`` rows. Null keys match nothing.
    """
    hot = F.broadcast(dictionary.where(frequency >= threshold))
    cold = dictionary.where(frequency < threshold)
    marked = rows.join(hot.select(key).withColumn("_hot", F.lit(True)), key, "left")
    first = rows.join(hot, key, "inner")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(cold.hint("merge"), key, how)
    return first.unionByName(rest)
