"""Measures of rankings and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """One row: ``mrr, hit_1, hit_3, hit_5, hit_10, hit_20, recall, precision, map_score, ndcg`` at ``k``, averaged over ``queries``.

    ``results(query_id, docid, rank_no)``, ``relevant(query_id, docid)``. A query
    without result or relevant document counts 0.
    """
    pairs = relevant.select("query_id", "docid").distinct()
    hits = results.where(F.col("rank_no") <= k).join(pairs, ["query_id", "docid"]).groupBy("query_id").agg(F.array_sort(F.collect_set("rank_no")).alias("r"))
    wanted = pairs.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = queries.select("query_id").join(hits, "query_id", "left").join(wanted, "query_id", "left").select("query_id", F.coalesce("r", F.array().cast("array<int>")).alias("r"), F.coalesce("n", F.lit(0)).alias("n"))
    gain = F.aggregate("r", F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k)))), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))
    precisions = F.aggregate(F.transform("r", lambda x, i: (i + 1) / x), F.lit(0.0), lambda a, x: a + x)
    some = F.size("r") > 0
    each = rows.select(
        F.when(some, 1 / F.get("r", F.lit(0))).otherwise(0.0).alias("mrr"), *(F.when(some & (F.get("r", F.lit(0)) <= j), 1.0).otherwise(0.0).alias(f"hit_{j}") for j in (1, 3, 5, 10, 20)),
        F.coalesce(F.size("r") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("recall"), (F.size("r") / k).alias("precision"), F.coalesce(precisions / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("map_score"), F.when(F.col("n") > 0, gain / ideal).otherwise(0.0).alias("ndcg"),
    )
    return each.agg(*(F.round(F.avg(c), 6).alias(c) for c in each.columns))


def latency(runs: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, mean, p50, p95, longest`` of ``value``; percentiles are exact and interpolated.

    Values are ranked within their group over range partitions, so neither a group
    nor its distinct values are held by one task; of each group the rows next to a
    percentile are kept. Null values count for nothing; a group without others has nulls.
    """
    from wherry.operators.frontier import place_in_group

    sizes = runs.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("longest"))
    placed = place_in_group(runs.where(F.col(value).isNotNull()).select(F.col(group).alias("_group"), F.col(value).cast("double").alias("_v")), "_group", ["_v"], "_place")
    joined = placed.join(sizes.select(F.col(group).alias("_g"), "n"), F.col("_group").eqNullSafe(F.col("_g")))

    def near(share: float) -> list[Column]:
        at = (F.col("n") - 1) * F.lit(share)
        return [F.max(F.when(F.col("_place") - 1 == f(at), F.col("_v"))) for f in (F.floor, F.ceil)]

    def between(name: str, share: float) -> Column:
        at = (F.col("n") - 1) * F.lit(share)
        return F.round(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at - F.floor(at)), 6).alias(name)

    parts = {"p50": 0.5, "p95": 0.95}
    found = joined.groupBy("_group").agg(*(c.alias(f"{name}_{end}") for name, share in parts.items() for end, c in zip(("low", "high"), near(share), strict=True)))
    return sizes.join(found, F.col(group).eqNullSafe(F.col("_group")), "left").select(group, "n", "mean", *(between(name, share) for name, share in parts.items()), "longest")
