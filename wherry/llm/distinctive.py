"""How characteristic a term is of a record among all records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherry.operators.skew import hot_threshold, join_by_frequency
from wherry.session import written

# Coefficients of the Lanczos approximation with g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x >= 1, vectorised (relative error below 1e-13)."""
    z = np.asarray(x, np.float64) - 1
    total = np.full_like(z, _LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total += c / (z + k)
    t = z + 7.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(total)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def log_upper_tail(k: np.ndarray, n: np.ndarray, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log P(X >= k) for X hypergeometric: ``n`` drawn of ``total``, of which ``hits`` count. Exact sum of all terms."""
    k, n, hits, total = (np.asarray(x, np.float64) for x in (k, n, hits, total))
    first, last = np.maximum(k, np.maximum(0, n + hits - total)), np.minimum(n, hits)
    possible = first <= last
    log_p = np.where(possible, log_choose(hits, np.minimum(first, hits)) + log_choose(np.maximum(total - hits, 0), np.clip(n - first, 0, np.maximum(total - hits, 0))) - log_choose(total, n), -np.inf)
    summed, term, i = np.ones_like(k), np.ones_like(k), first.copy()
    live = possible & (i < last)
    while live.any():
        j = i[live]
        term[live] *= (hits[live] - j) * (n[live] - j) / ((j + 1) * (total[live] - hits[live] - n[live] + j + 1))
        summed[live] += term[live]
        i[live] += 1
        live &= (i < last) & (term > summed * 1e-17)
    return np.minimum(0.0, np.where(k <= np.maximum(0, n + hits - total), 0.0, log_p + np.log(summed)))


def term_scores(postings: DataFrame, enrichment: bool = True, hot_rows: int | None = None) -> DataFrame:
    """``docid, term, tf, weighted_tf, df, score`` and, with ``enrichment``, ``log_p``.

    ``score`` is (1 + log10 weighted_tf) * log10(N / df), rounded to 6 digits, with df
    and N counted in ``postings`` itself. ``log_p`` is the natural logarithm of the
    hypergeometric probability that a record of as many tokens holds the term so
    often by chance. Repeated rows count once; of differing rows of one record and
    term the greatest values hold; a missing weighted_tf is the tf. Rows with null
    docid or term are left out; a tf below 1 (or null without weighted_tf) has score
    null. The distinct rows are written once, as counts, totals and scores all read
    them: one shuffle by record, one small one by term (partial counts), and a join
    in which frequent terms are broadcast and the rest is shuffled.
    """
    rows = postings.where(F.col("docid").isNotNull() & F.col("term").isNotNull()).select("docid", "term", "tf", F.coalesce("weighted_tf", "tf").alias("weighted_tf"))
    unique = written(rows.repartition("docid").groupBy("docid", "term").agg(F.max("tf").alias("tf"), F.max("weighted_tf").alias("weighted_tf")))
    by_doc = Window.partitionBy("docid")
    sized = unique.withColumn("n_tokens", F.sum("tf").over(by_doc))
    terms = unique.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    totals = unique.agg(F.count_distinct("docid").alias("n_docs"), F.sum("tf").alias("all_tokens"), F.count("*").alias("n_rows")).first()
    n_docs, all_tokens, n_rows = totals["n_docs"], totals["all_tokens"] or 0, totals["n_rows"]
    joined = join_by_frequency(sized, terms, "term", F.col("df"), hot_rows or hot_threshold(n_rows))
    score = F.when(F.col("weighted_tf") > 0, F.round((1 + F.log10("weighted_tf")) * F.log10(F.lit(float(n_docs)) / F.col("df")), 6))
    scored = joined.withColumn("score", score)
    if enrichment:

        @F.pandas_udf("double")
        def tail(k: pd.Series, n: pd.Series, hits: pd.Series) -> pd.Series:
            return pd.Series(log_upper_tail(k.fillna(0).to_numpy(), n.fillna(0).to_numpy(), hits.fillna(0).to_numpy(), np.full(len(k), float(all_tokens))))

        scored = scored.withColumn("log_p", tail("tf", "n_tokens", "cf"))
    return scored.drop("n_tokens", "cf")


def top_terms(scores: DataFrame, k: int = 3) -> DataFrame:
    """The up to ``k`` highest positive scores of each record, ties to the smaller term in code-point order."""
    order = Window.partitionBy("docid").orderBy(F.desc("score"), F.asc("term"))
    return scores.where(F.col("score") > 0).withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k)


def enriched_terms(scores: DataFrame, fdr: float = 0.05) -> DataFrame:
    """``scores`` with ``q``, the Benjamini-Hochberg adjusted probability among the record's terms, and ``enrichment`` = -log10 q; those with q <= ``fdr``."""
    by_doc = Window.partitionBy("docid")
    ranked = scores.withColumn("_r", F.row_number().over(by_doc.orderBy(F.asc("log_p"), F.asc("term")))).withColumn("_m", F.count("*").over(by_doc))
    raw = F.exp("log_p") * F.col("_m") / F.col("_r")
    later = by_doc.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = ranked.withColumn("q", F.least(F.lit(1.0), F.min(raw).over(later)))
    return adjusted.withColumn("enrichment", F.round(-F.log10(F.greatest("q", F.lit(1e-300))), 6)).where(F.col("q") <= fdr).drop("_r", "_m")
