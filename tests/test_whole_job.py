"""Queries that must see all rows, on small tables."""

import pytest
from pyspark.sql import functions as F

from wherry.operators import rag
from wherry.plans import crawl_queries, search_queries


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """120 short pages of one content, ten longer ones of their own behind them, 500 more of the first term, and ten without it."""
    path = str(tmp_path_factory.mktemp("copies"))
    title = lambda k: "needle" if k < 120 else f"needle other{k}" if k < 130 else f"needle many words that push it back {k}" if k < 630 else "hay"
    spark.createDataFrame([(k, k, title(k), "", None, "same" if k < 120 else f"h{k}") for k in range(640)], "record_no long, docid long, title string, abstract string, published_date string, content_hash string").write.parquet(f"{path}/page_metadata.parquet")
    spark.createDataFrame([(k, f"http://a.example/{k}") for k in range(640)], "docid long, url string").write.parquet(f"{path}/doc_map.parquet")
    spark.createDataFrame([], "file_id long, body string").write.parquet(f"{path}/page_files.parquet")
    spark.createDataFrame([(1, "needle")], "query_id long, text string").write.parquet(f"{path}/queries.parquet")
    return path


def test_candidates_reach_behind_the_copies(spark, copies):
    assert search_queries.QUERIES["candidates"](spark, copies).count() == 500
    place = {r["docid"]: r["stage"] for r in search_queries.QUERIES["search_service"](spark, copies).collect()}
    assert len(place) == 20 and all(place[k] == 1 for k in range(120, 130)) and set(place.values()) == {1}


def test_link_levels_start_from_every_query_and_go_on(spark, tmp_path):
    rows = [(10, k + 1, f"a{k}") for k in range(14)] + [(7, 1, "b0"), (7, 2, "a5"), (7, 3, "b2")]
    spark.createDataFrame(rows, "query_id long, rank_no int, url string").write.parquet(f"{tmp_path}/search_results.parquet")
    got = {r["url"]: r["level"] for r in crawl_queries.link_levels(spark, str(tmp_path)).collect()}
    assert got == {f"a{k}": k if k < 5 else k - 4 for k in range(14)} | {"b0": 0, "b2": 2}


def test_merges_take_all_results(spark, tmp_path):
    rows = [(1, k, f"u{k}", f"T{k}", f"snippet {k} " + "x" * 400, f"content {k}。") for k in range(1, 21)]
    spark.createDataFrame(rows, "query_id long, rank_no int, url string, title string, snippet string, content string").write.parquet(f"{tmp_path}/search_results.parquet")
    spark.createDataFrame([(1, "why")], "query_id long, text string").write.parquet(f"{tmp_path}/queries.parquet")
    for name, column, last in (("snippet_merge", "context", "内容：snippet 20 "), ("full_merge", "context", "content 20。")):
        assert last in search_queries.QUERIES[name](spark, str(tmp_path)).first()[column]


def test_chunks_fill_the_budget_of_a_page(spark):
    long = "".join(f"{k:05d}" for k in range(3000))
    rows = [(1, 1, "a", "A", long[:3210] + "q" + long[3211:], None), (2, 12, "late", "L", "z" * 900, None)] + [(2, k, f"u{k}", "U", None if k == 1 else long, "only a snippet") for k in range(1, 11)]
    results = spark.createDataFrame(rows, "query_id long, rank_no int, docid string, title string, content string, snippet string").withColumn("url", F.col("docid"))
    terms = spark.createDataFrame([(1, "q")], "query_id long, term string")
    got = rag.best_chunks(results, terms).collect()
    text = {d: sum(len(r["chunk"]) for r in got if r["docid"] == d) for d in ("a", "u1", "u2", "late")}
    assert text == {"a": 11820, "u1": 14, "u2": 1020, "late": 0}
    lone = sorted((r["place"], r["chunk_no"], r["score"]) for r in got if r["docid"] == "a")
    assert len(lone) == 19 and lone[0] == (1, 6, 2) and [c for _, c, _ in lone[1:]] == [k for k in range(19) if k != 6]
    contexts = {r["query_id"]: r["context"] for r in rag.integrate("custom", results, terms).collect()}
    assert "only a snippet" in contexts[2] and len(contexts[1]) > 9000
