"""Searches hand on few pairs of query and document, and the right ones."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wherry.operators import retrieval, scoring
from wherry.plans import search_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """60 pages, two queries."""
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([(k, k, f"needle word{k % 7} word{k % 5}", "", None, f"h{k % 9}") for k in range(60)], "record_no long, docid long, title string, abstract string, published_date string, content_hash string").write.parquet(f"{path}/page_metadata.parquet")
    spark.createDataFrame([(k, f"http://a.example/{k}") for k in range(61)], "docid long, url string").write.parquet(f"{path}/doc_map.parquet")
    spark.createDataFrame([(0, "<p>text</p>")], "file_id long, body string").write.parquet(f"{path}/page_files.parquet")
    spark.createDataFrame([(1, "needle word1"), (2, "word2")], "query_id long, text string").write.parquet(f"{path}/queries.parquet")
    return path


SCORED = ["coverage_features", "dedup_content", "search_service", "select_relaxed", "candidates", "rerank", "search_tfidf", "select_strict", "cosine_scores", "dedup_canonical", "rerank_guarded", "rag_search", "dot_products", "second_hop", "rag_prompts"]


@pytest.mark.parametrize("name", SCORED)
def test_pairs_are_not_sorted_or_shuffled_to_be_scored(spark, tables, name):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    assert search_queries.QUERIES[name](spark, tables).count() > 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = "".join(store.executionsList().apply(k).physicalPlanDescription() for k in range(before, store.executionsList().size()))
    assert "MapInArrow" in plans and not re.search(r"Keys \[2\]: \[query_id#\d+L?, docid#\d+L?\]\nFunctions \[\d\]: \[partial_sum", plans)


def brute(vectors, postings, lengths):
    """Scores by plain loops: ``(-score, first_pos, docid, held)`` by query."""
    found = {}
    for q in {v[0] for v in vectors}:
        own = {v[1]: v for v in vectors if v[0] == q}
        norm = math.sqrt(sum(v[4] ** 2 for v in own.values()))
        pairs = {}
        for term, docid, w in postings:
            if term in own:
                pairs.setdefault(docid, []).append((own[term], w))
        found[q] = sorted((-round(sum(v[4] * (1 + math.log10(w)) * v[3] for v, w in hit) / lengths[d] / norm, 9), min(v[2] for v, _ in hit), d, round(sum(v[3] for v, _ in hit if len(v[1]) > 1), 6)) for d, hit in pairs.items() if lengths.get(d))
    return found


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_search_equals_brute_force_and_hands_on_few(spark, monkeypatch, most):
    rng = random.Random(9)
    monkeypatch.setattr(retrieval, "BROADCAST_VECTORS", most)
    words = [f"t{k}" for k in range(30)] + ["x"]
    idf = {w: round(rng.random(), 1) + 0.1 for w in words}
    vectors = [(q, w, k, idf[w], idf[w]) for q in range(40) for k, w in enumerate(rng.sample(words, rng.randint(1, 5)))]
    postings = [(w, d, rng.randint(1, 3)) for d in range(900) for w in rng.sample(words, 4)]
    lengths = {d: rng.choice([0.0, 1.0, 1.0, 2.0]) for d in range(880)}
    frames = (spark.createDataFrame(vectors, "query_id long, term string, first_pos int, idf double, qweight double"), spark.createDataFrame(postings, "term string, docid long, weighted_tf long").repartition(8), spark.createDataFrame(list(lengths.items()), "docid long, length double"))
    want = brute(vectors, postings, lengths)
    key = lambda r: (-r["score"], r["first_pos"], r["docid"], round(r["held"], 6))
    scored = retrieval.cosine(*frames).collect()
    assert {q: sorted(key(r) for r in scored if r["query_id"] == q) for q in want} == want
    for k in (1, 20, 2000):
        rows = retrieval.search(*frames, k).collect()
        assert {q: [key(r) for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank_no"])] for q in want} == {q: x[:k] for q, x in want.items()}
    assert retrieval.search(*frames, 0).count() == 0
    assert retrieval.dot_products(*frames[:2]).count() == len({(v[0], p[1]) for v in vectors for p in postings if v[1] == p[0]})
    none = retrieval.search(frames[0].limit(0), *frames[1:], 5)
    assert none.count() == 0 and none.columns == retrieval.search(*frames, 5).columns


def test_coverage_hands_on_columns(spark):
    candidates = spark.createDataFrame([(1, 7, 0.5)], "query_id long, docid long, held double")
    terms = spark.createDataFrame([(1, "ab", "ab", 1.0)], "query_id long, term string, compact_term string, idf double")
    fields = spark.createDataFrame([(7, "AB", None, "c", 3)], "docid long, title string, published_date string, abstract string, key long")
    assert retrieval.coverage(candidates, terms, fields).select("key", F.col("title_share"), "document_share").first() == (3, 1.0, 0.5)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_each_text_is_searched_once_and_in_parts(spark, tables, monkeypatch):
    asked = spark.createDataFrame([(1, 0, "needle word1"), (1, 1, "word2"), (2, 0, "word2"), (2, 3, "word3 word4"), (3, 0, "unknown"), (None, 0, "word2")], "query_id long, subq int, text string")
    seen, service = [], search_queries.Engine.service

    def spy(self, k):
        seen.append([r["text"] for r in self.queries.collect()])
        return service(self, k)

    monkeypatch.setattr(search_queries.Engine, "service", spy)
    whole = rows_of(search_queries.searched(spark, tables, asked))
    assert len(whole) == 30 and sorted(sum(seen, [])) == ["needle word1", "unknown", "word2", "word2", "word3 word4"]
    monkeypatch.setattr(search_queries, "TEXTS_AT_ONCE", 1)
    monkeypatch.setattr(search_queries, "DOCS_A_TEXT", 100)
    seen.clear()
    assert rows_of(search_queries.searched(spark, tables, asked)) == whole and len(seen) == 5
    assert search_queries.searched(spark, tables, asked.limit(0)).count() == 0


def test_prompts_are_made_in_parts(spark, tables, monkeypatch):
    whole = rows_of(search_queries.QUERIES["rag_prompts"](spark, tables))
    monkeypatch.setattr(search_queries, "RESULTS_AT_ONCE", 2)
    monkeypatch.setattr(search_queries, "DOCS_A_RESULT", 100)
    seen, integrate = [], search_queries.rag.integrate
    monkeypatch.setattr(search_queries.rag, "integrate", lambda *a: seen.append(a[0]) or integrate(*a))
    assert rows_of(search_queries.QUERIES["rag_prompts"](spark, tables)) == whole and len(whole) == 2 and len(seen) > 1


@pytest.mark.parametrize(("name", "score"), [("dot_products", "dot"), ("cosine_scores", "score")])
def test_all_pairs_leave_python_rounded_and_bare(spark, tables, name, score):
    engine = search_queries.Engine(spark, tables)
    whole = retrieval.dot_products(engine.vectors, engine.postings) if score == "dot" else retrieval.cosine(engine.vectors, engine.postings, engine.lengths)
    got = search_queries.QUERIES[name](spark, tables)
    assert rows_of(got) == rows_of(whole.select("query_id", "docid", F.round(score, 6).alias(score))) and got.count() > 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"MapInArrow run\(.*?\)#\d+, \[query_id#\d+L, docid#\d+L, {score}#\d+\]", plan) and "round(" not in plan
    assert search_queries.retrieval.cosine(engine.vectors.limit(0), engine.postings, engine.lengths, 6).count() == 0


def test_rounded_is_the_round_of_sql(spark):
    rng = np.random.default_rng(3)
    ties = np.round((rng.integers(0, 10**6, 20_000) + 0.5) / 10**6, 7)
    x = np.concatenate([ties, -ties[:99], ties + 7, np.nextafter(ties, 9), np.nextafter(ties, -9), np.round(rng.random(20_000), 9), rng.random(20_000) * 100, [0.0, -1e-9, 0.0000005, 1.0]])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert scoring.rounded(x, 6).tolist() == want
