import math
import random

import pytest
from pyspark.sql import functions as F

from wherry.operators import frontier, index, metrics, rag, retrieval
from wherry.operators.skew import join_by_frequency
from wherry.plans import crawl_queries


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame([(0, "cat", ["dog"], "cat fish"), (1, "dog", [], "cat"), (2, None, [], None)], "docid long, title string, headings array<string>, body string")
    post = index.postings(docs)
    terms = index.term_statistics(post, 3)
    weighted = index.weigh(post, terms, 10)
    return docs, post, terms, weighted, index.norms(docs, weighted)


def test_index_by_hand(engine):
    docs, post, terms, weighted, lengths = engine
    assert {(r["docid"], r["term"]): (r["tf"], r["weighted_tf"]) for r in post.collect()} == {(0, "cat"): (2, 4), (0, "dog"): (1, 2), (0, "fish"): (1, 1), (1, "dog"): (1, 3), (1, "cat"): (1, 1)}
    idf = {r["term"]: r["idf"] for r in terms.collect()}
    assert idf["fish"] == pytest.approx(math.log10(3)) and idf["cat"] == pytest.approx(math.log10(1.5))
    by = {r["docid"]: r["length"] for r in lengths.collect()}
    want = math.sqrt(((1 + math.log10(4)) * idf["cat"]) ** 2 + ((1 + math.log10(2)) * idf["dog"]) ** 2 + idf["fish"] ** 2)
    assert by[0] == pytest.approx(want) and by[2] == 0.0
    assert all(r["n"] == 0 for r in index.violations(docs, post).collect())


def test_search_and_ties(spark, engine):
    docs, post, terms, weighted, lengths = engine
    queries = spark.createDataFrame([(1, "fish"), (2, "dog cat unknown"), (3, ""), (4, None)], "query_id long, text string")
    vectors = retrieval.query_vectors(queries, terms)
    got = retrieval.search(vectors, weighted, lengths, 5).collect()
    assert {r["query_id"] for r in got} == {1, 2} and all(0 <= r["score"] <= 1 + 1e-9 for r in got)
    assert [(r["docid"], r["rank_no"]) for r in got if r["query_id"] == 1] == [(0, 1)]
    assert {r["docid"] for r in retrieval.boolean(post, ["dog", "fish"], "and").collect()} == {0}
    assert {r["docid"] for r in retrieval.boolean(post, ["fish", "none"], "or").collect()} == {0}


def model_guard(order, new):
    out = list(new)
    for r in (3, 2, 1):
        if r <= len(order):
            d = order[r - 1]
            if out.index(d) > r + 1:
                out.remove(d)
                out.insert(r + 1, d)
    return out


def test_guard_matches_model(spark):
    rng, rows, want = random.Random(3), [], {}
    for q in range(40):
        old = list(range(rng.randint(1, 12)))
        new = rng.sample(old, len(old))
        want[q] = model_guard(old, new)
        rows += [(q, d, old.index(d) + 1, new.index(d) + 1) for d in old]
    got = retrieval.guard_top(spark.createDataFrame(rows, "query_id long, docid long, rank_no int, new_rank int")).collect()
    for q, order in want.items():
        assert [r["docid"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["final_rank"])] == order


RULES = [retrieval.FamilyRule("h", "/p", "fam", 2), retrieval.FamilyRule("h", "/c", "one", 1)]


def model_service(candidates, n_docs, k):
    """The selection by plain loops: strict, relaxed, any candidate, documents."""
    accepted, stages = [], []
    caps = {r.name: r.most for r in RULES}

    def take(c, bounded, stage):
        d, key, h, fam = c
        if any(d == x[0] or key == x[1] or (h is not None and h == x[2]) for x in accepted):
            return
        if bounded and fam in caps and sum(x[3] == fam for x in accepted) >= caps[fam]:
            return
        accepted.append(c)
        stages.append(stage)

    for bounded, stage in ((True, 1), (False, 2)):
        for c in candidates:
            if len(accepted) < k:
                take(c, bounded, stage)
    chosen = [c[0] for c in accepted]
    for d, stage in [(c[0], 3) for c in candidates] + [(d, 4) for d in range(n_docs)]:
        if len(chosen) < k and d not in chosen:
            chosen.append(d)
            stages.append(stage)
    return list(zip(chosen, stages, strict=True))


def test_service_matches_model(spark):
    rng, rows, want, k, n_docs = random.Random(4), [], {}, 5, 40
    for q in range(80):
        docs = rng.sample(range(n_docs), rng.randint(0, 14))
        listed = [(d, f"k{rng.randint(0, 9)}", rng.choice([None, "h1", "h2", "h3"]), rng.choice([None, None, "fam", "one"])) for d in docs]
        rows += [(q, r, d, r, f"u{d}", key, h, fam) for r, (d, key, h, fam) in enumerate(listed, 1)]
        want[q] = model_service(listed, n_docs, k)
    ranked = spark.createDataFrame(rows, "query_id long, new_rank int, docid long, rank_no int, url string, key string, hash string, family string")
    queries = spark.createDataFrame([(q,) for q in range(80)], "query_id long")
    all_docs = spark.createDataFrame([(d, f"u{d}") for d in range(n_docs)], "docid long, url string")
    lists = retrieval.ranked_lists(ranked, "url", "key", "hash", "family")
    got = retrieval.service(lists, queries, all_docs, k, RULES).collect()
    for q, listed in want.items():
        assert [(r["docid"], r["stage"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["place"])] == listed
        assert all(r["url"] == f"u{r['docid']}" for r in got)
    assert retrieval.service(lists, queries, all_docs, 0, RULES).count() == 0
    assert retrieval.service(lists, queries, all_docs.limit(0), k, RULES).count() <= 80 * k


def test_family(spark):
    url = lambda u: spark.range(1).select(retrieval.family(F.lit(u), RULES)).first()[0]
    assert url("http://H/a/p?x=1") == "fam" and url("http://h/c") == "one" and url("http://i/p") is None and url("none") is None


def test_stopwords_and_tokenizer_are_given(spark):
    docs = spark.createDataFrame([(0, "the cat", [], "a dog")], "docid long, title string, headings array<string>, body string")
    words = spark.createDataFrame([("cat",)], "word string")
    assert {r["term"] for r in index.postings(docs, stopwords=words).collect()} == {"the", "a", "dog"}
    assert {r["term"] for r in index.postings(docs, tokenizer=lambda c: F.split(F.coalesce(c, F.lit("")), " "), stopwords=["the"]).collect()} == {"cat", "a", "dog", ""}


def test_dense_ids(spark):
    rows = spark.createDataFrame([(f"u{k}", k * 3 % 101) for k in range(101)], "url string, o long")
    got = {r["url"]: r["id"] for r in index.dense_ids(rows, ["o"], "id").collect()}
    assert got == {f"u{k}": k * 3 % 101 for k in range(101)}


def test_join_by_frequency_keeps_all(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"c{k}") for k in range(300)] + [(999, None)], "id long, key string")
    dictionary = rows.where("key is not null").groupBy("key").count()
    for threshold in (1, 50, 10_000):
        got = join_by_frequency(rows, dictionary, "key", F.col("count"), threshold)
        assert got.count() == 300 and got.where("key = 'hot' and count = 200").count() == 200


def test_merges(spark):
    rows = spark.createDataFrame([(1, 1, "u1", "T", " s  one ", "甲。乙。甲。"), (1, 2, "u2", "U", "s one", "丙。"), (1, 3, "u3", None, None, None), (1, 4, "u1", "V", "s two", "丁。"), (1, 5, "u5", "W", "", "丙 。"), (2, 1, "x", None, "only", None)], "query_id long, rank_no int, url string, title string, snippet string, content string")
    got = {r["query_id"]: r["context"] for r in rag.snippet_merge(rows).collect()}
    assert got[1] == "[文档1]\n标题：T\nURL：u1\n内容：s one\n\n[文档2]\n标题：W\nURL：u5\n内容：丙 。"
    got = {r["query_id"]: r["context"] for r in rag.full_merge(rows).collect()}
    assert got[1] == "[资料1]\n标题：T\nURL：u1\n正文：甲。\n乙。\n\n[资料2]\n标题：U\nURL：u2\n正文：丙。" and got[2] == "[资料1]\n标题：x\nURL：x\n正文：only"
    assert all(len(r["context"]) <= 60 for r in rag.full_merge(rows, 60).collect())
    with pytest.raises(ValueError):
        rag.integrate("other", rows)


def model_multi(rows, k):
    found = []
    for sub in sorted({s for s, _, _ in rows}):
        for _, _, d in sorted(r for r in rows if r[0] == sub):
            if d not in found:
                found.append(d)
                if len(found) >= max(10, 3 * k):
                    break
    return found[: max(10, 4 * k)]


def test_multi_search_and_hops(spark):
    rng = random.Random(6)
    rows = [(q, s, r, rng.randint(0, 40)) for q in range(12) for s in range(8) for r in range(1, 6)]
    got = rag.multi_search(spark.createDataFrame(rows, "query_id long, subq int, rank_no int, docid long"), 5).collect()
    for q in range(12):
        assert [r["docid"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["place"])] == model_multi([x[1:] for x in rows if x[0] == q], 5)
    questions = spark.createDataFrame([(1, "2020 年入选者的主页"), (2, "别的"), (3, None)], "query_id long, text string")
    found = spark.createDataFrame([(1, 1, "我院张三老师入选2020计划"), (1, 2, "李四入选2019"), (1, 3, "2020 王五入选"), (2, 1, "赵六入选")], "query_id long, place int, title string")
    rule = rag.HopRule(("主页", "入选"), "(?:我院)?([一-鿿]{2,3}?)(?:老师|副教授)?入选", "%s 课程")
    assert [tuple(r) for r in rag.hop_queries(questions, found, rule).orderBy("subq").collect()] == [(1, 0, "张三 课程"), (1, 1, "王五 课程")]
    listed = spark.createDataFrame([(1, 100 + p, p) for p in range(1, 9)], "query_id long, docid long, place int")
    second = spark.createDataFrame([(1, 0, 1, 103), (1, 0, 2, 7), (1, 1, 1, 8), (1, 1, 2, 7)], "query_id long, subq int, rank_no int, docid long")
    assert [r["docid"] for r in rag.splice(listed, second, 5).orderBy("place").collect()] == [101, 102, 103, 104, 105, 7, 8, 106, 107, 108]


def test_prompts_and_model(spark):
    questions = spark.createDataFrame([(1, "why"), (2, None), (3, "slow"), (4, "broken")], "query_id long, text string")
    contexts = spark.createDataFrame([(1, "because"), (3, "x"), (4, "y")], "query_id long, context string")
    asked = rag.prompts(questions, contexts)
    assert {r["query_id"]: r["answer"] for r in asked.collect()} == {1: None, 2: rag.NO_CONTEXT, 3: None, 4: None}

    def model(prompt):
        import time

        if "broken" in prompt:
            raise TimeoutError
        time.sleep(0.3 if "slow" in prompt else 0)
        return f" {len(prompt)} "

    said = {r["query_id"]: r["answer"] for r in rag.answers(asked, model, pause_s=0.0, limit_s=0.2).collect()}
    assert said == {1: str(len(rag.PROMPT % ("why", "because"))), 2: rag.NO_CONTEXT, 3: "", 4: ""}


def test_frontier(spark):
    rows = spark.createDataFrame([("a1", "a", 1, 0), ("a2", "a", 5, 1), ("b1", "b", 0, 2)], "url string, host string, priority long, seq long")
    assert [r["url"] for r in frontier.round_robin(rows).orderBy("round", "host_turn").collect()] == ["a2", "b1", "a1"]
    assert [r["url"] for r in frontier.global_order(rows).orderBy("turn").collect()] == ["a2", "a1", "b1"]
    links = spark.createDataFrame([("s", "t"), ("t", "u"), ("u", "s")], "src string, dst string")
    assert {r["url"]: r["level"] for r in frontier.bfs_levels(links, spark.createDataFrame([("s",)], "url string")).collect()} == {"s": 0, "t": 1, "u": 2}


def test_places_with_a_hot_host(spark):
    rng = random.Random(8)
    rows = [(f"u{k}", rng.choice(["hot"] * 8 + ["b", "c", None]), rng.randint(0, 5), k) for k in range(400)]
    got = {r["url"]: r["n"] for r in frontier.place_in_group(spark.createDataFrame(rows, "url string, host string, p long, seq long").repartition(5), "host", ["p", "seq"], "n").collect()}
    for host in ("hot", "b", "c", None):
        own = sorted((r for r in rows if r[1] == host), key=lambda r: r[2:])
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_crawl_is_bounded_and_resumes(spark, tmp_path):
    saved = {(r["url"], r["final_url"]) for r in crawl_queries.crawl_demo(spark, "", where=str(tmp_path / "a")).collect()}
    assert saved == {(u, f) for u, f, _ in crawl_queries.WEB if "c.example" not in f}
    tried = spark.read.parquet(f"{tmp_path}/a/tried/*")
    assert tried.count() == tried.select("url").distinct().count() and tried.where("final_url is null").count() > 0 and tried.where("url like '%.pdf'").count() == 0
    known = spark.read.parquet(f"{tmp_path}/a/known/*")
    assert known.count() == known.select("url").distinct().count() == known.select("seq").distinct().count()
    few = crawl_queries.crawl_demo(spark, "", max_count=2, order="priority", where=str(tmp_path / "b"))
    assert few.count() == 2 and spark.read.parquet(f"{tmp_path}/b/tried/*").count() == 2
    more = frontier.Crawl(spark, f"{tmp_path}/b", spark.createDataFrame([("http://new.example/", 1)], "url string, ordinal long"), None, "fifo")
    assert "http://new.example/" in [r["url"] for r in more.turn(100).collect()]
    with pytest.raises(ValueError):
        frontier.Crawl(spark, str(tmp_path / "c"), known, None, "random")


def test_metrics(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 4)], "query_id long, docid long, rank_no int")
    relevant = spark.createDataFrame([(1, 11), (2, 20), (3, 30)], "query_id long, docid long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = metrics.ranking_metrics(results, relevant, queries).first()
    assert got["mrr"] == pytest.approx((0.5 + 0.25) / 3, abs=1e-6) and got["hit_3"] == pytest.approx(1 / 3, abs=1e-6) and got["recall"] == pytest.approx(2 / 3, abs=1e-6)


def test_latency_is_exact(spark):
    rng = random.Random(5)
    runs = [(rng.choice(["a"] * 6 + ["b", None]), rng.choice([None, rng.random() * 50, 7.0])) for _ in range(300)] + [("alone", 3.0), ("none", None)]
    got = {r["g"]: r for r in metrics.latency(spark.createDataFrame(runs, "g string, v double").repartition(6), "g", "v").collect()}
    for g, r in got.items():
        values = sorted(v for k, v in runs if k == g and v is not None)
        at = lambda p: (len(values) - 1) * p
        want = lambda p: values[int(at(p))] + (values[math.ceil(at(p))] - values[int(at(p))]) * (at(p) % 1)
        assert r["n"] == len(values)
        if values:
            assert r["p50"] == pytest.approx(want(0.5), abs=1e-5) and r["p95"] == pytest.approx(want(0.95), abs=1e-5) and r["longest"] == values[-1]
        else:
            assert r["p50"] is None and r["mean"] is None
    assert set(got) == {g for g, _ in runs}
