"""Operators that must judge whole texts and all candidates."""

import random

import numpy as np

from wherry.llm import leakage, residue


def test_paraphrases_by_brute_force(spark):
    item = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    edits = [
        "".join(c + ("x" if k % 3 == 2 else "") for k, c in enumerate(item)),
        "".join(c + ("x" if k % 4 == 3 else "") for k, c in enumerate(item)),
        "".join("x" if k % 5 == 4 else c for k, c in enumerate(item)),
        "".join("x" if k % 4 == 3 else c for k, c in enumerate(item)),
        item[:20],
        item[::-1],
        "无关的开头" * 100 + item[:50] + "无关的结尾" * 100,
        "隔".join(item[k] + "开很远很远很远" for k in range(60)),  # everything is there, but spread
        "",
        None,
    ]
    items = [(1, item), (2, item[:20]), (3, "！！"), (4, None)]
    got = leakage.paraphrases(spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, e in enumerate(edits):
        for i, t in items[:2]:
            u, v = leakage.units(t), leakage.units(e or "")
            best = max(leakage.lcs_length(u, v[a : a + 2 * len(u)]) for a in range(0, max(1, len(v)), 1)) / len(u)
            if best >= 0.8:
                want[d, i] = best
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and {(0, 1), (1, 1), (2, 1), (4, 2), (6, 1)} <= set(want) and not {(3, 1), (7, 1)} & set(want)
    assert all(r["overlap"] <= want[r["doc_id"], r["item_id"]] and r["answered"] == 1 for r in got)


def test_answers_are_checked(spark):
    item = "The tide gauge at Heron Bay was lowered by 47 steps after 1923 readings of the 12 floats near 5 huts"
    docs = [(1, item.replace("lowered", "moved")), (2, item.replace("47", "48").replace("1923", "1924").replace("12", "13")), (3, item.replace("47", "48"))]
    items = spark.createDataFrame([(1, item, "How many steps near 5 huts?")], "item_id long, text string, question string")
    got = {r["doc_id"]: r["answered"] for r in leakage.paraphrases(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: 1.0, 3: 2 / 3}
    assert leakage.answers("有3.5米和2号", None) == ["3.5", "2"] and leakage.answers("", "1") == []


def test_latent_space_is_the_dense_one(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("潮汐藻鲮蕨蛙螺浮标井测渠", k=90)) for _ in range(12)]
    vocabulary = leakage.Vocabulary(texts)
    idf = np.linspace(1, 3, len(vocabulary.terms))
    own = leakage.Passages(texts, vocabulary, idf)
    dense = np.zeros((own.n, own.n_terms))
    dense[own.row, own.term] = own.value
    x = np.random.default_rng(1).standard_normal((own.n_terms, 5))
    assert np.allclose(own.times(x), dense @ x) and np.allclose(own.transposed_times(dense @ x), dense.T @ dense @ x)
    space = leakage.latent_space(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), vocabulary, idf, rank=64)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
    assert np.allclose((dense @ space) @ (dense @ space).T, dense @ dense.T, atol=1e-3)  # the rank is that of the passages


def test_every_field_is_judged(spark):
    texts = ["页面未找到", "服务器连接超时", "The page has been removed", "too many requests", "bad gateway", "connection refused", "Traceback", "请启用JS后访问", "待办", "fixme", "uiop", "fdsa", "your title", "filler text"]
    texts = [t for t in texts if residue.evidence(t)]
    assert len(texts) >= 10
    rows = spark.createDataFrame([(k, None, t, None) for k, t in enumerate(texts)], "record_no long, url string, title string, abstract string")
    assert {r["record_no"] for r in residue.residue(rows).collect()} == set(range(len(texts)))
