import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wherry.llm import abuse, distinctive, leakage, packing, repeated_lines, spellings

SAME = [["http://a.example/x/", " HTTP://A.example:80//x", "(http://a.example/%78)", "http://a.example/x?", "http://a.example/x/index.html#top", "“http://a.example/x”。"], ["http://a.example/x?b=2&&a=1", "http://a.example/x?a=1&b=2&"], ["https://a.example/x"], ["http://a.example:8080/x"], ["http://a.example", "http://a.example/index.html", "http://a.example/"], ["http://a.example/a+b"], ["http://a.example/人", "http://a.example/%E4%BA%BA"], ["http://a.example/x?a=1"], ["http://a.example/x?a=%zz"], [""]]


@pytest.mark.parametrize("hot", [None, 2, 4])
def test_spellings(spark, hot):
    rows = [(100 * g + k, u, g) for g, us in enumerate(SAME) for k, u in enumerate(us)] + [(9000, None, -1)]
    df = spark.createDataFrame(rows, "id long, url string, g int")
    got = spellings.collapse(spellings.with_url_key(df, "url"), "url_key", "id", hot_rows=hot).collect()
    assert sorted((r["id"], r["keep_id"], r["copies"]) for r in got) == [(100 * g + k, 100 * g, len(us)) for g, us in enumerate(SAME) for k in range(len(us))]
    assert spellings.representatives(spellings.collapse(spellings.with_url_key(df, "url"), "url_key", "id", hot_rows=hot), "url_key").count() == len(SAME)


def test_spellings_empty(spark):
    df = spark.createDataFrame([], "id long, url string, keep_id long, copies string")
    assert spellings.collapse(spellings.with_url_key(df, "url"), "url_key", "id").collect() == []


def test_repeated_lines_by_brute_force(spark):
    rng = random.Random(5)
    pool = ["版权所有 2020", "版权所有 2021", "分享到：微信", "Share  It", "阅读次数：77", ""] + [f"正文{k}号内容" for k in range(60)]
    pages = [(f"h{k % 3}" if k % 7 else None, f"u{k}", "\n".join(rng.choices(pool, k=6)) if k % 11 else None) for k in range(150)]
    got = {(r["host"], r["line_key"]) for r in repeated_lines.excessive_lines(spark.createDataFrame(pages, "host string, page string, content string")).collect()}
    counts, sizes = defaultdict(set), Counter()
    for host, page, content in pages:
        if host and content is not None:
            sizes[host] += 1
            for line in content.split("\n"):
                key = "".join("0" if c.isdigit() else c for c in line.lower() if not c.isspace())
                while "00" in key:
                    key = key.replace("00", "0")
                if key:
                    counts[host, key].add(page)
    assert got == {k for k, v in counts.items() if len(v) >= 5 and len(v) >= 0.05 * sizes[k[0]]}
    cleaned = repeated_lines.without_lines(spark.createDataFrame([("h", "p", "a\nB 1\nc")], "host string, page string, content string"), spark.createDataFrame([("h", "b0", 1)], "host string, line_key string, n_pages long"))
    assert cleaned.first()["cleaned"] == "a\nc"


def test_near_duplicate_lines_are_removed_together(spark):
    words = [f"{a}{b}" for a in "潮汐藻鲮蕨" for b in "测渠坝村湾岭数读"]
    lines = [f"{words[k]}。独有的第{words[-k - 1]}句话" for k in range(40)]
    pages = [("h", f"u{k}", f"{lines[k]}\n本网讯 通讯员来自学生会办公室第{'甲乙丙丁戊己庚辛壬癸'[k % 10]}组的同学供稿\n") for k in range(40)]
    pages += [(None, "x", "a"), ("h", "none", None), ("other", "o", lines[0])]
    df = spark.createDataFrame(pages, "host string, page string, content string")
    assert repeated_lines.excessive_lines(df, 5, 0.2).count() == 0  # no line alone is found in a fifth of the pages
    clusters = repeated_lines.excessive_clusters(df, 5, 0.2).collect()
    assert len(clusters) == 10 and {r["cluster_pages"] for r in clusters} == {40} and len({r["leader"] for r in clusters}) == 1
    cleaned = {r["page"]: r["cleaned"] for r in repeated_lines.without_lines(df, repeated_lines.excessive_clusters(df, 5, 0.2)).collect()}
    assert all(cleaned[f"u{k}"] == lines[k] + "\n" for k in range(40)) and cleaned["x"] == "a" and cleaned["none"] is None and len(cleaned) == 43


def test_hypergeometric_against_sums():
    for k, n, hits, total in ((1, 5, 7, 50), (3, 10, 10, 40), (0, 5, 5, 20), (5, 5, 5, 30), (2, 30, 4, 33)):
        exact = sum(math.comb(hits, i) * math.comb(total - hits, n - i) for i in range(max(k, 0), min(n, hits) + 1) if total - hits >= n - i) / math.comb(total, n)
        assert distinctive.log_upper_tail(np.array([k]), np.array([n]), np.array([hits]), np.array([total]))[0] == pytest.approx(math.log(exact), abs=1e-9)


@pytest.mark.parametrize("hot", [None, 1, 3])
def test_term_scores(spark, hot):
    rows = [("a", 1, 1, 2), ("a", 1, 1, 2), ("a", 2, 1, None), ("b", 1, 3, 10), ("c", 3, 1, 1), ("d", 3, 1, 1), ("e", 3, 1, 1), ("f", 3, 1, 1), (None, 4, 1, 1), ("g", None, 1, 1)]
    scores = distinctive.term_scores(spark.createDataFrame(rows, "term string, docid long, tf long, weighted_tf long"), hot_rows=hot)
    by = {(r["docid"], r["term"]): r["score"] for r in scores.collect()}
    assert by[1, "a"] == pytest.approx((1 + math.log10(2)) * math.log10(1.5), abs=1e-6) and by[2, "a"] == pytest.approx(math.log10(1.5), abs=1e-6) and by[1, "b"] == pytest.approx(2 * math.log10(3), abs=1e-6)
    assert sorted((r["docid"], r["term"]) for r in distinctive.top_terms(scores).collect()) == [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "d"), (3, "e")]
    assert all(0 <= r["q"] <= 1 for r in distinctive.enriched_terms(scores, 1.0).collect())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=25), st.integers(100, 200))
def test_packing_holds_every_item(lengths, capacity):
    packed = packing.pack_lengths(lengths, capacity)
    used = Counter()
    for parts, times in packed:
        assert sum(parts) <= capacity and times > 0
        for p in parts:
            used[p] += times
    assert used == Counter(lengths)
    total = sum(n * c for n, c in lengths.items())
    assert sum(t for _, t in packed) <= 2 * total // capacity + 1


def test_pack_table(spark):
    rows = [(k, n) for k, n in enumerate([50, 50, 100, 0, 250, 99, 1, 7])] + [(50, None), (51, 50), (51, 50)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), [("k", 100)], shard_rows=4).collect()
    room, per = Counter(), Counter()
    for r in got:
        room[r["shard"], r["container_no"]] += r["n_tokens"]
        per[r["doc_id"]] += r["n_tokens"]
    assert max(room.values()) <= 100 and {r["doc_id"] for r in got if r["piece"] > 0} == {4}
    shares = packing.fill(packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), [("k", 100), ("l", 50)])).collect()
    assert {r["kind"]: r["n_tokens"] for r in shares} == {"k": 657, "l": 657} and all(0 < r["share"] <= 1 for r in shares)
    assert packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), []).count() == 0
    assert per == Counter({0: 50, 1: 50, 2: 100, 3: 0, 4: 250, 5: 99, 6: 1, 7: 7, 51: 100})


def test_real_tokenizer_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "学生会 <|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got[1] == 2 and got[2] is None and got[3] > 3


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "潮汐藻鲮蕨蛙螺浮标井" for b in "测渠坝村湾岭数读格"]
    items = [(k, "".join(rng.choices(words, k=30))) for k in range(12)]
    docs = []
    for k in range(120):
        text = "，".join(rng.choices(words + ["新闻通知", "学院举办讲座"], k=60))
        if k % 4 == 0:
            item = items[k % 12][1]
            a, n = rng.randint(0, 20), rng.choice([28, 29, 30, 31, 40])
            text = text[:37] + "。 ".join(item[a : a + n]) + text[37:]
        docs.append((k, text))
    docs += [(500, None), (501, ""), (502, items[0][1].upper())]
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = leakage.normalise(t or ""), leakage.normalise(x)
            if any(b[j : j + 30] in a for j in range(len(b) - 29)):
                want.add((d, i))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(77, None), (78, "短")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it).collect()} == want
    assert (502, 0) in {(r["doc_id"], r["item_id"]) for r in leakage.paraphrases(df, it).collect()}
    assert leakage.leaks(df, it.limit(0)).collect() == []


def test_lcs():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 20))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leakage.lcs_length(a, b) == table[-1][-1]


def _bag(rng, bad):
    plain = [f"{rng.choice('物理数学文史法')}学院举办{rng.choice(['气候适应', '知识图谱', '古籍修复'])}{rng.choice(['讲座', '论坛', '展览'])}，共{rng.randint(2, 90)}人参加。" for _ in range(6)]
    return "\n".join(rng.sample(plain + ([bad] if bad else []), 6 + bool(bad)))


def test_abuse_held_out():
    rng = random.Random(11)
    insult = lambda: f"{rng.choice(['你们', '你', '楼主'])}{rng.choice(['真是', '就是个'])}{rng.choice(['坏东西', '大笨蛋', '糊涂虫'])}，{rng.choice(['闭嘴吧', '滚出去', '活该被骂'])}！"
    make = lambda n: [(_bag(rng, insult() if k % 4 == 0 else None), k % 4 == 0) for k in range(n)]
    train, test = make(240), make(120)
    noisy = [(t, {"abuse": float(y if rng.random() > 0.05 else not y)}) for t, y in train]
    machine = abuse.fit(noisy)
    disguised = lambda t: "\n".join("*".join(line) if "！" in line and "举办" not in line else line for line in t.split("\n"))
    for change in (lambda t: t, disguised):
        got = machine.document_scores([change(t) for t, _ in test])[:, 0] > abuse.DECISION
        truth = np.array([y for _, y in test])
        assert (got & truth).sum() >= 0.9 * truth.sum() and (got & ~truth).sum() <= 0.05 * len(test)
    assert machine.document_scores(["", "a" * 50_000]).shape == (2, 3)


def test_abuse_tables(spark):
    docs = spark.createDataFrame([(1, "文一。", "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, "abuse", "r"), (9, "none", "r"), (None, None, None)], "doc_id long, category string, rater string")
    machine = abuse.fit(abuse.labelled_sample(docs, labels))
    scores = abuse.score_documents(docs, machine)
    assert scores.count() == 3 and abuse.flagged(scores).count() == 0
    assert {r["n_docs"] for r in abuse.rates(scores).collect()} == {1, 2}
    assert abuse.sentences("H0rny s1ngles！ w-o-r-d。\n回复：一句话") == ["hornysingles", "word", "一句话"]
