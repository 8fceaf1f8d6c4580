"""Adaptors around the engine: terminal, another engine's result pages, metadata as JSON."""

import json
from pathlib import Path

from wherry import repl
from wherry.plans import text_queries
from wherry.sources import websearch

PAGE = """<div><a class="x result__a" href="//duck.example/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&rut=z">One <b>two</b></a><a class="result__snippet" href="#">s &amp; <b>t</b></a></div>
<a class="result__a" href="javascript:no">skip</a><a class=result__a href="/rel">Three</a>"""


def test_results_of_another_engine(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "fails")], "query_id long, text string")
    seen = "https://duck.example/?q=a+b"
    got = websearch.search(rows, lambda address: PAGE if address == seen else None, "https://duck.example/?q=%s", 5).collect()
    assert [tuple(r) for r in got] == [(1, 1, "https://a.example/x?y=1", "One two", "s & t"), (1, 2, "https://duck.example/rel", "Three", "")]
    assert websearch.results(PAGE, "", 0) == [] == websearch.results("", "", 5)


def test_terminal_and_json(spark, tmp_path):
    spark.createDataFrame([(0, "<title>T</title><p>cat</p>"), (1, None)], "file_id long, body string").write.parquet(f"{tmp_path}/page_files.parquet")
    spark.createDataFrame([(0, "http://a.example/0"), (1, "http://a.example/1")], "docid long, url string").write.parquet(f"{tmp_path}/doc_map.parquet")
    spark.createDataFrame([(0, 0, "cat", "", None, "h"), (1, 1, "dog", "", None, "i")], "record_no long, docid long, title string, abstract string, published_date string, content_hash string").write.parquet(f"{tmp_path}/page_metadata.parquet")
    assert list(repl.replies(spark, str(tmp_path), ["dog\n", " \n", "none"], 2)) == [[(1, "http://a.example/1"), (2, "http://a.example/0")], [(1, "http://a.example/0"), (2, "http://a.example/1")]]
    assert text_queries.build_metadata(spark, str(tmp_path), f"{tmp_path}/out") == {"ok": 1, "failed": 1}
    lines = [json.loads(x) for f in Path(tmp_path, "out").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["docID"]: x["title"] for x in lines} == {0: "T", 1: "http://a.example/1"}
