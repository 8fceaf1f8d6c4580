"""Queries without SQL on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wherry.operators import rag
from wherry.plans import crawl_queries, text_queries

PAGES = [
    (0, '<html><head><title>T</title><meta name="description" content="own"></head><body><h1>H</h1><p>body <b>text</b></p><a href="/x">x</a></body></html>'),
    (1, "<html><head><title>U</title></head><body><h1>H2</h1><p>" + "y" * 300 + "</p><script>location.href='/new'</script></body></html>"),
    (2, "<html><body><h2>only heading</h2></body></html>"),
    (3, ""),
    (4, None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(PAGES, "file_id long, body string").write.parquet(f"{path}/page_files.parquet")
    spark.createDataFrame([(k, f"http://a.example/{k}", "f") for k in range(5)], "docid long, url string, file string").write.parquet(f"{path}/doc_map.parquet")
    spark.createDataFrame([("a.example", "A", "UTC", "ymd")], "host string, unit_name string, tz string, date_order string").write.parquet(f"{path}/sites.parquet")
    return path


def test_page_queries(spark, folder):
    got = {r["docid"]: r for r in text_queries.QUERIES["page_metadata"](spark, folder).collect()}
    assert {k: r["abstract"] for k, r in got.items()} == {0: "own", 1: "y" * 200, 2: "only heading", 3: "", 4: ""}
    assert {k: r["title"] for k, r in got.items()} == {0: "T", 1: "U", 2: "http://a.example/2", 3: "http://a.example/3", 4: "http://a.example/4"}
    assert got[0]["content_hash"] == hashlib.sha256(b"T H body text").hexdigest() and got[4]["content_hash"] is None and got[4]["published_date"] is None
    generic = text_queries.page_metadata(text_queries.page_rows(spark, folder), generic=("own",)).where("docid = 0").first()
    assert generic["abstract"] == "body text"
    assert {(r["docid"], r["link"]) for r in text_queries.page_links(spark, folder).collect()} == {(0, "http://a.example/x"), (1, "http://a.example/new")}
    assert [r["link"] for r in crawl_queries.all_links(spark, folder).collect()] == ["http://a.example/new", "http://a.example/x"]
    assert (1, "http://a.example/new") in [(r["docid"], r["target"]) for r in text_queries.redirect_links(spark, folder).collect()]
    assert {r["url"] for r in crawl_queries.recover_redirects(spark, folder).collect()} == {"http://a.example/new", "http://a.example/new/a.htm", "http://a.example/up.html"}


def test_sub_queries(spark):
    text = "“量子测量”系列 2020 论坛由温老师主讲"
    got = spark.range(1).select(rag.sub_queries(F.lit(text)).alias("q")).first()["q"]
    assert got[0] == "量子测量" and got[-1] == text and any(q.startswith("2020 ") for q in got) and any("老师" in q for q in got) and len(got) <= 8
    rare = spark.range(1).select(rag.sub_queries(F.lit("x 2020"), F.lit("r s"))).first()[0]
    assert rare == ["2020 x", "r s", "x 2020"] and spark.range(1).select(rag.sub_queries(F.lit(None).cast("string"))).first()[0] is None
