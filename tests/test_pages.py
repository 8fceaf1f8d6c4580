"""The page parser and link normalisation on goldens."""

import pytest
from pyspark.sql import functions as F

from wherry.functions.links import normalise_link
from wherry.functions.pages import FIELDS, meta, parse_page, parsed

BASE = "http://a.example/x/y.html"


def fields(page, **given):
    return dict(zip(FIELDS, parse_page(page, BASE, **given), strict=True))


def test_nested_containers_and_implied_ends():
    got = fields("<body><nav>menu</nav><div class='content'><div>in</div>after<p>one<p>two<b>x</b><ul><li>a<li>b</ul></div><article>short</article><footer>foot")
    assert got["content"] == "in after one two x a b" and got["paragraphs"] == ["one", "twox"] and got["paragraphs_spaced"] == ["one", "two x"]
    assert fields("<main>long main text</main><article>short</article>")["content"] == "long main text"
    assert fields("<div class='zi'>mine</div> other", containers=[".other"])["content"] == "mine other"
    assert fields("<p>a<!-- c -->b</p>")["paragraphs"] == ["ab"]
    assert fields("<h1>A<h2>B <i>c</i></h2>")["headings"] == ["A", "Bc"]


def test_unseen_parts_and_entities():
    got = fields("<title> T &amp; U</title><script>var a='<p>no</p>';</script><body><style>x</style><noscript><p>n</p></noscript><svg><title>s</title></svg><p>&eacute;&#20013;&nbsp;|</p>")
    assert got["title"] == "T & U" and got["paragraphs"] == ["é中\xa0|"] and got["visible"] == "é中 |"


def test_metas_links_redirects():
    got = fields("""<meta content="D" name=description><meta name=description content=second><meta content="0;URL='/r'" http-equiv=Refresh><a href=/q?p=2#f>l</a><a href="?p=3">m</a><a href='HTTP://H.Example:80/a/../b'>z</a><a href=mailto:x>w</a><a name=y>v</a><script>location.replace("../z.html"); x.location.href = '/q?p=2'</script>""")
    assert dict(zip(got["meta_names"], got["meta_contents"], strict=True)) == {"description": "D"}
    assert got["links"] == ["http://a.example/q?p=2", "http://a.example/x/y.html?p=3", "http://h.example/b"]
    assert got["redirects"] == ["http://a.example/r", "http://a.example/q?p=2", "http://a.example/z.html"]


@pytest.mark.parametrize(("href", "want"), [
    ("../z.html", "http://a.example/z.html"), ("./c", "http://a.example/x/c"), ("", None), (" javascript:f()", None), ("//B.example:443", "http://b.example:443/"), ("https://b.example:443", "https://b.example/"), ("/a/./b/../c", "http://a.example/a/c"),
    ("/%7ex%2fy%e4", "http://a.example/~x%2Fy%E4"), ("/中?k=文", "http://a.example/%E4%B8%AD?k=%E6%96%87"), ("http://a%20b.example/", None), ("http://a.example:x/", None), ("ftp://a.example/", None), ("http://中.example/", "http://xn--fiq.example/"), (None, None), ("http://u:p@a.example/#f", "http://a.example/"),
])
def test_normalise_link(href, want):
    assert normalise_link(href, BASE) == want


def test_parsed_column(spark):
    rows = spark.createDataFrame([(1, "<meta name=a content=x><p>t</p>"), (2, None), (3, ""), (4, "x" * 200_000), (5, "<" * 500 + "<div>" * 5000)], "id long, body string")
    got = {r["id"]: r for r in rows.select("id", parsed(F.col("body")).alias("p")).select("id", "p.*", meta(F.col("p"), ["none", "a"]).alias("m")).collect()}
    assert got[1]["m"] == "x" and got[1]["paragraphs"] == ["t"] and got[2]["visible"] is None and got[3]["visible"] == "" and len(got[4]["visible"]) == 200_000 and got[5]["n_errors"] == 0
