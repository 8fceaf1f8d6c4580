from pyspark.sql import functions as F

from wherry.functions import html, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_stopwords(spark):
    assert one(spark, text.tokens(F.lit("Straße der 学生会, AI-2 人"))) == ["strasse", "der", "学生", "生会", "ai", "2", "人"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.without_stopwords(text.tokens(F.lit("the book of the")))) == ["book"]


def test_clean_compact_occurrences(spark):
    assert one(spark, text.clean_text(F.lit(" a 　b\n c "))) == "a b c"
    assert one(spark, text.compact(F.lit("Für 学生-A1!"))) == "fr学生a1"
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit(""))) == 0


def test_chunks(spark):
    for n, want in ((0, []), (1, [1]), (500, [500]), (501, [501, 1]), (650, [650, 150]), (651, [650, 151]), (1150, [650, 650, 150])):
        assert [len(x) for x in one(spark, text.chunks(F.lit("x" * n)))] == want


def test_sentences(spark):
    assert one(spark, text.sentences(F.lit("好。 坏！!尾"))) == ["好。", "坏！", "!", "尾"]
    assert one(spark, text.distinct_sentences(F.lit("A b。a B。c"))) == "A b。\nc"


def test_highlight(spark):
    assert one(spark, text.highlight(F.lit("a<b & AMP a.b"), F.lit("amp a.b"))) == "a&lt;b &amp; <mark>AMP</mark> <mark>a.b</mark>"
    assert one(spark, text.highlight(F.lit("x"), F.lit(" "))) == "x"


PAGE = """<html><head><title>T &amp; U</title><meta name="description" content=" D "><meta property="og:title" content="O"><script>var t="<h1>no</h1></p>";</script></head>
<body><nav>menu</nav><h1>One <b>two</b></h1><p>first<p>sec<b>ond</b></p><a href="/x#f">l</a><a href="http://o.example/y">m</a><article>long article text</article></body></html>"""


def test_page_fields(spark):
    page = F.lit(PAGE)
    assert one(spark, html.title(page)) == "T & U"
    assert one(spark, html.headings(page)) == ["One two"]
    assert one(spark, html.may_redirect(F.lit("<script>LOCATION.href='x'</script>"))) and not one(spark, html.may_redirect(page))


def test_canonical(spark):
    for url, want in (("http://h/index.html", "http://h"), ("http://h/", "http://h/"), ("http://h/a/index.html", "http://h/a"), ("HTTP://H:80/a//b/?b=2&a=1#f", "http://h/a/b?a=1&b=2"), ("nothing", None), ("http://u@h/x?q=%e4%b8%ad&a", "http://h/x?a=&q=%E4%B8%AD"), ("http://h/x?q=中+b%20c&z=%zz", "http://h/x?q=%E4%B8%AD+b+c&z=%zz"), ("http://h/x?k=~*", "http://h/x?k=~%2A")):
        assert one(spark, urls.canonical(F.lit(url))) == want


def test_ignored(spark):
    for url, want in (("http://a/x.PDF", True), ("http://a/x?f=b%2Ezip", True), ("http://a/x%2Epng", True), ("http://a/pdf", False)):
        assert one(spark, urls.is_ignored(F.lit(url))) == want
