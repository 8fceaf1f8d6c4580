"""Queries on sources, pages, text and urls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.functions import html, pages, text, urls
from wherry.operators.index import first_seen, last_wins
from wherry.operators.skew import hot_threshold, join_by_frequency
from wherry.plans import sql
from wherry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _select(name: str, key: str, make: Callable[[], Column], column: str) -> Query:
    """``key`` and one made column of a table; columns need a session, so they are made when the query is."""
    return lambda spark, folder: table(spark, folder, name).select(key, make().alias(column))


def _explode(name: str, key: str, make: Callable[[], Column], item: str) -> Query:
    return lambda spark, folder: table(spark, folder, name).select(key, F.posexplode(make()).alias("pos", item))


def metadata_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return last_wins(table(spark, folder, "page_metadata", "url", "record_no", "title", "abstract", "published_date"), "url", "record_no")


def metadata_status(spark: SparkSession, folder: str) -> DataFrame:
    """How many records were extracted and how many only hold the url."""
    failed = (F.col("title") == F.col("url")) & (F.coalesce(F.col("abstract"), F.lit("")) == "") & F.col("content_hash").isNull()
    return table(spark, folder, "page_metadata").agg(F.count_if(~F.coalesce(failed, F.lit(False))).alias("n_ok"), F.count_if(F.coalesce(failed, F.lit(False))).alias("n_failed"))


def json_tolerant_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties that are JSON objects, counted by type; malformed ones are skipped."""
    events = table(spark, folder, "events", "event_type", "props")
    parsed = events.withColumn("p", F.from_json("props", "map<string,string>"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("p").isNotNull() & (F.size("p") > 0)).alias("n_objects"))


def stopword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queries").select("query_id", F.array_join(text.without_stopwords(text.tokens(F.col("text"))), " ").alias("terms"))


def index_files(spark: SparkSession, folder: str) -> DataFrame:
    """The file of each url that the crawl log names last; urls without file are left out."""
    rows = table(spark, folder, "url_index", "url", "file", "entry_id").where(F.col("file").isNotNull())
    return last_wins(rows, "url", "entry_id")


def doc_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Dense ids of the distinct urls in the order in which the crawl log saw them first."""
    from wherry.operators.index import dense_ids

    seen = first_seen(table(spark, folder, "url_index", "url", "entry_id"), "url", "entry_id")
    return dense_ids(seen, ["entry_id"], "docid").select("docid", "url")


#: Pages with redirects, which the tables lack, as (file_id, page).
REDIRECT_PAGES = [
    (-1, '<html><head><meta http-equiv="refresh" content="0; url=/new/a.htm"></head><body></body></html>'),
    (-2, '<html><head><META content="5;URL=\'http://b.example/x?p=2#top\'" HTTP-EQUIV=Refresh></head></html>'),
    (-3, '<script>window.location.href = "../up.html"; location.replace(\'HTTP://C.example:80/a/../b\')</script>'),
    (-4, '<p>location.href = "/in/text.htm"</p><script>var location = "/not.htm"; location.href="javascript:void(0)"</script>'),
    (-5, '<script>location.href="https://math.yunpu-u.example/moved.htm"</script>'),
]
#: Their targets, seen from ``http://a.example/d/page.htm``.
REDIRECT_TARGETS = [(-1, "http://a.example/new/a.htm"), (-2, "http://b.example/x?p=2"), (-3, "http://a.example/up.html"), (-3, "http://c.example/b"), (-5, "https://math.yunpu-u.example/moved.htm")]


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``docid, url, body`` of the saved pages; the url is null for a file that the doc map lacks."""
    files = table(spark, folder, "page_files", "file_id", "body")
    return files.join(table(spark, folder, "doc_map", "docid", "url").withColumnRenamed("docid", "file_id"), "file_id", "left").select(F.col("file_id").alias("docid"), "url", "body")


def bare_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``docid, url, body`` of the saved pages without urls, for what needs none."""
    return table(spark, folder, "page_files", "file_id", "body").select(F.col("file_id").alias("docid"), F.lit(None).cast("string").alias("url"), "body")


def parsed_pages(rows: DataFrame) -> DataFrame:
    """``docid, url`` and the parsed page ``p`` of ``rows(docid, url, body)``; every page is parsed once."""
    return rows.select("docid", "url", pages.parsed(F.col("body"), F.col("url")).alias("p"))


def page_metadata(rows: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """``docid, url, title, abstract, published_date, content_hash`` of each page of ``rows(docid, url, body)``.

    The title is the one a meta element names, else the title element, else the
    url; the abstract that of a meta element, else (or if it is one of ``generic``,
    which say the same on every page) the first 200 characters of the paragraphs,
    else of all visible text, else the first heading. The hash is of title,
    headings and text. A page that can't be parsed, or is null, keeps its url as
    title, an empty abstract and nulls.
    """
    p = F.col("p")
    body = F.coalesce(F.nullif(F.array_join(p["paragraphs_spaced"], " "), F.lit("")), p["visible"])
    parts = parsed_pages(rows).select("docid", "url", "p", F.coalesce(pages.meta(p, html.TITLE_METAS), F.nullif(p["title_spaced"], F.lit("")), F.col("url")).alias("title"), pages.meta(p, html.ABSTRACT_METAS).alias("named"), body.alias("text"))
    named = F.when(~F.col("named").isin(*generic), F.col("named")) if generic else F.col("named")
    abstract = F.coalesce(named, F.nullif(F.substring("text", 1, 200), F.lit("")), F.get(p["headings_spaced"], F.lit(0)), F.lit(""))
    whole = F.when(F.col("text").isNotNull(), F.sha2(text.clean_text(F.concat_ws(" ", "title", F.array_join(p["headings_spaced"], " "), "text")), 256))
    return parts.select("docid", "url", "title", abstract.alias("abstract"), F.coalesce(pages.meta(p, html.DATE_METAS), F.when(whole.isNotNull(), F.lit(""))).alias("published_date"), whole.alias("content_hash"))


def metas(spark: SparkSession, folder: str) -> DataFrame:
    """Title and date to show for every page."""
    return page_metadata(page_rows(spark, folder)).select("docid", "title", "published_date")


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return page_metadata(page_rows(spark, folder)).select("docid", "content_hash")


def abstracts(spark: SparkSession, folder: str) -> DataFrame:
    """The abstract a page gets: its own, else the first 200 characters of its text, else its first heading."""
    return page_metadata(page_rows(spark, folder)).select("docid", "abstract")


def main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The longest text of any known container of each page, else of its body."""
    return parsed_pages(bare_pages(spark, folder)).select("docid", F.col("p.content").alias("text"))


def page_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_pages(bare_pages(spark, folder)).select("docid", F.posexplode("p.paragraphs").alias("pos", "paragraph"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct links and redirects of every page, absolute and normalised."""
    found = parsed_pages(page_rows(spark, folder))
    return found.select("docid", F.explode(F.array_distinct(F.concat("p.links", "p.redirects"))).alias("link"))


def redirect_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``docid, url, body`` of pages that may redirect: saved ones, told by a test of the source, and ``REDIRECT_PAGES``."""
    samples = spark.createDataFrame([(k, "http://a.example/d/page.htm", p) for k, p in REDIRECT_PAGES], "docid long, url string, body string")
    return page_rows(spark, folder).unionByName(samples).where(html.may_redirect(F.col("body")))


def redirect_links(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_pages(redirect_rows(spark, folder)).select("docid", F.explode("p.redirects").alias("target"))


def highlighted(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "search_results", "result_id", "query_id", "title").join(table(spark, folder, "queries"), "query_id")
    return results.select("result_id", text.highlight(F.col("title"), F.col("text")).alias("html"))


def present_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results with the title and abstract to show: the metadata's, else the url and nothing."""
    meta = metadata_last_wins(spark, folder).select("url", F.col("title").alias("m_title"), "abstract")
    rows = table(spark, folder, "search_results", "result_id", "query_id", "rank_no", "url")
    shown = meta.join(rows.groupBy("url").agg(F.count("*").alias("_n")), "url")  # popular pages stand under many queries
    joined = join_by_frequency(rows, shown, "url", F.col("_n"), hot_threshold(rows.count()), "left")
    return joined.select("result_id", "query_id", "rank_no", "url", F.coalesce("m_title", "url").alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"))


def host_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "url_index", "url").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def url_priority(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "doc_map", "docid", "url").select("docid", urls.priority(F.col("url")).cast("long").alias("priority"))


def ignored_files(spark: SparkSession, folder: str) -> DataFrame:
    samples = ["http://a.example/x.pdf", "http://a.example/x.PDF?y=1", "http://a.example/x?f=b.zip", "http://a.example/x?f=b%2Ezip", "http://a.example/x%2Epng", "http://a.example/x.html", "http://a.example/pdf", "http://a.example/?q=.tar.gz"]
    rows = spark.createDataFrame([(u,) for u in samples], "url string").unionByName(table(spark, folder, "doc_map", "url"))
    return rows.select("url", urls.is_ignored(F.col("url")).alias("ignored"))


#: What a question may name, as patterns whose first group is the name.
ENTITIES = {"quoted": "[“\"]([^”\"]+)[”\"]", "year": r"((?:19|20)\d{2})", "person": "([一-鿿](?:老师|教授))", "company": "([一-鿿]{2,4}公司)"}


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("entity"))


def query_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted parts, years, teachers and companies that titles and queries name, each once a text."""
    titles = table(spark, folder, "page_metadata", "record_no", "title").select(F.lit("title").alias("of"), F.col("record_no").alias("ident"), F.col("title").alias("text"))
    asked = table(spark, folder, "queries").select(F.lit("query").alias("of"), F.col("query_id").alias("ident"), "text")
    found = F.concat(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), _named(name)) for name, p in ENTITIES.items()))
    return titles.unionByName(asked).select("of", "ident", F.explode(F.array_distinct(found)).alias("e")).select("of", "ident", "e.kind", "e.entity")


def build_metadata(spark: SparkSession, folder: str, path: str) -> dict[str, int]:
    """Writes :func:`page_metadata` of all pages as JSON lines to ``path``; how many were read, and how many kept only their url because they couldn't be."""
    from wherry.sources.jsonl import write_records

    write_records(page_metadata(page_rows(spark, folder)).withColumnRenamed("docid", "docID"), path)
    done = spark.read.schema("content_hash string").json(path).agg(F.count("content_hash").alias("ok"), F.count_if(F.col("content_hash").isNull()).alias("failed")).first()
    return {"ok": done["ok"], "failed": done["failed"]}


def html_content_type(spark: SparkSession, folder: str) -> DataFrame:
    """Which content types count as a page; an absent one does."""
    rows = spark.createDataFrame([("text/html",), ("text/html; charset=gbk",), ("application/xhtml+xml",), ("TEXT/HTML",), ("application/pdf",), ("image/png",), (None,)], "content_type string")
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    return rows.select("content_type", F.coalesce(kind.isin("text/html", "application/xhtml+xml"), F.lit(True)).alias("is_page"))


#: Texts in scripts that the tables lack.
SCRIPTS = ["Café naïve STRASSE Straße", "Привет, мир 2024", "한국어 토큰", "タワー東京タワー", "abc学院xyz 学", "", "١٢٣ ok"]


def tokenize_scripts(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(SCRIPTS)), "text_id long, text string")
    return rows.select("text_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "token"))


#: Page bytes in several charsets as (file_id, hex), and what is read from them.
BYTES = [(k, t.encode(c).hex()) for k, (t, c) in enumerate([("<p>学院</p>", "utf-8"), ("<p>大学新闻</p>", "gb18030"), ('<meta charset="big5"><p>學院</p>', "big5"), ("<p>é</p>", "utf-16"), ("", "utf-8")])]
READ = ["<p>学院</p>", "<p>大学新闻</p>", '<meta charset="big5"><p>學院</p>', "<p>é</p>", ""]


def valid_utf8_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Which pages are valid UTF-8, and their text whatever the charset: saved bodies and ``BYTES``."""
    from wherry.sources.jsonl import decoded

    saved = table(spark, folder, "page_files", "file_id", "body").select("file_id", F.col("body").cast("binary").alias("content"))
    rows = spark.createDataFrame([(-1 - k, h) for k, h in BYTES], "file_id long, h string").select("file_id", F.unhex("h").alias("content"))
    return saved.unionByName(rows).select("file_id", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.md5(decoded(F.col("content"))).alias("text_hash"))


QUERIES: dict[str, Query] = {
    "scan_docs": lambda spark, folder: table(spark, folder, "doc_map", "docid", "url", "file"),
    "metadata_last_wins": metadata_last_wins,
    "metadata_status": metadata_status,
    "json_tolerant_scan": json_tolerant_scan,
    "stopword_filter": stopword_filter,
    "index_files": index_files,
    "doc_ids": doc_ids,
    "page_paths": _select("doc_map", "docid", lambda: F.concat(urls.host(F.col("url")), F.lit("/"), F.sha2("url", 256), F.lit(".html")), "path"),
    "html_content_type": html_content_type,
    "page_title": _select("page_files", "file_id", lambda: html.title(F.col("body")), "title"),
    "page_headings": _explode("page_files", "file_id", lambda: html.headings(F.col("body")), "heading"),
    "page_paragraphs": page_paragraphs,
    "visible_text": _select("page_files", "file_id", lambda: html.visible_text(F.col("body")), "text"),
    "main_text": main_text,
    "page_metadata": lambda s, d: page_metadata(page_rows(s, d)),
    "display_metas": metas,
    "abstracts": abstracts,
    "content_hash": content_hash,
    "page_links": page_links,
    "redirect_links": redirect_links,
    "redirect_prefilter": lambda s, d: redirect_rows(s, d).select("docid"),
    "highlight": highlighted,
    "present_results": present_results,
    "clean_text": _select("search_results", "result_id", lambda: text.clean_text(F.col("content")), "text"),
    "tokenize": _explode("page_metadata", "record_no", lambda: text.tokens(F.col("title")), "token"),
    "tokenize_scripts": tokenize_scripts,
    "valid_utf8_pages": valid_utf8_pages,
    "normalize_terms": _explode("page_metadata", "record_no", lambda: text.without_stopwords(text.tokens(F.col("abstract"))), "term"),
    "compact_text": _select("page_metadata", "record_no", lambda: text.compact(F.col("title")), "compact"),
    "term_occurrences": _select("documents", "doc_id", lambda: text.occurrences(F.coalesce(F.col("text"), F.lit("")), F.lit("学院")), "n"),
    "chunks": _explode("documents", "doc_id", lambda: text.chunks(F.col("text")), "chunk"),
    "sentences": _explode("documents", "doc_id", lambda: text.sentences(F.col("text")), "sentence"),
    "dedup_sentences": _select("documents", "doc_id", lambda: text.distinct_sentences(F.col("text")), "text"),
    "query_entities": query_entities,
    "canonical_urls": _select("doc_map", "docid", lambda: urls.canonical(F.col("url")), "canonical"),
    "ignored_files": ignored_files,
    "url_priority": url_priority,
    "host_counts": host_counts,
}

_Q = sql.quoted
_URL = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part_sql(x: str, k: int) -> str:
    """Group ``k`` of a url in SQL: 1 scheme, 2 host, 3 port, 4 path, 5 query."""
    return f"regexp_extract(regexp_replace({x}, {_Q(sql.WHITE)}, '', 'g'), {_Q(_URL.replace('^(?i)', '(?i)^'))}, {k})"




def host_sql(x: str) -> str:
    return f"nullif(lower({part_sql(x, 2)}), '')"


_HOST = host_sql("url")
_SAMPLES = "('http://a.example/x.pdf'), ('http://a.example/x.PDF?y=1'), ('http://a.example/x?f=b.zip'), ('http://a.example/x?f=b%2Ezip'), ('http://a.example/x%2Epng'), ('http://a.example/x.html'), ('http://a.example/pdf'), ('http://a.example/?q=.tar.gz')"
_SUFFIX = "(?i)(?:" + "|".join(s.replace(".", r"\.") for s in urls.IGNORED_SUFFIXES) + ")$"


def _form_sql(x: str) -> str:
    return f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"


def _unnest(table_name: str, key: str, array: str, item: str) -> str:
    return f"select {key}, unnest(range(0, len(a)))::int as pos, unnest(a) as {item} from (select {key}, {array} as a from {table_name})"


_BODY_RE = r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)"
_HEADS = f"list_transform(regexp_extract_all({sql.without_code('body')}, '(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]\\s*>', 1), lambda x: {sql.inner_text('x', '')})"

_HELD = " , ".join(f"regexp_extract_all(m, {_Q(p)}, 1)" for p in sql.HOLDERS)
_LONGEST = f"list_transform(flatten([{_HELD}]), lambda x: {sql.clean(sql.pieces('x', ' '))})"
MAIN_TEXT = f"mm as (select docid, regexp_replace(b, {_Q(sql.BESIDE)}, ' ', 'g') as m from pb), ml as (select docid, m, {_LONGEST} as a from mm)"
MAIN_TEXT_ROWS = f"select docid, case when len(a) > 0 then list_reduce(a, lambda x, y: case when length(y) > length(x) then y else x end) else {sql.clean(sql.pieces('m', ' '))} end as text from ml"
_PORT = f"case when {part_sql('url', 3)} = '' or (lower({part_sql('url', 1)}) = 'http' and {part_sql('url', 3)} = '80') or (lower({part_sql('url', 1)}) = 'https' and {part_sql('url', 3)} = '443') then '' else ':' || {part_sql('url', 3)} end"
_ORIGIN = f"lower({part_sql('url', 1)}) || '://' || lower({part_sql('url', 2)}) || {_PORT}"
_TARGETS = ", ".join(f"({k}, {_Q(u)})" for k, u in REDIRECT_TARGETS)
_METADATA = f"with {sql.PAGES} select %s from px"

ORACLES = {
    "tokenize_scripts": f"select text_id, unnest(range(0, len(a)))::int as pos, unnest(a) as token from (select text_id, {sql.tokens('text')} as a from (values {', '.join(f'({k}::bigint, {_Q(t)})' for k, t in enumerate(SCRIPTS))}) x(text_id, text))",
    "valid_utf8_pages": f"select file_id, body is not null as valid, md5(body) as text_hash from page_files where body is not null union all select file_id, null, null from page_files where body is null union all select * from (values {', '.join(f'({-1 - k}::bigint, {k in (0, 4)}, md5({_Q(t)}))' for k, t in enumerate(READ))}) x",
    "main_text": f"with {sql.PAGES}, {MAIN_TEXT} {MAIN_TEXT_ROWS}",
    "page_paragraphs": _unnest("pb", "docid", sql.paragraphs("b", ""), "paragraph").replace("select docid, unnest", f"with {sql.PAGES} select docid, unnest", 1),
    "page_metadata": _METADATA % "docid, url, title, abstract, published_date, content_hash",
    "display_metas": _METADATA % "docid, title, published_date",
    "abstracts": _METADATA % "docid, abstract",
    "content_hash": _METADATA % "docid, content_hash",
    "page_links": f"with {sql.PAGES} select distinct docid, {_ORIGIN} || h as link from (select docid, url, unnest(regexp_extract_all(s, {_Q('(?is)<a' + chr(92) + 'b[^>]*href=[' + chr(34) + chr(39) + ']([^' + chr(34) + chr(39) + ']*)', )}, 1)) as h from pg) where {part_sql('url', 2)} <> ''",
    "redirect_links": f"select k::bigint as docid, target from (values {_TARGETS}) x(k, target)",
    "redirect_prefilter": f"select file_id as docid from page_files where regexp_matches(lower(body), 'location\\.(href|replace)|http-equiv') union all select unnest({[k for k, _ in REDIRECT_PAGES]})::bigint",
    "scan_docs": "select docid, url, file from doc_map",
    "metadata_last_wins": "select url, record_no, title, abstract, published_date from page_metadata qualify row_number() over (partition by url order by record_no desc) = 1",
    "metadata_status": "select (count(*) - count(*) filter (f))::bigint as n_ok, count(*) filter (f) as n_failed from (select coalesce(title = url and coalesce(abstract, '') = '' and content_hash is null, false) as f from page_metadata)",
    "json_tolerant_scan": "select event_type, count(*) as n, count(*) filter (json_valid(props) and json_type(props) = 'OBJECT' and len(json_keys(props)) > 0) as n_objects from events group by event_type",
    "stopword_filter": f"select query_id, coalesce(array_to_string({sql.terms('text')}, ' '), '') as terms from queries",
    "index_files": "select url, file, entry_id from url_index where file is not null qualify row_number() over (partition by url order by entry_id desc) = 1",
    "doc_ids": "select row_number() over (order by e) - 1 as docid, url from (select url, min(entry_id) as e from url_index group by url)",
    "page_paths": f"select docid, {_HOST} || '/' || sha256(url) || '.html' as path from doc_map",
    "html_content_type": "select content_type, coalesce(lower(trim(split_part(content_type, ';', 1))) in ('text/html', 'application/xhtml+xml'), true) as is_page from (values ('text/html'), ('text/html; charset=gbk'), ('application/xhtml+xml'), ('TEXT/HTML'), ('application/pdf'), ('image/png'), (null)) x(content_type)",
    "page_title": f"select file_id, {sql.inner_text(f'regexp_extract({sql.without_code("body")}, {_Q("(?is)<title" + chr(92) + "b[^>]*>(.*?)</title" + chr(92) + "s*>")}, 1)')} as title from page_files",
    "page_headings": _unnest("page_files", "file_id", _HEADS, "heading"),
    "visible_text": f"select file_id, {sql.inner_text(f'regexp_extract({sql.without_code("body")}, {_Q(_BODY_RE)}, 1)')} as text from page_files",
    "clean_text": f"select result_id, {sql.clean('content')} as text from search_results",
    "tokenize": _unnest("page_metadata", "record_no", sql.tokens("title"), "token"),
    "normalize_terms": _unnest("page_metadata", "record_no", sql.terms("abstract"), "term"),
    "compact_text": f"select record_no, {sql.compact('title')} as compact from page_metadata",
    "term_occurrences": "select doc_id, ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), '学院', ''))) / 2)::bigint as n from documents",
    "chunks": _unnest("documents", "doc_id", "list_transform(range(0, length(text), 500), lambda k: substr(text, k + 1, 650))", "chunk"),
    "sentences": _unnest("documents", "doc_id", sql.sentences("text"), "sentence"),
    "dedup_sentences": f"select d.doc_id, case when d.text is null then null else coalesce(string_agg(s, chr(10) order by pos), '') end as text from documents d left join (select doc_id, s, pos from (select doc_id, unnest(a) as s, unnest(range(0, len(a))) as pos from (select doc_id, {sql.sentences('text')} as a from documents)) qualify row_number() over (partition by doc_id, replace({sql.fold('s')}, ' ', '') order by pos) = 1) x using (doc_id) group by d.doc_id, d.text",
    "query_entities": " union ".join(f"select of_ as of, ident, '{name}' as kind, unnest(regexp_extract_all(text, {_Q(p.replace('一-鿿', sql.HAN))}, 1)) as entity from (select 'title' as of_, record_no as ident, title as text from page_metadata where title is not null union all select 'query', query_id, text from queries where text is not null)" for name, p in ENTITIES.items()),
    "highlight": f"with r as (select result_id, title, list_sort(list_distinct(list_filter(string_split({sql.clean('q.text')}, ' '), lambda x: x <> ''))) as ws from search_results s join queries q using (query_id)), p as (select result_id, title, array_to_string(list_transform(list_sort(list_transform(ws, lambda w: (-length(w), w))), lambda t: regexp_replace(t[2], '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g')), '|') as pat from r) select result_id, replace(replace(replace(replace(replace(replace(replace(case when pat = '' then title else regexp_replace(title, '(' || pat || ')', chr(1) || '\\1' || chr(2), 'gi') end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '', '&#39;'), '\"', '&#34;'), chr(1), '<mark>'), chr(2), '</mark>') as html from p",
    "present_results": "with m as (select url, title, abstract from page_metadata qualify row_number() over (partition by url order by record_no desc) = 1) select result_id, query_id, rank_no, r.url, coalesce(m.title, r.url) as title, coalesce(m.abstract, '') as abstract from search_results r left join m on m.url = r.url",
    "canonical_urls": f"select docid, case when {part_sql('url', 2)} <> '' then lower({part_sql('url', 1)}) || '://' || lower({part_sql('url', 2)}) || case when {part_sql('url', 3)} = '' or (lower({part_sql('url', 1)}) = 'http' and {part_sql('url', 3)} = '80') or (lower({part_sql('url', 1)}) = 'https' and {part_sql('url', 3)} = '443') then '' else ':' || {part_sql('url', 3)} end || case when length(pp) > 1 then regexp_replace(pp, '/$', '') else pp end || case when len(a) > 0 then '?' || array_to_string(list_sort(list_transform(a, lambda p: {_form_sql("split_part(p, '=', 1)")} || '=' || {_form_sql("regexp_extract(p, '=(.*)$', 1)")})), '&') else '' end end as canonical from (select docid, url, regexp_replace(regexp_replace({part_sql('url', 4)}, '/{{2,}}', '/', 'g'), '/index\\.html$', '') as pp, list_filter(string_split({part_sql('url', 5)}, '&'), lambda x: x <> '') as a from doc_map)",
    "ignored_files": f"select url, regexp_matches(url_decode({part_sql('url', 4)}), {_Q(_SUFFIX)}) or len(list_filter(string_split({part_sql('url', 5)}, '&'), lambda p: regexp_matches(url_decode(regexp_extract(p, '=(.*)$', 1)), {_Q(_SUFFIX)}))) > 0 as ignored from (select url from doc_map union all select * from (values {_SAMPLES}) x(url))",
    "url_priority": f"select docid, (case when lower({part_sql('url', 1)}) = 'https' then 1 else 0 end + case when {part_sql('url', 5)} = '' then 1 else 0 end - len(list_filter(string_split({part_sql('url', 4)}, '/'), lambda x: x <> '')) + case when {part_sql('url', 4)} in ('', '/') then 2 else 0 end)::bigint as priority from doc_map",
    "host_counts": f"select {_HOST} as host, count(*) as n from url_index group by 1",
}
