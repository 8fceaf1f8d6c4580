"""Queries on crawl frontiers and link graphs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.functions import urls
from wherry.operators import frontier
from wherry.plans import text_queries
from wherry.session import checkpoint, shared_folder
from wherry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
WAIT = 5.0


def frontier_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The doc map as frontier: url, host, priority, seq."""
    docs = table(spark, folder, "doc_map", "docid", "url")
    return docs.select("url", F.coalesce(urls.host(F.col("url")), F.lit("")).alias("host"), urls.priority(F.col("url")).cast("long").alias("priority"), F.col("docid").alias("seq"))


def seed_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """The start pages of all sites with host, priority and sequence, in the order of the hosts."""
    seeds = table(spark, folder, "sites", "host").select(F.concat(F.lit("https://"), F.lower("host"), F.lit("/")).alias("url"), F.lower("host").alias("ordinal"))
    return frontier.seed_rows(seeds)


def in_scope_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "url_index", "entry_id", "url").withColumn("host", urls.host(F.col("url")))
    return frontier.in_scope(rows, table(spark, folder, "sites", "host")).select("entry_id", "host")


def new_links(spark: SparkSession, folder: str) -> DataFrame:
    """Urls of the crawl log that the doc map lacks."""
    return frontier.new_links(table(spark, folder, "url_index", "url"), table(spark, folder, "doc_map", "url"))


def link_levels(spark: SparkSession, folder: str) -> DataFrame:
    """How many links away pages are from the first page of each query, along the order of results."""
    rows = table(spark, folder, "search_results", "query_id", "rank_no", "url")
    left, right = rows.alias("a"), rows.alias("b")
    links = left.join(right, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("b.rank_no") == F.col("a.rank_no") + 1)).select(F.col("a.url").alias("src"), F.col("b.url").alias("dst")).distinct()
    return frontier.bfs_levels(checkpoint(links), rows.where(F.col("rank_no") == 1).select("url"))


def recover_redirects(spark: SparkSession, folder: str) -> DataFrame:
    """New in-scope targets of redirects in saved pages, no files, with their priority as links of the page."""
    pages = text_queries.parsed_pages(text_queries.redirect_rows(spark, folder))
    found = pages.select(F.col("url").alias("source"), F.explode("p.redirects").alias("url")).where(~urls.is_ignored(F.col("url")))
    scored = found.groupBy("url").agg(F.max(urls.priority(F.col("url"), F.col("source"))).cast("long").alias("priority")).withColumn("host", urls.host(F.col("url")))
    fresh = frontier.in_scope(scored, table(spark, folder, "sites", "host"))
    return fresh.join(table(spark, folder, "doc_map", "url"), "url", "left_anti").select("url", "priority")


def all_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every link found, once, in sorted order: range partitions sorted on their own."""
    return text_queries.page_links(spark, folder).select("link").distinct().orderBy("link")


#: A small web: (url, final url, html), with a redirect, one out of scope, a failure (absent), a file and a loop.
WEB = [
    ("http://a.example/", "http://a.example/", '<a href="/1">1</a><a href="/2?x=1">2</a><a href="http://b.example/">b</a><a href="/f.pdf">f</a>'),
    ("http://a.example/1", "http://a.example/1", '<a href="/3">3</a><a href="/">up</a><script>location.href="/4/deep"</script>'),
    ("http://a.example/2?x=1", "http://b.example/moved", '<a href="/5">5</a>'),
    ("http://a.example/3", "http://c.example/out", '<a href="/6">6</a>'),
    ("http://b.example/", "http://b.example/", '<a href="http://a.example/7">7</a><a href="http://c.example/">c</a>'),
    ("http://b.example/5", "http://b.example/5", ""),
]


def crawl_demo(spark: SparkSession, folder: str, max_count: int = 20, batch: int = 4, order: str = "host", where: str | None = None) -> DataFrame:
    """``url, final_url, n_chars`` of the pages a crawl of ``WEB`` from its first page saves, in small rounds; stopped after three attempts and taken up again."""
    at = where or f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    hosts = spark.createDataFrame([("a.example",), ("b.example",)], "host string")
    web = spark.createDataFrame(WEB, "url string, final_url string, html string")
    seeds = spark.createDataFrame([("http://a.example/", 1), ("http://a.example/", 2), ("http://b.example/", 3)], "url string, ordinal long")

    def extract(pages: DataFrame) -> DataFrame:
        found = pages.select("url", text_queries.pages.parsed(F.col("html"), F.col("url")).alias("p"))
        return found.select(F.col("url").alias("source"), F.posexplode(F.concat("p.links", "p.redirects")).alias("ordinal", "url"))

    for most in (min(3, max_count), max_count):
        crawl = frontier.Crawl(spark, at, seeds, hosts, order)
        found = crawl.run(lambda turn: turn.join(web, "url"), extract, most, batch)
    return found.select("url", "final_url", F.length("html").alias("n_chars"))


QUERIES: dict[str, Query] = {
    "crawl_demo": crawl_demo,
    "seed_frontier": seed_frontier,
    "frontier_global_order": lambda s, d: frontier.global_order(frontier_rows(s, d)),
    "frontier_round_robin": lambda s, d: frontier.round_robin(frontier_rows(s, d)).select("url", "host", "round", "host_turn"),
    "fetch_schedule": lambda s, d: frontier.schedule(frontier_rows(s, d), WAIT),
    "in_scope_links": in_scope_links,
    "new_links": new_links,
    "link_levels": link_levels,
    "recover_redirects": recover_redirects,
    "all_links_sorted": all_links,
}

_ROWS = text_queries.ORACLES["url_priority"]
_F = f"f as (select d.url, coalesce({text_queries._HOST.replace('url', 'd.url')}, '') as host, x.priority, d.docid as seq from doc_map d join ({_ROWS}) x using (docid))"
_SAVED = ", ".join(f"('{u}', '{f}', {len(h)}::int)" for u, f, h in WEB if "c.example" not in f)
ORACLES = {
    "crawl_demo": f"select * from (values {_SAVED}) x(url, final_url, n_chars)",
    "recover_redirects": f"select target as url, 1::bigint as priority from ({text_queries.ORACLES['redirect_links']}) where target = 'https://math.yunpu-u.example/moved.htm' and 'math.yunpu-u.example' in (select host from sites)",
    "all_links_sorted": f"select distinct link from ({text_queries.ORACLES['page_links']})",
    "seed_frontier": "select url, host, (1 + 1 - 0 + 2)::bigint as priority, row_number() over (order by host) as seq from (select distinct 'https://' || lower(host) || '/' as url, lower(host) as host from sites)",
    "frontier_global_order": f"with {_F} select url, row_number() over (order by priority desc, seq) as turn from f",
    "frontier_round_robin": f"with {_F} select url, host, row_number() over (partition by host order by priority desc, seq)::int as round, min(seq) over (partition by host) as host_turn from f",
    "fetch_schedule": f"with {_F} select url, host, (row_number() over (partition by host order by priority desc, seq) - 1) * 5.0e0 as start_s from f",
    "in_scope_links": f"select entry_id, {text_queries._HOST} as host from url_index where {text_queries._HOST} in (select host from sites)",
    "new_links": "select distinct url from url_index where url not in (select url from doc_map)",
    "link_levels": "with recursive l as (select distinct a.url as src, b.url as dst from search_results a join search_results b on a.query_id = b.query_id and b.rank_no = a.rank_no + 1), w as (select distinct url, 0 as level from search_results where rank_no = 1 union select l.dst, w.level + 1 from w join l on l.src = w.url where w.level < (select count(*) from (select distinct url from search_results)) and not exists (select 1 from recurring.w p where p.url = l.dst)) select url, min(level) as level from w group by url",
}
