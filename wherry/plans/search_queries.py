"""Queries on index, retrieval, re-ranking, contexts and measures."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.functions import html, urls
from wherry.functions.text import clean_text
from wherry.operators import index, metrics, rag, retrieval
from wherry.operators.retrieval import FamilyRule
from wherry.plans import sql, text_queries
from wherry.session import checkpoint, shared_folder, written
from wherry.sources import jsonl
from wherry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
K = 20
#: Candidates of each query that re-ranking and selection see.
CANDIDATES = max(500, 25 * K)
#: Families of pages of which a strict selection takes few: the test site's video pages.
FAMILIES = [FamilyRule("ai.yunpu-u.example", "/addons/video/play.html", "play", 2), FamilyRule("ai.yunpu-u.example", "/addons/video/cate.html", "category", 1)]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with the title and abstract of its latest record and the headings of its file."""
    meta = index.last_wins(table(spark, folder, "page_metadata", "docid", "record_no", "title", "abstract", "published_date", "content_hash").where(F.col("docid").isNotNull()), "docid", "record_no").drop("record_no")
    heads = table(spark, folder, "page_files").select(F.col("file_id").alias("docid"), html.headings(F.col("body")).alias("headings"))
    rows = table(spark, folder, "doc_map", "docid", "url").repartition("docid").join(meta, "docid", "left").join(heads, "docid", "left")
    return rows.select("docid", "url", "title", F.coalesce("headings", F.array().cast("array<string>")).alias("headings"), F.col("abstract").alias("body"), "published_date", "content_hash")


@cache
def _code_version() -> str:
    """A hash of the code that an index depends on."""
    root = Path(__file__).resolve().parents[1]
    files = [*sorted((root / "functions").glob("*.py")), root / "operators/index.py", Path(__file__)]
    return hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:8]


def index_path(spark: SparkSession, folder: str) -> str:
    """Where the index that this code makes of these very tables lies: under the shared folder, named by hashes of both."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or shared_folder(spark)
    tables = jsonl.fingerprint(spark, [f"{folder}/{t}.parquet" for t in ("page_metadata", "page_files", "doc_map")])
    return f"{base}/wherry-index/{tables}-{_code_version()}"


class Engine:
    """The tables that searching needs: built and written once per state of the input tables, then read."""

    def __init__(self, spark: SparkSession, folder: str, queries: DataFrame | None = None, remake: bool = False) -> None:
        self.queries = table(spark, folder, "queries") if queries is None else queries

        path, n_docs = index_path(spark, folder), table(spark, folder, "doc_map").count()
        buckets = index.bucket_number(n_docs)

        def build(beside: str) -> None:
            shown = documents(spark, folder).withColumns({"key": F.coalesce(urls.canonical(F.col("url")), F.col("url")), "family": retrieval.family(F.col("url"), FAMILIES)})
            index.build(shown, beside, n_docs, buckets)

        tables = jsonl.load_or_build(spark, path, ["postings", "terms", "docs"], build, lambda path: index.load(spark, path, buckets), remake)
        self.terms, self.postings, self.docs = tables["terms"], tables["postings"], tables["docs"]
        self.lengths = self.docs.select("docid", "length")
        self.vectors = retrieval.query_vectors(self.queries, self.terms)

    def candidates(self, k: int = CANDIDATES) -> DataFrame:
        return retrieval.search(self.vectors, self.postings, self.lengths, k)

    def covered(self, k: int = CANDIDATES, more: DataFrame | None = None) -> DataFrame:
        fields = self.docs.select("docid", "title", "published_date", F.col("body").alias("abstract"))
        return retrieval.coverage(self.candidates(k), retrieval.rerank_terms(self.vectors), fields if more is None else fields.join(more, "docid", "left"))

    def reranked(self, k: int = CANDIDATES, more: DataFrame | None = None) -> DataFrame:
        return retrieval.rerank(self.covered(k, more))

    def groups(self) -> DataFrame:
        """``docid, key, hash, family``: numbers instead of a document's key and content hash, the least id of those that share it; null where it has none."""
        rows = self.docs.select("docid", "key", F.col("content_hash").alias("hash"), "family")
        for c in ("key", "hash"):
            least = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("docid").alias("_n"))
            rows = rows.join(least, c, "left").withColumn(c, F.col("_n")).drop("_n")
        return rows

    def lists(self, k: int = CANDIDATES) -> DataFrame:
        """One row a query: its re-ranked and guarded candidates as structs of docid, rank_no, key, hash and family."""
        return retrieval.guarded(retrieval.ranked_lists(self.reranked(k, self.groups()), "key", "hash", "family"))

    def keyed(self) -> DataFrame:
        """``query_id, rank_no, docid, key, hash, family`` of the re-ranked and guarded candidates."""
        return self.lists().select("query_id", F.posexplode("l").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank_no"), "x.docid", "x.key", "x.hash", "x.family")

    def service(self, k: int = K) -> DataFrame:
        """``query_id, place, docid, url, stage``: the whole search."""
        return retrieval.service(self.lists(max(500, 25 * k)), self.queries, self.docs, k, FAMILIES)


def _field_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return index.field_terms(documents(spark, folder)).groupBy("docid", "field", "term").agg(F.count("*").alias("n"))


def _invariants(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return index.violations(docs, index.postings(docs))


def _boolean(words: list[str], mode: str) -> Query:
    return lambda spark, folder: retrieval.boolean(index.postings(documents(spark, folder)), words, mode)


def _search(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, folder).candidates(K).select("query_id", "rank_no", "docid", F.round("score", 6).alias("score"))


def _guarded(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.guard_top(Engine(spark, folder).reranked()).select("query_id", "docid", "final_rank")


def _dedup(column: str) -> Query:
    """Re-ranked and guarded candidates without later ones that repeat a key; a null key repeats nothing."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = Engine(spark, folder).keyed().withColumn("alone", F.when(F.col(column).isNull(), F.col("docid")))
        return rows.groupBy("query_id", column, "alone").agg(F.min_by("docid", "rank_no").alias("docid"), F.min("rank_no").alias("rank_no")).select("query_id", "docid", "rank_no")

    return run


def _service(spark: SparkSession, folder: str) -> DataFrame:
    """The whole search: candidates, re-ranking with guard, strict and relaxed selection, filling to ``K``."""
    return Engine(spark, folder).service()


def _strict(spark: SparkSession, folder: str) -> DataFrame:
    chosen = retrieval.select_strict(Engine(spark, folder).lists(), K, FAMILIES)
    return chosen.select("query_id", F.posexplode("s").alias("place", "x")).select("query_id", "x.docid", (F.col("place") + 1).alias("place"))


def _relaxed(spark: SparkSession, folder: str) -> DataFrame:
    """What strict selection and the second pass without bounds of families take."""
    chosen = retrieval.select_relaxed(retrieval.select_strict(Engine(spark, folder).lists(), K, FAMILIES), K)
    return chosen.select("query_id", F.posexplode("r").alias("place", "x")).select("query_id", "x.docid", (F.col("place") + 1).alias("place"))


def _families(spark: SparkSession, folder: str) -> DataFrame:
    """How many pages each family of the doc map has."""
    rows = table(spark, folder, "doc_map", "url").select(retrieval.family(F.col("url"), FAMILIES).alias("family"))
    return rows.where(F.col("family").isNotNull()).groupBy("family").agg(F.count("*").alias("n"))


def _roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and sums of the index as it is read back from its files."""
    engine = Engine(spark, folder)
    counts = [engine.postings.groupBy(F.lit("postings").alias("name")).agg(F.count("*").alias("n"), F.sum("weighted_tf").alias("total")), engine.terms.select(F.lit("terms").alias("name"), "df").groupBy("name").agg(F.count("*").alias("n"), F.sum("df").alias("total")), engine.docs.groupBy(F.lit("docs").alias("name")).agg(F.count("*").alias("n"), F.sum("docid").alias("total"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, folder).covered().select("query_id", "docid", "rank_no", *(F.round(c, 6).alias(c) for c in ("title_share", "abstract_share", "document_share")))


def rare_terms(vectors: DataFrame, limit: int = 12) -> DataFrame:
    """``query_id, rank_no, term``: the rarest known terms of each query, of two characters or more."""
    rows = vectors.where(F.length("term") >= 2)
    return index.top_k(rows, "query_id", limit, F.desc(F.round("idf", 9)), F.desc("term")).select("query_id", "rank_no", "term")


def _rare_terms(spark: SparkSession, folder: str) -> DataFrame:
    return rare_terms(Engine(spark, folder).vectors)


def expanded(engine: Engine) -> DataFrame:
    """``query_id, subq, text``: the sub-queries of each query."""
    listed = rare_terms(engine.vectors, 8).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "term"))).alias("l"))
    rare = listed.select("query_id", F.array_join(F.transform("l", lambda x: x["term"]), " ").alias("rare"))
    rows = engine.queries.where(F.col("text").isNotNull()).join(rare, "query_id", "left")
    return rows.select("query_id", F.posexplode(rag.sub_queries(F.col("text"), F.col("rare"))).alias("subq", "text"))


def _expansion(spark: SparkSession, folder: str) -> DataFrame:
    return expanded(Engine(spark, folder))


#: Results that each sub-query asks for, and sub-queries a question can have.
TOP, SUBS = 5, 1000
#: Follow-up searches for the people that titles name as speakers.
HOP = rag.HopRule((), "([一-鿿](?:副教授|教授|研究员|院长|书记|主任|老师))谈", "%s讲座")


#: Distinct texts that are searched at once, and results whose texts are merged at once: so many, or one for every so many documents.
TEXTS_AT_ONCE, DOCS_A_TEXT = 8_000, 40
RESULTS_AT_ONCE, DOCS_A_RESULT = 25_000, 6


def in_parts(key: Column, n: int, most: int) -> list[Column]:
    """Conditions that split ``n`` rows into parts of about ``most`` each, whole by ``key``; null is a key."""
    parts = max(1, -(-n // most))
    return [F.pmod(F.xxhash64(key), F.lit(parts)) == p for p in range(parts)]


def searched(spark: SparkSession, folder: str, asked: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, subq, rank_no, docid`` of the search service for each sub-query ``asked(query_id, subq, text)``.

    Each text is searched once, however many ask it. Of the texts a part is searched at a
    time and its results are written, so that the candidates of one part alone take disk.
    """
    lost = F.col("query_id").isNull().alias("_lost")
    asked = written(asked)
    texts = written(asked.groupBy("text", lost).agg(F.min(F.col("query_id") * SUBS + F.col("subq")).alias("query_id")))
    most = max(TEXTS_AT_ONCE, table(spark, folder, "doc_map").count() // DOCS_A_TEXT)
    found = [written(Engine(spark, folder, texts.where(part).select("query_id", "text")).service(k).select("query_id", "place", "docid")) for part in in_parts(F.col("text"), texts.count(), most)]
    named = asked.withColumn("_lost", lost).alias("a").join(texts.select("text", "_lost", F.col("query_id").alias("_id")).alias("t"), F.expr("a.text <=> t.text and a._lost = t._lost")).select("query_id", "subq", "_id")
    hits = reduce(DataFrame.unionByName, found).select(F.col("query_id").alias("_of"), F.col("place").alias("rank_no"), "docid")
    return named.join(hits, F.col("_id").eqNullSafe(F.col("_of"))).select("query_id", F.col("subq").cast("long").alias("subq"), "rank_no", "docid")


def multi_searched(spark: SparkSession, folder: str) -> DataFrame:
    """``query_id, docid, place``: all sub-queries of each query searched and united, with the follow-up searches of ``HOP`` put in."""
    engine = Engine(spark, folder)
    first = checkpoint(rag.multi_search(searched(spark, folder, expanded(engine)), TOP))
    titled = first.join(engine.docs.select("docid", "title"), "docid")
    second = checkpoint(searched(spark, folder, rag.hop_queries(engine.queries, titled, HOP)))
    return rag.splice(first, second, TOP)


def main_texts(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``docid, content``: the main text of the saved pages among ``wanted(docid)``."""
    pages = text_queries.bare_pages(spark, folder).join(wanted.select("docid").distinct(), "docid", "left_semi")
    return text_queries.parsed_pages(pages).select("docid", F.col("p.content").alias("content"))


def with_texts(spark: SparkSession, folder: str, found: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """``query_id, rank_no, docid, url, title, snippet, content`` of ``found(query_id, docid, place)``: title and abstract of the latest record, main text of the saved page (of ``contents``, if they are at hand)."""
    docs = Engine(spark, folder).docs.select("docid", "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), F.coalesce(F.nullif("body", F.lit("")), F.lit(rag.NO_SNIPPET)).alias("snippet"))
    wanted = written(found.join(docs, "docid"))
    content = main_texts(spark, folder, wanted) if contents is None else contents
    return wanted.join(content, "docid", "left").select("query_id", F.col("place").alias("rank_no"), "docid", "url", "title", "snippet", F.coalesce("content", F.lit("")).alias("content"))


def _rag_search(spark: SparkSession, folder: str) -> DataFrame:
    return with_texts(spark, folder, Engine(spark, folder).service().select("query_id", "docid", "place")).drop("docid")


def _multi(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded results of five neighbouring queries as sub-queries of one question."""
    rows = table(spark, folder, "search_results", "query_id", "rank_no", "url").select(F.floor(F.col("query_id") / 5).alias("query_id"), (F.col("query_id") % 5).alias("subq"), "rank_no", F.col("url").alias("docid"))
    return rag.multi_search(rows, 5).select("query_id", F.col("docid").alias("url"), "place")


def _rag_results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_results", "query_id", "rank_no", "url", "title", "snippet", "content")


def _best_chunks(spark: SparkSession, folder: str) -> DataFrame:
    results = _rag_results(spark, folder).withColumnRenamed("url", "docid")
    terms = rare_terms(Engine(spark, folder).vectors)
    return rag.best_chunks(results, terms).select("query_id", F.col("docid").alias("url"), "chunk_no", "score", F.length("chunk").alias("chars"))


def _custom(spark: SparkSession, folder: str) -> DataFrame:
    return rag.integrate("custom", _rag_results(spark, folder), rare_terms(Engine(spark, folder).vectors))


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    """From question to prompt: expansion, searches, follow-up searches, contents, custom integration.

    Pages are parsed once; then the questions are handled part by part, so that the texts of one part alone are shuffled at a time.
    """
    engine = Engine(spark, folder)
    found, terms = written(multi_searched(spark, folder)), rare_terms(engine.vectors)
    contents = written(main_texts(spark, folder, found))
    most = max(RESULTS_AT_ONCE, engine.docs.count() // DOCS_A_RESULT)
    asked = []
    for part in in_parts(F.col("query_id"), found.count(), most):
        results = with_texts(spark, folder, found.where(part), contents)
        asked.append(written(rag.prompts(engine.queries.where(part), rag.integrate("custom", results, terms.where(part)))))
    return reduce(DataFrame.unionByName, asked)


def _known_items(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of the recorded results, each query's most often returned page being the relevant one."""
    results = table(spark, folder, "search_results", "query_id", "rank_no", "url").withColumnRenamed("url", "docid")
    popular = results.groupBy("docid").agg(F.count("*").alias("n"))
    wanted = results.join(popular, "docid").groupBy("query_id").agg(F.min_by("docid", F.struct(-F.col("n"), F.col("docid"))).alias("docid"))
    best = results.groupBy("query_id", "docid").agg(F.min("rank_no").alias("rank_no"))
    return metrics.ranking_metrics(best, wanted, table(spark, folder, "queries"))


def _timeouts(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of more than sixty units count as unanswered."""
    events = table(spark, folder, "events", "event_type", "value")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("n_late"))


QUERIES: dict[str, Query] = {
    "field_term_counts": _field_term_counts,
    "postings_build": lambda s, d: index.postings(documents(s, d)),
    "term_idf": lambda s, d: Engine(s, d).terms.select("term", "df", F.round("idf", 9).alias("idf")),
    "doc_norms": lambda s, d: Engine(s, d).lengths.select("docid", F.round("length", 6).alias("length")),
    "boolean_postings": lambda s, d: index.postings(documents(s, d)).select("term", "docid"),
    "index_invariants": _invariants,
    "bool_term": _boolean(["论坛"], "or"),
    "bool_and": _boolean(["讲座", "报告"], "and"),
    "bool_or": _boolean(["讲座", "论坛", "forum"], "or"),
    "query_vectors": lambda s, d: Engine(s, d).vectors.select("query_id", "term", F.round("qweight", 9).alias("qweight")),
    "dot_products": lambda s, d: retrieval.dot_products(*(lambda e: (e.vectors, e.postings))(Engine(s, d)), 6),
    "cosine_scores": lambda s, d: retrieval.cosine(*(lambda e: (e.vectors, e.postings, e.lengths))(Engine(s, d)), 6),
    "search_tfidf": _search,
    "candidates": lambda s, d: Engine(s, d).candidates().select("query_id", "docid", "rank_no"),
    "rerank_terms": lambda s, d: retrieval.rerank_terms(Engine(s, d).vectors).select("query_id", "term", "compact_term"),
    "coverage_features": _coverage,
    "rerank": lambda s, d: Engine(s, d).reranked().select("query_id", "docid", "rank_no", "new_rank"),
    "rerank_guarded": _guarded,
    "dedup_content": _dedup("hash"),
    "dedup_canonical": _dedup("key"),
    "select_strict": _strict,
    "select_relaxed": _relaxed,
    "url_family": _families,
    "index_roundtrip": _roundtrip,
    "search_service": _service,
    "rare_terms": _rare_terms,
    "query_expansion": _expansion,
    "multi_search": _multi,
    "snippet_merge": lambda s, d: rag.snippet_merge(_rag_results(s, d)),
    "full_merge": lambda s, d: rag.full_merge(_rag_results(s, d)),
    "best_chunks": _best_chunks,
    "custom_merge": _custom,
    "rag_search": _rag_search,
    "second_hop": lambda s, d: multi_searched(s, d),
    "rag_prompts": _prompts,
    "ranking_metrics": _known_items,
    "latency_stats": lambda s, d: metrics.latency(table(s, d, "events"), "event_type", "value"),
    "run_timeouts": _timeouts,
}

_K = "coalesce(k, 'doc:' || docid)"
_FAMILY = "case " + " ".join(f"when {text_queries.host_sql('d.url')} = '{r.host}' and ends_with({text_queries.part_sql('d.url', 4)}, '{r.suffix}') then '{r.name}'" for r in FAMILIES) + " end"
_GUARD = f"""{sql.RERANKED},
g0 as (select query_id, list(docid order by new_rank) as l, max(docid) filter (rank_no = 1) as f1, max(docid) filter (rank_no = 2) as f2, max(docid) filter (rank_no = 3) as f3 from ranked group by query_id)"""
for _r in (3, 2, 1):
    _o = f"list_filter(l, lambda x: x <> f{_r})"
    _GUARD += f", g{4 - _r} as (select query_id, f1, f2, f3, case when f{_r} is not null and list_position(l, f{_r}) > {_r + 2} then list_concat(list_concat({_o}[1:{_r + 1}], [f{_r}]), {_o}[{_r + 2}:]) else l end as l from g{3 - _r})"
_GUARD += ", gr as (select query_id, unnest(l) as docid, unnest(range(1, len(l) + 1)) as i from g3)"
_FULL = " and ".join(f"not (coalesce(kk.family, '') = '{r.name}' and len(list_filter(fs, lambda x: x = '{r.name}')) >= {r.most})" for r in FAMILIES)


def _fold(name: str, start: str, ok: str) -> str:
    """A fold over the guarded candidates of each query: arrays of accepted docids, keys, hashes and families."""
    take = lambda array, value: f"case when ok then list_append({array}, {value}) else {array} end"
    return f"""{name}_all as (
  {start}
  union all
  select f.query_id, f.ki, {take("ks", "key")}, case when ok and hash is not null then list_append(hs, hash) else hs end, {take("ds", "docid")}, {take("fs", "coalesce(family, '')")}
  from (select f.*, kk.i as ki, kk.docid, kk.key, kk.hash, kk.family, not list_contains(ds, kk.docid) and not list_contains(ks, kk.key) and not coalesce(list_contains(hs, kk.hash), false) and {ok} as ok from {name}_all f join kk on kk.query_id = f.query_id and kk.i = f.i + 1 where len(f.ds) < {K}) f),
{name} as (select * from {name}_all qualify row_number() over (partition by query_id order by i desc) = 1)"""


_KEYED = f"""{_GUARD},
keys as ({text_queries.ORACLES["canonical_urls"]}),
kk as (select r.query_id, r.docid, r.i, d.url, coalesce(k.canonical, d.url) as key, d.content_hash as hash, {_FAMILY} as family from gr r join docs d using (docid) left join keys k using (docid))"""
_STRICT = f"""{_KEYED},
{_fold("strict", "select distinct query_id, 0::bigint as i, []::varchar[] as ks, []::varchar[] as hs, []::bigint[] as ds, []::varchar[] as fs from kk", _FULL)}"""
_RELAXED = f"""{_STRICT},
{_fold("relaxed", "select query_id, 0::bigint as i, ks, hs, ds, fs from strict", "true")}"""
_SERVICE = f"""{_RELAXED},
st as (select query_id, unnest(ds) as docid, unnest(range(1, len(ds) + 1)) as o, 2 as stage from relaxed
  union all select query_id, docid, i, 3 from kk where (query_id, docid) not in (select (query_id, unnest(ds)) from relaxed)
  union all select q.query_id, d.docid, d.docid, 4 from queries q, docs d where d.docid < {2 * K} and (q.query_id, d.docid) not in (select (query_id, docid) from kk)),
sv as (select query_id, docid, row_number() over (partition by query_id order by stage, o)::int as place, stage from st qualify place <= {K}),
service as (select sv.query_id, place, sv.docid, d.url, case when stage = 2 and place <= coalesce(len(s.ds), 0) then 1 else stage end as stage from sv join docs d using (docid) left join strict s using (query_id))"""
_CHUNKS = f"""
rk as (select query_id, url, content, snippet, row_number() over (partition by query_id order by rank_no, url) as r from search_results qualify r <= 10),
rz as (select *, greatest(700, 12000 // count(*) over (partition by query_id) - 180) as budget, coalesce(nullif({sql.clean("content")}, ''), {sql.clean("snippet")}) as c from rk),
ro as (select query_id, url, any_value(budget) as budget, arg_min(c, r) as c from rz where coalesce(c, '') <> '' group by query_id, url),
ch as (select query_id, url, budget, unnest(range(0, len(a)))::int as chunk_no, unnest(a) as chunk from (select query_id, url, budget, list_transform(range(0, length(c), 500), lambda k: substr(c, k + 1, 650)) as a from ro)),
rt12 as (select query_id, list(term) as ts from (select query_id, term from v where length(term) >= 2 qualify row_number() over (partition by query_id order by round(idf, 9) desc, term desc) <= 12) group by query_id),
sc as (select ch.*, coalesce(list_sum(list_transform(ts, lambda w: (length(w) + 1) * ((length(lower(chunk)) - length(replace(lower(chunk), w, ''))) // length(w)))), 0)::bigint as score from ch left join rt12 using (query_id)),
chosen as (select *, row_number() over o as place, budget - coalesce(sum(length(chunk)) over (partition by query_id, url order by score desc, chunk_no rows between unbounded preceding and 1 preceding), 0) as rest from sc window o as (partition by query_id, url order by score desc, chunk_no))
"""
_METRICS = """
with popular as (select url, count(*) as n from search_results group by url),
w as (select query_id, arg_min(url, (-n, url)) as url from search_results join popular using (url) group by query_id),
b as (select query_id, url, min(rank_no) as r from search_results group by all),
h as (select w.query_id, b.r from w join b using (query_id, url) where b.r <= 20),
e as (select q.query_id, h.r, w.url from queries q left join w using (query_id) left join h using (query_id))
select round(avg(coalesce(1.0e0 / r, 0)), 6) as mrr, round(avg(case when r <= 1 then 1.0e0 else 0 end), 6) as hit_1, round(avg(case when r <= 3 then 1.0e0 else 0 end), 6) as hit_3, round(avg(case when r <= 5 then 1.0e0 else 0 end), 6) as hit_5, round(avg(case when r <= 10 then 1.0e0 else 0 end), 6) as hit_10, round(avg(case when r <= 20 then 1.0e0 else 0 end), 6) as hit_20,
round(avg(case when r is not null then 1.0e0 else 0 end), 6) as recall, round(avg(case when r is not null then 1 / 20.0e0 else 0 end), 6) as "precision", round(avg(coalesce(1.0e0 / r, 0)), 6) as map_score, round(avg(coalesce(1 / log2(r + 1), 0)), 6) as ndcg from e
"""
#: Contexts of ``pages(query_id, url, rank_no, title, content)`` as ``merged(query_id, context)``.
_FULL_MERGE = f"""
f1 as (select query_id, {sql.clean("url")} as url, rank_no, {sql.clean("coalesce(title, '')")} as title, {sql.clean("content")} as content from pages qualify row_number() over (partition by query_id, {sql.clean("url")} order by rank_no) = 1),
fs as (select query_id, url, unnest(a) as s, unnest(range(0, len(a))) as pos from (select query_id, url, {sql.sentences("content")} as a from f1 where coalesce(content, '') <> '' and url <> '')),
fd as (select query_id, url, string_agg(s, chr(10) order by pos) as body from (select * from fs qualify row_number() over (partition by query_id, url, replace({sql.fold("s")}, ' ', '') order by pos) = 1) group by query_id, url),
fo as (select query_id, url, rank_no, coalesce(nullif(title, ''), url) as title, body from f1 join fd using (query_id, url) qualify row_number() over (partition by query_id, regexp_replace({sql.fold("body")}, '\\s+', '', 'g') order by rank_no) = 1),
fp as (select *, row_number() over (partition by query_id order by rank_no) as i, count(*) over (partition by query_id) as n from fo),
fold as (select distinct query_id, 0::bigint as i, 0::bigint as used, []::varchar[] as parts from fp
  union all
  select query_id, i, case when budget > 0 then used + length(head) + least(length(body), budget) + 2 else used end, case when budget > 0 then list_append(parts, head || substr(body, 1, budget)) else parts end
  from (select fold.query_id, fp.i, used, parts, body, '[资料' || fp.i || ']' || chr(10) || '标题：' || title || chr(10) || 'URL：' || url || chr(10) || '正文：' as head, (12000 - used) // (n - fold.i) - length('[资料' || fp.i || ']' || chr(10) || '标题：' || title || chr(10) || 'URL：' || url || chr(10) || '正文：') - 2 as budget from fold join fp on fp.query_id = fold.query_id and fp.i = fold.i + 1)),
merged as (select query_id, substr(array_to_string(parts, chr(10) || chr(10)), 1, 12000) as context from fold qualify row_number() over (partition by query_id order by i desc) = 1)
"""
_MULTI = """
ordered as (select query_id // 5 as query_id, query_id % 5 as subq, url, row_number() over (partition by query_id // 5 order by query_id % 5, rank_no, url) as i from search_results),
folded as (select distinct query_id, 0::bigint as i, []::varchar[] as ds, -1::bigint as full_at from ordered
  union all
  select f.query_id, o.i, case when list_contains(ds, o.url) or full_at = o.subq then ds else list_append(ds, o.url) end, case when not list_contains(ds, o.url) and full_at <> o.subq and len(ds) + 1 >= 15 then o.subq else full_at end
  from folded f join ordered o on o.query_id = f.query_id and o.i = f.i + 1)
"""
_SNIPPETS = f"""
sn as (select query_id, trim(coalesce(url, '')) as url, {sql.clean("coalesce(title, '')")} as title, {sql.clean("coalesce(nullif(snippet, ''), content)")} as t, rank_no from search_results),
so as (select *, row_number() over (partition by query_id order by rank_no, url, title, t) as i from sn where coalesce(t, '') <> ''),
taken as (select distinct query_id, 0::bigint as i, []::varchar[] as ts, []::varchar[] as us, []::varchar[] as hs from so
  union all
  select k.query_id, o.i, case when seen then ts else list_append(ts, t) end, case when seen then us else list_append(us, url) end, case when seen then hs else list_append(hs, title) end
  from (select k.*, o.i as oi, o.t, o.url, o.title, (url <> '' and list_contains(us, url)) or list_contains(ts, t) as seen from taken k join so o on o.query_id = k.query_id and o.i = k.i + 1) k, lateral (select k.oi as i) o)
"""
ORACLES = {
    "field_term_counts": f"with {sql.INDEX} select docid, field, term, count(*) as n from ft group by all",
    "postings_build": f"with {sql.INDEX} select docid, term, tf, weighted_tf from p",
    "term_idf": f"with {sql.INDEX} select term, df, round(idf, 9) as idf from t",
    "doc_norms": f"with {sql.INDEX} select docid, round(length, 6) as length from l",
    "boolean_postings": f"with {sql.INDEX} select term, docid from p",
    "index_invariants": f"with {sql.INDEX} select 'dense_ids' as rule, max(docid) + 1 - count(distinct docid) as n from docs union all select 'unique_postings', count(*) from (select docid, term from p group by all having count(*) > 1) union all select 'positive_counts', count(*) from p where tf < 1 or weighted_tf < tf union all select 'known_documents', count(*) from p where docid not in (select docid from docs)",
    "bool_term": f"with {sql.INDEX} select distinct docid from p where term = '论坛'",
    "bool_and": f"with {sql.INDEX} select docid from p where term = '讲座' intersect select docid from p where term = '报告'",
    "bool_or": f"with {sql.INDEX} select distinct docid from p where term in ('讲座', '论坛', 'forum')",
    "query_vectors": f"with {sql.VECTORS} select query_id, term, round(qweight, 9) as qweight from v",
    "dot_products": f"with {sql.SCORES} select query_id, docid, round(dot, 6) as dot from dp",
    "cosine_scores": f"with {sql.SCORES} select query_id, docid, round(score, 6) as score from s",
    "search_tfidf": f"with {sql.SCORES} select query_id, rank_no::int as rank_no, docid, round(score, 6) as score from c where rank_no <= 20",
    "candidates": f"with {sql.SCORES} select query_id, docid, rank_no::int as rank_no from c where rank_no <= 500",
    "rerank_terms": f"with {sql.VECTORS} select query_id, term, {sql.compact('term')} as compact_term from v where length({sql.compact('term')}) >= 2",
    "coverage_features": f"with {sql.RERANKED} select query_id, docid, rank_no::int as rank_no, round(title_share, 6) as title_share, round(abstract_share, 6) as abstract_share, round(document_share, 6) as document_share from ranked",
    "rerank": f"with {sql.RERANKED} select query_id, docid, rank_no::int as rank_no, new_rank::int as new_rank from ranked",
    "dedup_content": f"with recursive {_KEYED} select query_id, docid, i::int as rank_no from (select *, hash as k from kk) qualify row_number() over (partition by query_id, {_K} order by i) = 1",
    "dedup_canonical": f"with recursive {_KEYED} select query_id, docid, i::int as rank_no from kk qualify row_number() over (partition by query_id, key order by i) = 1",
    "rerank_guarded": f"with {_GUARD} select query_id, docid, i::int as final_rank from gr",
    "select_strict": f"with recursive {_STRICT} select query_id, unnest(ds) as docid, unnest(range(1, len(ds) + 1))::int as place from strict",
    "select_relaxed": f"with recursive {_RELAXED} select query_id, unnest(ds) as docid, unnest(range(1, len(ds) + 1))::int as place from relaxed",
    "search_service": f"with recursive {_SERVICE} select query_id, place, docid, url, stage from service",
    "url_family": f"select family, count(*) as n from (select {_FAMILY} as family from doc_map d) where family is not null group by family",
    "index_roundtrip": f"with {sql.INDEX} select 'postings' as name, count(*) as n, sum(weighted_tf)::bigint as total from p union all select 'terms', count(*), sum(df)::bigint from t union all select 'docs', count(*), sum(docid)::bigint from docs",
    "best_chunks": f"with {sql.VECTORS}, {_CHUNKS} select query_id, url, chunk_no, score, least(length(chunk), rest)::int as chars from chosen where rest > 0",
    "custom_merge": f"with recursive {sql.VECTORS}, {_CHUNKS}, rs as (select query_id, url, min(rank_no) as rank_no, arg_min(title, rank_no) as title from search_results group by query_id, url), pages as (select query_id, url, rank_no, title, (select string_agg(substr(chunk, 1, rest::bigint), chr(10) order by place) from chosen c where c.query_id = rs.query_id and c.url = rs.url and rest > 0) as content from rs), {_FULL_MERGE} select query_id, context from merged",
    "full_merge": f"with recursive pages as (select query_id, url, rank_no, title, coalesce(nullif({sql.clean('content')}, ''), {sql.clean('snippet')}) as content from search_results), {_FULL_MERGE} select query_id, context from merged",
    "query_expansion": f"with {sql.VECTORS}, rare as (select query_id, string_agg(term, ' ' order by k) as rare from (select query_id, term, row_number() over (partition by query_id order by round(idf, 9) desc, term desc) as k from v where length(term) >= 2) where k <= 8 group by query_id), e as (select q.query_id, list_filter(list_concat(regexp_extract_all(text, '[“\"《]([^”\"》]{{2,}})[”\"》]', 1), regexp_extract_all(text, '([{sql.HAN}]{{1,3}}(?:老师|教授))', 1), list_transform(regexp_extract_all(text, '((?:19|20)\\d{{2}})', 1), lambda y: y || ' ' || {sql.clean("replace(text, y, '')")}), [coalesce(rare, ''), {sql.clean('text')}]), lambda x: x <> '') as a from queries q left join rare using (query_id) where text is not null), d as (select query_id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:8] as a from e) select query_id, unnest(range(0, len(a)))::int as subq, unnest(a) as text from d",
    "rag_search": f"with recursive {_SERVICE}, {sql.PAGES}, {text_queries.MAIN_TEXT}, texts as ({text_queries.MAIN_TEXT_ROWS}) select s.query_id, s.place as rank_no, s.url, coalesce(nullif(d.title, ''), d.url) as title, coalesce(nullif(d.body, ''), '{rag.NO_SNIPPET}') as snippet, coalesce(t.text, '') as content from service s join docs d using (docid) left join texts t using (docid)",
    "rare_terms": f"with {sql.VECTORS} select query_id, row_number() over (partition by query_id order by round(idf, 9) desc, term desc)::int as rank_no, term from v where length(term) >= 2 qualify rank_no <= 12",
    "multi_search": f"with recursive {_MULTI} select query_id, unnest(ds[1:20]) as url, unnest(range(1, least(len(ds), 20) + 1))::int as place from (select * from folded qualify row_number() over (partition by query_id order by i desc) = 1)",
    "snippet_merge": f"with recursive {_SNIPPETS} select query_id, substr(array_to_string(list_transform(ts, lambda x, i: '[文档' || i || ']' || chr(10) || '标题：' || hs[i] || chr(10) || 'URL：' || us[i] || chr(10) || '内容：' || x), chr(10) || chr(10)), 1, 12000) as context from (select * from taken qualify row_number() over (partition by query_id order by i desc) = 1)",
    "ranking_metrics": _METRICS,
    "latency_stats": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as longest from events group by event_type",
    "run_timeouts": "select event_type, count(*) as n, count(*) filter (value > 60) as n_late from events group by event_type",
}
