"""Building contexts for a language model from search results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.functions.text import chunks, clean_text, distinct_sentences, fold, occurrences
from wherry.operators.retrieval import staged

# Heads of the pages of a context (number, title, url), and what is said where there is nothing.
FULL_HEAD = "[资料%d]\n标题：%s\nURL：%s\n正文："
SNIPPET_HEAD = "[文档%d]\n标题：%s\nURL：%s\n内容："
NO_SNIPPET = "暂无摘要"
NO_CONTEXT = "未检索到足够信息"
#: The text of the prompt around question and context.
PROMPT = "Answer the question from the material below; say so if it isn't there.\n\nQuestion: %s\n\nMaterial:\n%s"


def sub_queries(text: Column, rare: Column | None = None) -> Column:
    """Up to eight queries to search for a question: its quoted parts, names of teachers, years with the rest, its rarest terms (``rare``), and itself; without repetitions, in that order."""
    quoted = F.regexp_extract_all(text, F.lit("[“\"《]([^”\"》]{2,})[”\"》]"), F.lit(1))
    years = F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2})"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit("([一-鿿]{1,3}(?:老师|教授))"), F.lit(1))
    dated = F.transform(years, lambda y: F.concat(y, F.lit(" "), clean_text(F.replace(text, y, F.lit("")))))
    whole = F.concat(quoted, names, dated, F.array(F.coalesce(F.lit("") if rare is None else rare, F.lit("")), clean_text(text)))
    return F.slice(F.array_distinct(F.filter(whole, lambda q: q != "")), 1, 8)


def multi_search(results: DataFrame, k: int) -> DataFrame:
    """``query_id, docid, place``: results of sub-queries ``(query_id, subq, rank_no, docid)`` as one list.

    Distinct documents in order of first sight. Once there are ``max(10, 3 * k)``,
    each further sub-query adds one more at most; ``max(10, 4 * k)`` are the end. A
    fold in order over the results of one question.
    """
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("subq", "rank_no", "docid"))).alias("x"))
    start = F.struct(F.transform(F.slice("x", 1, 0), lambda y: y["docid"]).alias("d"), F.lit(None).cast(results.schema["subq"].dataType).alias("full"))

    def step(acc, x):
        new = F.array_append(acc["d"], x["docid"])
        taken = F.struct(new.alias("d"), F.when(F.size(new) >= max(10, 3 * k), x["subq"]).otherwise(acc["full"]).alias("full"))
        return F.when(F.array_contains(acc["d"], x["docid"]) | F.coalesce(acc["full"] == x["subq"], F.lit(False)), acc).otherwise(taken)

    found = staged(lists, "d", F.slice(F.aggregate("x", start, step)["d"], 1, max(10, 4 * k)))
    return found.select("query_id", F.posexplode("d").alias("place", "docid")).select("query_id", "docid", (F.col("place") + 1).alias("place"))


@dataclass(frozen=True)
class HopRule:
    """A second search: where a question holds all ``triggers``, group 1 of ``pattern`` in a title (of one of the question's years, if it names any) fills ``template``."""

    triggers: tuple[str, ...]
    pattern: str
    template: str


def hop_queries(questions: DataFrame, found: DataFrame, rule: HopRule) -> DataFrame:
    """``query_id, subq, text`` of the second searches: ``questions(query_id, text)``, ``found(query_id, place, title)``; names in order of first sight."""
    asked = questions.where(F.coalesce("text", F.lit("")).isNotNull() & F.forall(F.array(*map(F.lit, rule.triggers)).cast("array<string>"), lambda t: F.contains(F.coalesce("text", F.lit("")), t)))
    years = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"((?:19|20)\d{2})"), F.lit(1)))
    titled = asked.select("query_id", years.alias("y")).join(found.select("query_id", "place", clean_text(F.col("title")).alias("t")), "query_id")
    fit = titled.where((F.size("y") == 0) | F.exists("y", lambda y: F.contains("t", y)))
    names = fit.withColumn("name", F.regexp_extract("t", rule.pattern, 1)).where("name <> ''").groupBy("query_id", "name").agg(F.min("place").alias("p"))
    order = Window.partitionBy("query_id").orderBy("p", "name")
    return names.select("query_id", (F.row_number().over(order) - 1).alias("subq"), F.replace(F.lit(rule.template), F.lit("%s"), F.col("name")).alias("text"))


def splice(found: DataFrame, second: DataFrame, k: int, after: int = 5) -> DataFrame:
    """``query_id, docid, place``: the lists ``found(query_id, docid, place)`` with new documents of ``second(query_id, subq, rank_no, docid)`` put in behind the first ``after``, up to ``max(10, 4 * k)``."""
    first = second.groupBy("query_id", "docid").agg(F.min(F.struct("subq", "rank_no")).alias("o"))
    fresh = first.join(found.select("query_id", "docid"), ["query_id", "docid"], "left_anti").select("query_id", "docid", F.lit(1).alias("part"), F.col("o.subq").cast("long").alias("a"), F.col("o.rank_no").cast("long").alias("b"))
    old = found.select("query_id", "docid", F.when(F.col("place") <= after, 0).otherwise(2).alias("part"), F.col("place").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    order = Window.partitionBy("query_id").orderBy("part", "a", "b")
    return old.unionByName(fresh).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(10, 4 * k)).select("query_id", "docid", "place")


def _head(head: str, n: Column, title: Column, url: Column) -> Column:
    return F.format_string(head, n, title, url)


def snippet_merge(results: DataFrame, max_chars: int = 12_000, head: str = SNIPPET_HEAD) -> DataFrame:
    """``query_id, context``: numbered snippets (else contents) in rank order, cut to ``max_chars``.

    ``results(query_id, rank_no, url, title, snippet, content)``. Empty texts are left
    out, as are those that repeat the url or text of one taken before: a fold, as
    only what is taken counts.
    """
    text = clean_text(F.coalesce(F.nullif("snippet", F.lit("")), "content"))
    rows = results.select("query_id", "rank_no", F.trim(F.coalesce("url", F.lit(""))).alias("url"), clean_text(F.coalesce("title", F.lit(""))).alias("title"), text.alias("text")).where(F.coalesce("text", F.lit("")) != "")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "url", "title", "text"))).alias("x"))
    seen = lambda acc, x: F.exists(acc, lambda y: ((y["url"] == x["url"]) & (x["url"] != "")) | (y["text"] == x["text"]))
    taken = staged(lists, "t", F.aggregate("x", F.slice("x", 1, 0), lambda acc, x: F.when(seen(acc, x), acc).otherwise(F.array_append(acc, x))))
    parts = F.transform("t", lambda x, k: F.concat(_head(head, k + 1, x["title"], x["url"]), x["text"]))
    return taken.select("query_id", F.substring(F.array_join(parts, "\n\n"), 1, max_chars).alias("context"))


def best_chunks(results: DataFrame, terms: DataFrame, max_chars: int = 12_000, pages: int = 10) -> DataFrame:
    """``query_id, docid, chunk_no, score, chunk, place``: the chunks of each result that hold most of the query's terms.

    ``results(query_id, rank_no, docid, content, snippet)``, of which the first
    ``pages`` of a query count, ``terms(query_id, term)``. A result without content
    has its snippet instead; of repeated documents the first with text is taken. A
    chunk scores the sum of (length of term + 1) times its occurrences. The best
    fill a budget of ``max(700, max_chars // results - 180)`` characters a page,
    ties to the earlier one, the last cut to what is left.
    """
    ranked = results.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank_no", "docid"))).where(F.col("r") <= pages)
    sized = ranked.withColumn("budget", F.greatest(F.lit(700), F.floor(F.lit(max_chars) / F.count("*").over(Window.partitionBy("query_id"))).cast("int") - 180))
    texts = sized.withColumn("text", F.coalesce(F.nullif(clean_text(F.col("content")), F.lit("")), clean_text(F.col("snippet")))).where(F.coalesce("text", F.lit("")) != "")
    once = texts.groupBy("query_id", "docid", "budget").agg(F.min_by("text", "r").alias("text"))
    parts = once.select("query_id", "docid", "budget", F.posexplode(chunks(F.col("text"))).alias("chunk_no", "chunk"))
    words = terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    score = F.aggregate(F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda t: (F.length(t) + 1) * occurrences(F.lower("chunk"), t)), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = parts.join(words, "query_id", "left").withColumn("score", score)
    order = Window.partitionBy("query_id", "docid").orderBy(F.desc("score"), F.asc("chunk_no"))
    before = F.coalesce(F.sum(F.length("chunk")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = scored.withColumn("place", F.row_number().over(order)).withColumn("left", (F.col("budget") - before).cast("int")).where(F.col("left") > 0)
    return chosen.select("query_id", "docid", "chunk_no", "score", F.substring(F.col("chunk"), F.lit(1), F.col("left")).alias("chunk"), "place")


def full_merge(results: DataFrame, max_chars: int = 12_000, head: str = FULL_HEAD) -> DataFrame:
    """``query_id, context``: the pages' contents (else snippets) without repeated sentences, each within a fair share of what is left of ``max_chars``.

    ``results(query_id, rank_no, url, title, content, snippet)``, a bounded number per
    query. Pages without url or text, of a url seen before, or with the text of one
    before are left out. A fold in rank order: a page may take what remains divided
    by the pages to come, less its head and two characters.
    """
    ranked = results.select("query_id", "rank_no", clean_text("url").alias("url"), clean_text(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce(F.nullif(clean_text("content"), F.lit("")), clean_text("snippet")).alias("content")).where(F.coalesce("url", F.lit("")) != "")
    first = ranked.groupBy("query_id", "url").agg(F.min_by(F.struct("rank_no", "title", "content"), "rank_no").alias("r")).select("query_id", "url", "r.*").where(F.coalesce("content", F.lit("")) != "")
    pages = staged(first, "body", distinct_sentences(F.col("content")))
    once = pages.groupBy("query_id", F.regexp_replace(fold(F.col("body")), r"\s+", "").alias("_k")).agg(F.min_by(F.struct("rank_no", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "url", "body"), "rank_no").alias("p"))
    lists = once.groupBy("query_id").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def step(acc, x):
        n = acc["n"] + 1
        front = _head(head, n, x["title"], x["url"])
        budget = F.floor((F.lit(max_chars) - acc["used"]) / (F.size("p") - acc["n"])) - F.length(front) - 2
        piece = F.concat(front, F.substring(x["body"], F.lit(1), budget.cast("int")))
        ok = budget > 0
        used = F.when(ok, acc["used"] + F.length(piece) + 2).otherwise(acc["used"]).cast("int")
        return F.struct(n.alias("n"), used.alias("used"), F.when(ok, F.array_append(acc["parts"], piece)).otherwise(acc["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"))
    return lists.select("query_id", F.substring(F.array_join(F.aggregate("p", start, step)["parts"], "\n\n"), 1, max_chars).alias("context"))


def custom_integrator(results: DataFrame, terms: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """``query_id, context``: :func:`full_merge` of the :func:`best_chunks` of the first ten results (``query_id, rank_no, url, title, content, snippet``)."""
    lists = best_chunks(results.withColumn("docid", F.col("url")), terms, max_chars).groupBy("query_id", "docid").agg(F.array_sort(F.collect_list(F.struct("place", "chunk"))).alias("c"))
    first = results.groupBy("query_id", F.col("url").alias("docid")).agg(F.min("rank_no").alias("rank_no"), F.min_by("title", "rank_no").alias("title"))
    pages = lists.join(first, ["query_id", "docid"]).select("query_id", "rank_no", F.col("docid").alias("url"), "title", F.array_join(F.transform("c", lambda x: x["chunk"]), "\n").alias("content"), F.lit(None).cast("string").alias("snippet"))
    return full_merge(pages, max_chars)


INTEGRATORS: dict[str, Callable[..., DataFrame]] = {"snippet": snippet_merge, "full": full_merge, "custom": custom_integrator}


def integrate(strategy: str, *args, **kwargs) -> DataFrame:
    """The context by ``strategy``; an unknown one is a ValueError."""
    if strategy not in INTEGRATORS:
        raise ValueError(f"unknown strategy {strategy!r}; known are {sorted(INTEGRATORS)}")
    return INTEGRATORS[strategy](*args, **kwargs)


def prompts(questions: DataFrame, contexts: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """``query_id, prompt, answer``: the prompt of each question with a context, and a null answer; without one the answer ``NO_CONTEXT`` and no prompt."""
    joined = questions.join(contexts, "query_id", "left").withColumn("c", F.coalesce("context", F.lit("")))
    shown = F.format_string(prompt, F.coalesce("text", F.lit("")), F.col("c"))
    return joined.select("query_id", F.when(F.col("c") != "", shown).alias("prompt"), F.when(F.col("c") == "", NO_CONTEXT).alias("answer"))


def answers(asked: DataFrame, model: Callable[[str], str], attempts: int = 2, pause_s: float = 1.0, limit_s: float = 60.0) -> DataFrame:
    """``query_id, answer, seconds``: what ``model`` says to each prompt of :func:`prompts`.

    ``model`` is any function of one text, called on the executors; connection and
    time-out errors are tried again after ``pause_s``, up to ``attempts`` times. An
    answer that failed or took longer than ``limit_s`` is empty.
    """

    def one(prompt: str) -> tuple[str, float]:
        began = time.monotonic()
        for k in range(attempts):
            try:
                said = model(prompt).strip()
                took = time.monotonic() - began
                return (said if took <= limit_s else "", took)
            except (ConnectionError, TimeoutError):
                if k + 1 < attempts:
                    time.sleep(pause_s)
        return "", time.monotonic() - began

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [(a, 0.0) if p is None else one(p) for p, a in zip(batch["prompt"], batch["answer"], strict=True)]
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": [a for a, _ in said], "seconds": [s for _, s in said]})

    return asked.mapInPandas(run, "query_id long, answer string, seconds double")
