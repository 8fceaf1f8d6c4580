"""Building an inverted index with field weights as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wherry.functions.text import STOPWORDS, tokens
from wherry.sources.jsonl import read_bucketed, write_bucketed, write_index
from wherry.operators.skew import hot_threshold, join_by_frequency
from wherry.session import checkpoint, forget_shuffles

#: Weight of a term's occurrence in each field.
FIELD_WEIGHTS = {"title": 3, "heading": 2, "body": 1}


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 0 in ``order``, without a single-task sort.

    Range partitions are sorted on their own; the number in the partition is
    shifted by the sizes of the earlier partitions, of which only one count each
    reaches the driver. The sorted rows are checkpointed so that both reads agree.
    """
    ranged = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    shift = rows.sparkSession.createDataFrame(offsets, "_p long, _shift long")
    return ranged.withColumn("_p", part).join(F.broadcast(shift), "_p").withColumn(name, F.col("_shift") + within).drop("_at", "_p", "_shift")


def field_terms(docs: DataFrame, tokenizer=tokens, stopwords: list[str] | DataFrame = STOPWORDS) -> DataFrame:
    """``docid, field, term``, one row per occurrence, of ``docs(docid, title, headings, body)``; null fields have none, a document with only nulls stays out.

    ``tokenizer`` maps a text column to an array of terms; ``stopwords`` is a list, or
    a table with the column ``word`` (see ``sources.jsonl.read_words``) of any size.
    """
    fields = F.array(*(tokenizer(x) for x in (F.col("title"), F.array_join("headings", " "), F.col("body"))))
    by_field = docs.select("docid", F.posexplode(fields).alias("k", "terms"))
    rows = by_field.select("docid", F.element_at(F.array(*map(F.lit, FIELD_WEIGHTS)), F.col("k") + 1).alias("field"), F.explode("terms").alias("term"))
    if isinstance(stopwords, DataFrame):
        return rows.join(stopwords.select(F.col("word").alias("term")), "term", "left_anti").select("docid", "field", "term")
    return rows.where(~F.col("term").isin(*stopwords))


def postings(docs: DataFrame, tokenizer=tokens, stopwords: list[str] | DataFrame = STOPWORDS) -> DataFrame:
    """``docid, term, tf, weighted_tf``; one shuffle, with partial sums."""
    weight = F.lit(0)
    for field, w in FIELD_WEIGHTS.items():
        weight = F.when(F.col("field") == field, w).otherwise(weight)
    return field_terms(docs, tokenizer, stopwords).groupBy("docid", "term").agg(F.count("*").alias("tf"), F.sum(weight).alias("weighted_tf"))


#: Postings that a bucket of the index holds on average, and the least and greatest number of buckets (Spark allows no more).
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 12, 100_000


def bucket_number(n_docs: int, terms_per_doc: int = 100) -> int:
    """How many buckets an index of so many documents has: as few as tasks bear, as each hands on the best candidates of every query."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n_docs * terms_per_doc // BUCKET_ROWS)))


def build(docs: DataFrame, path: str, n_docs: int, buckets: int) -> None:
    """Writes the index of ``docs`` to the folder ``path``: ``postings`` (``term, docid, tf, weighted_tf``), ``terms`` and, last, ``docs`` with their ``length``.

    ``n_docs`` is the number of documents, counting those without terms. Postings and
    documents lie in ``buckets`` by docid, postings sorted by term in each: what a query
    adds up per document is added up where it lies, and only each bucket's best reach a
    shuffle; a list of terms still prunes row groups. Documents are shuffled once, before
    their terms are counted. Postings hold counts alone: a weight is a term's idf
    times a function of the count, and the idf is at hand wherever weights are summed.
    """
    spark = docs.sparkSession
    placed = docs.repartition(buckets, "docid")
    write_bucketed(postings(placed), path, "postings", buckets, ["term", "docid"])
    counted = read_bucketed(spark, path, "postings", buckets, ["term", "docid"])
    write_index({"terms": term_statistics(counted, n_docs)}, path)
    forget_shuffles(spark)
    lengths = norms(placed, weigh(counted, spark.read.parquet(f"{path}/terms"), counted.count()))
    write_bucketed(placed.join(lengths, "docid"), path, "docs", buckets, ["docid"])
    forget_shuffles(spark)


def load(spark: SparkSession, path: str, buckets: int) -> dict[str, DataFrame]:
    """The tables of a written index."""
    return {"terms": spark.read.parquet(f"{path}/terms"), "postings": read_bucketed(spark, path, "postings", buckets, ["term", "docid"]), "docs": read_bucketed(spark, path, "docs", buckets, ["docid"])}


def term_statistics(index: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf`` with idf = log10(N / df); N counts all documents, also those without terms."""
    return index.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log10(F.lit(float(n_docs)) / F.col("df")))


#: Terms up to which a dictionary is broadcast whole; some 60 bytes each.
BROADCAST_TERMS = 200_000


def weigh(index: DataFrame, terms: DataFrame, n_rows: int) -> DataFrame:
    """``docid, term, tf, weighted_tf, weight`` with weight = (1 + log10 weighted_tf) * idf.

    A dictionary of at most ``BROADCAST_TERMS`` terms is broadcast; of a larger one the
    frequent terms are, and the others shuffled.
    """
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        joined = index.join(F.broadcast(terms), "term")
    else:
        joined = join_by_frequency(index, terms, "term", F.col("df"), hot_threshold(n_rows))
    return joined.withColumn("weight", (1 + F.log10("weighted_tf")) * F.col("idf"))


def norms(docs: DataFrame, weighted: DataFrame) -> DataFrame:
    """``docid, length`` of every document; 0 for one without terms."""
    sums = weighted.groupBy("docid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return docs.select("docid").join(sums, "docid", "left").withColumn("length", F.coalesce("length", F.lit(0.0)))


def violations(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``rule, n`` of broken invariants: ids dense from 0, postings unique, counts positive, no unknown document."""
    top = docs.agg((F.max("docid") + 1 - F.count_distinct("docid")).alias("n")).select(F.lit("dense_ids").alias("rule"), "n")
    twice = index.groupBy("docid", "term").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique_postings").alias("rule"), "n")
    low = index.where("tf < 1 or weighted_tf < tf").agg(F.count("*").alias("n")).select(F.lit("positive_counts").alias("rule"), "n")
    lost = index.join(docs.select("docid"), "docid", "left_anti").agg(F.count("*").alias("n")).select(F.lit("known_documents").alias("rule"), "n")
    return top.unionByName(twice).unionByName(low).unionByName(lost)


def first_seen(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The earliest row of each ``key``."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), ordinal).alias("_r")).select("_r.*")


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The latest row of each ``key``; null keys are a key of their own."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), ordinal).alias("_r")).select("_r.*")


def top_k(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``, with ``rank_no``; Spark prunes before the shuffle."""
    return rows.withColumn("rank_no", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank_no") <= k)
