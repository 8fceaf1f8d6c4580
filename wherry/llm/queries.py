"""Queries of this package; each takes a session and a folder of tables and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.functions import urls
from wherry.llm import abuse, differencing, distinctive, leakage, main_content, markup, packing, repeated_lines, residue, spellings
from wherry.session import written
from wherry.sources.tables import table


def _residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "page_metadata", "record_no", "url", "title", "abstract"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _residue(spark, folder).select("record_no", "field")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The records none of whose fields is residue."""
    return table(spark, folder, "page_metadata", "record_no", "title", "abstract").join(_residue(spark, folder).select("record_no").distinct(), "record_no", "left_anti")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = main_content.foreign_line_rows(table(spark, folder, "search_results", "result_id", "content"), "result_id", "content")
    abstracts = main_content.foreign_abstracts(table(spark, folder, "page_metadata", "record_no", "abstract"), "record_no", "abstract")
    return lines.select(F.lit("search_results").alias("tbl"), "row_id", "line_no").unionByName(abstracts.select(F.lit("page_metadata").alias("tbl"), "row_id", F.lit(0).alias("line_no")))


def p2_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The article alone of every search result with content."""
    return main_content.main_contents(table(spark, folder, "search_results", "result_id", "content"), "result_id", "content")


def _p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables as one keyed set, so that hot keys are found and shuffles are made once."""
    docs = table(spark, folder, "doc_map", "docid", "url").select(F.lit("doc_map").alias("tbl"), F.col("docid").alias("ident"), "url")
    index = table(spark, folder, "url_index", "entry_id", "url").select(F.lit("url_index").alias("tbl"), F.col("entry_id").alias("ident"), "url")
    both = spellings.with_url_key(docs.unionByName(index), "url")
    keyed = both.select("ident", F.when(F.col("url_key").isNotNull(), F.concat_ws("\u0002", "tbl", "url_key")).alias("url_key"))
    return spellings.collapse(keyed, "url_key", "ident").withColumn("tbl", F.substring_index("url_key", "\u0002", 1))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p3_groups(spark, folder).where(F.col("ident") != F.col("keep_id")).select("tbl", "keep_id", F.col("ident").alias("copy_id"))


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per url with its number of copies."""
    return spellings.representatives(_p3_groups(spark, folder).drop("tbl"), "url_key").select(F.substring_index("url_key", "\u0002", 1).alias("tbl"), "keep_id", "copies")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = repeated_lines.site_pages(table(spark, folder, "search_results", "url", "content"))
    return repeated_lines.excessive_lines(pages).select("host", "line_key")


def p4_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's content without the lines of its host's excessive clusters."""
    pages = written(repeated_lines.site_pages(table(spark, folder, "search_results", "url", "content")))
    return repeated_lines.without_lines(pages, repeated_lines.excessive_clusters(pages)).select("host", "page", "cleaned")


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every excessive cluster, with its leader and the number of pages it is found in."""
    pages = written(repeated_lines.site_pages(table(spark, folder, "search_results", "url", "content")))
    return repeated_lines.excessive_clusters(pages).select("host", "leader", "line_key", "n_pages", "cluster_pages")


def _p5_sources(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "page_files", "file_id", "body").select(F.lit("page_files").alias("tbl"), F.col("file_id").alias("row_id"), F.col("body").alias("text"))
    results = table(spark, folder, "search_results", "result_id", "content").select(F.lit("search_results").alias("tbl"), F.col("result_id").alias("row_id"), F.col("content").alias("text"))
    return files, results


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [markup.elements_of(x, "row_id", "text").withColumn("tbl", F.lit(name)) for x, name in zip(_p5_sources(spark, folder), ("page_files", "search_results"), strict=True)]
    return parts[0].unionByName(parts[1]).select("tbl", "row_id", "kind", "item")


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every page file and search result."""
    parts = [markup.convert_all(x, "row_id", "text").withColumn("tbl", F.lit(name)) for x, name in zip(_p5_sources(spark, folder), ("page_files", "search_results"), strict=True)]
    return parts[0].unionByName(parts[1]).select("tbl", "row_id", "clean", F.size("elements").alias("n_elements"))


def p5_differenced(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every saved page without the lines that the page of the nearest url has as well."""
    files, _ = _p5_sources(spark, folder)
    clean = markup.convert_all(files, "row_id", "text").select(F.col("row_id").alias("page_id"), F.col("clean").alias("text"))
    placed = clean.join(table(spark, folder, "doc_map", "docid", "url").withColumnRenamed("docid", "page_id"), "page_id")
    path = F.concat_ws("?", urls.part(F.col("url"), 4), F.nullif(urls.part(F.col("url"), 5), F.lit("")))
    return differencing.differenced(placed.select("page_id", urls.host(F.col("url")).alias("host"), path.alias("path"), "text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    scores = distinctive.term_scores(table(spark, folder, "postings"), enrichment=False)
    return distinctive.top_terms(scores).select("docid", "term")


def p6_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that their page holds more often than chance would have it, by hypergeometric enrichment."""
    scores = distinctive.term_scores(table(spark, folder, "postings"))
    return distinctive.enriched_terms(scores).select("docid", "term", "tf", "df", "score", "enrichment")


def _p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Packing into every kind; a kind listed with several capacities has the least of them."""
    kinds = table(spark, folder, "containers", "kind", "capacity").where("kind is not null and capacity > 0").groupBy("kind").agg(F.min("capacity").alias("capacity"))
    sized = packing.token_counts(table(spark, folder, "documents", "doc_id", "text"))
    return packing.pack(sized, sorted((r["kind"], int(r["capacity"])) for r in kinds.collect()))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the filling had to split."""
    return _p8_pieces(spark, folder).where(F.col("piece") == 1).select("doc_id", "kind")


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Which container each document, or piece of one, lies in."""
    return _p8_pieces(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers of each kind are filled."""
    return packing.fill(_p8_pieces(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def p9_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold most of an item in order, with its share and that of its answers."""
    found = leakage.paraphrases(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text", "question"))
    return found.withColumns({c: F.round(c, 6) for c in ("overlap", "answered")})


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each item leaked."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def _p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "doc_labels")
    machine = abuse.fit(abuse.labelled_sample(documents, labels))
    return abuse.score_documents(documents, machine)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.flagged(_p10_scores(spark, folder)).select("doc_id", "category")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document in every category."""
    return _p10_scores(spark, folder).select("doc_id", *(F.round(c, 4).alias(c) for c in abuse.CATEGORIES))


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of each category per source."""
    return abuse.rates(_p10_scores(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_clean, p2_found, p2_articles, p3_found, p3_records, p4_found, p4_cleaned, p4_clusters, p5_found, p5_clean, p5_differenced, p6_found, p6_enriched,
        p8_found, p8_pack, p8_fill, p9_found, p9_paraphrases, p9_items, p10_found, p10_scores, p10_rates,
    )
}
