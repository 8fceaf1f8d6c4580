"""Crawl frontiers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wherry.functions import urls
from wherry.operators.skew import hot_threshold, join_by_frequency
from wherry.session import checkpoint
from wherry.sources.jsonl import exists


def global_order(frontier: DataFrame) -> DataFrame:
    """``url, turn`` by priority, then by sequence; the turn is the place among all."""
    from wherry.operators.index import dense_ids

    ordered = frontier.select("url", (-F.col("priority")).alias("_p"), "seq")
    return dense_ids(ordered, ["_p", "seq"], "turn").select("url", (F.col("turn") + 1).alias("turn"))


def place_in_group(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the place (from 1) of each row in its ``group`` by ``order``, though one group may hold most rows.

    Rows are sorted in range partitions of group and order, so a large group lies
    in many; a row's place is its place in the partition's part of the group plus
    the rows of that group in partitions before, of which one count for each group
    and partition is summed.
    """
    keys = [group, *order]
    # The sort and the numbers of its partitions must be the same for both reads.
    ranged = checkpoint(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    parts = ranged.withColumn("_part", F.shiftright("_at", 33))
    counts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = parts.join(F.broadcast(starts) if _few(starts) else starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_g", "_p", "_first", "_before")


#: Starts of groups that are broadcast at most.
FEW = 100_000


def _few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def round_robin(frontier: DataFrame) -> DataFrame:
    """``url, host, round, host_turn``: hosts take turns in order of their first sight, each with its best url left.

    A url's round is its place within its host, which no single task needs to sort.
    """
    placed = place_in_group(frontier.withColumn("_down", -F.col("priority")), "host", ["_down", "seq"], "_round").drop("_down")
    first = frontier.groupBy("host").agg(F.min("seq").alias("host_turn"), F.count("*").alias("_n"))
    joined = join_by_frequency(placed, first, "host", F.col("_n"), hot_threshold(frontier.count()))
    return joined.select("url", "host", F.col("_round").cast("int").alias("round"), "host_turn")


def schedule(frontier: DataFrame, wait: float) -> DataFrame:
    """``url, host, start_s``: when each url may be fetched at the earliest, ``wait`` seconds apart within a host."""
    return round_robin(frontier).select("url", "host", ((F.col("round") - 1) * F.lit(wait)).alias("start_s"))


def new_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct found urls that aren't known yet."""
    return found.select("url").distinct().join(known.select("url"), "url", "left_anti")


def in_scope(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """Links whose host is one of ``hosts``."""
    return links.join(hosts.select("host"), "host", "left_semi")


def bfs_levels(links: DataFrame, seeds: DataFrame, max_level: int | None = None) -> DataFrame:
    """``url, level`` of every url reachable from the seeds, within ``max_level`` links if given; level by level, each written so that lineage stays short."""
    seen = checkpoint(seeds.select("url").distinct().withColumn("level", F.lit(0)))
    edge, level = seen, 0
    while max_level is None or level < max_level:
        level += 1
        step = edge.select(F.col("url").alias("src")).join(links.select("src", "dst"), "src").select(F.col("dst").alias("url")).distinct()
        edge = checkpoint(step.join(seen.select("url"), "url", "left_anti").withColumn("level", F.lit(level)))
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
        if level % 10 == 0:
            seen = checkpoint(seen)
    return seen


#: How a crawl picks its next urls: hosts in turn by priority, all by priority, or first come first served.
ORDERS = ("host", "priority", "fifo")


def seed_rows(seeds: DataFrame) -> DataFrame:
    """``url, host, priority, seq`` of the distinct seeds (``url, ordinal``), numbered from 1 in order of their first ordinal; those without host are left out."""
    from wherry.operators.index import dense_ids

    first = seeds.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("ordinal").alias("_o"))
    rows = first.select("url", "_o", urls.host(F.col("url")).alias("host"), urls.priority(F.col("url")).cast("long").alias("priority")).where(F.col("host").isNotNull())
    return dense_ids(rows, ["_o", "url"], "seq").select("url", "host", "priority", (F.col("seq") + 1).alias("seq"))


class Crawl:
    """A crawl as tables in a folder, round by round, so that it can be stopped and taken up again.

    ``known(url, host, priority, seq)`` has every url found so far and ``tried(url,
    final_url, round)`` every attempt; a round's folder counts once its ``_SUCCESS``
    is there. Given ``hosts`` bound the crawl, also after redirects; None means any.
    """

    def __init__(self, spark: SparkSession, folder: str, seeds: DataFrame, hosts: DataFrame | None = None, order: str = "host") -> None:
        if order not in ORDERS:
            raise ValueError(f"unknown order {order!r}; known are {ORDERS}")
        self.spark, self.folder, self.hosts, self.order = spark, folder, hosts, order
        self.round = 0
        while exists(spark, f"{folder}/known/{self.round}/_SUCCESS"):
            self.round += 1
        known = self._read("known")
        fresh = self._scoped(seed_rows(seeds))
        if known is not None:  # seeds that a resumed crawl doesn't know are put in behind what it does
            top = known.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            fresh = fresh.join(known.select("url"), "url", "left_anti").withColumn("seq", F.col("seq") + F.lit(top))
        self._commit(fresh, None)

    def _read(self, name: str) -> DataFrame | None:
        found = [f"{self.folder}/{name}/{k}" for k in range(self.round) if name == "known" or exists(self.spark, f"{self.folder}/{name}/{k}/_SUCCESS")]
        return self.spark.read.parquet(*found) if found else None

    def _commit(self, fresh: DataFrame, attempts: DataFrame | None) -> None:
        if attempts is not None:
            attempts.write.mode("overwrite").parquet(f"{self.folder}/tried/{self.round}")
        fresh.select("url", "host", "priority", "seq").write.mode("overwrite").parquet(f"{self.folder}/known/{self.round}")
        self.round += 1

    def _scoped(self, rows: DataFrame) -> DataFrame:
        return rows if self.hosts is None else in_scope(rows, self.hosts)

    def frontier(self) -> DataFrame:
        """``url, host, priority, seq`` of what is known and not tried, without files that are no pages."""
        known, tried = self._read("known"), self._read("tried")
        rows = known if tried is None else known.join(tried.select("url"), "url", "left_anti")
        return rows.where(~urls.is_ignored(F.col("url")))

    def attempts(self) -> int:
        tried = self._read("tried")
        return 0 if tried is None else tried.count()

    def turn(self, n: int) -> DataFrame:
        """The next ``n`` urls."""
        rows = self.frontier()
        if self.order == "host":
            return round_robin(rows).orderBy("round", "host_turn", "url").limit(n).select("url")
        return rows.orderBy(*([F.desc("priority")] if self.order == "priority" else []), "seq").limit(n).select("url")

    def run(self, fetch, extract, max_count: int, batch: int = 100) -> DataFrame:
        """Goes on until ``max_count`` attempts, failures included, or nothing is left; gives ``pages()``.

        ``fetch`` maps a table of ``url`` to ``url, final_url, html`` (failures absent),
        ``extract`` one of ``url, html`` (the page's final url) to links ``source, url, ordinal``. A page that was redirected out of ``hosts`` is dropped.
        """
        from wherry.operators.index import dense_ids

        done = self.attempts()
        while done < max_count:
            turn = checkpoint(self.turn(min(batch, max_count - done)))
            count = turn.count()
            if not count:
                break
            done += count
            got = checkpoint(fetch(turn).withColumn("host", urls.host(F.col("final_url"))))
            kept = checkpoint(self._scoped(got))
            kept.select("url", "final_url", "html").write.mode("overwrite").parquet(f"{self.folder}/pages/{self.round}")
            found = extract(kept.select(F.col("final_url").alias("url"), "html")).select(F.col("source"), F.col("url"), F.col("ordinal"))
            scored = found.where(F.col("url").isNotNull()).groupBy("url").agg(F.max(urls.priority(F.col("url"), F.col("source"))).cast("long").alias("priority"), F.min("ordinal").alias("_o")).withColumn("host", urls.host(F.col("url"))).where(F.col("host").isNotNull())
            known = self._read("known")
            top = known.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            fresh = dense_ids(self._scoped(scored).join(known.select("url"), "url", "left_anti"), ["_o", "url"], "seq").withColumn("seq", F.col("seq") + F.lit(top + 1))
            self._commit(fresh, turn.join(got.select("url", "final_url"), "url", "left").withColumn("round", F.lit(self.round)))
        return self.pages()

    def pages(self) -> DataFrame:
        """``url, final_url, html`` of all pages fetched."""
        found = [f"{self.folder}/pages/{k}" for k in range(self.round) if exists(self.spark, f"{self.folder}/pages/{k}/_SUCCESS")]
        return self.spark.read.parquet(*found) if found else self.spark.createDataFrame([], "url string, final_url string, html string")
