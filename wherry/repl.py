"""Searching from a terminal: ``python -m wherry.repl FOLDER [K]`` reads a query a line and prints its pages."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from wherry.plans.search_queries import K, Engine


def replies(spark: SparkSession, folder: str, lines: Iterable[str], k: int = K) -> Iterator[list[tuple[int, str]]]:
    """For each line that isn't blank the place and url of its ``k`` pages; the index is built at the first, if it isn't there."""
    for line in lines:
        if line.strip():
            asked = spark.createDataFrame([(0, line.strip())], "query_id long, text string")
            yield [(r["place"], r["url"]) for r in Engine(spark, folder, asked).service(k).orderBy("place").collect()]


def main() -> None:
    from wherry.session import build_session

    spark = build_session("repl")
    for found in replies(spark, sys.argv[1], sys.stdin, int(sys.argv[2]) if len(sys.argv) > 2 else K):
        print(*(f"{place}. {url}" for place, url in found), sep="\n", flush=True)


if __name__ == "__main__":
    main()
