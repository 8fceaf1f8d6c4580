"""Streams of urls to fetch, spaced out per host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wherry.functions import urls


def fetch_times(requests: DataFrame, wait_s: float) -> DataFrame:
    """``url, host, fetch_at``: each request as early as its host allows, ``wait_s`` seconds after the one before.

    ``requests`` is a stream (or table) of ``url string, at timestamp``. The state
    per host is the time of its last fetch alone; a host that asks for a third of
    all urls is slowed by its own politeness, not by its state. Requests of a batch
    are served by time, then url. Rows without url or time are left out.
    """

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "url"])
        last = state.get[0] if state.exists else None
        out = []
        for at in rows["at"]:
            last = max(at.timestamp(), last + wait_s) if last is not None else at.timestamp()
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({"url": rows["url"].to_numpy(), "host": key[0], "fetch_at": pd.to_datetime(out, unit="s")})

    rows = requests.where(F.col("url").isNotNull() & F.col("at").isNotNull()).select("url", "at", F.coalesce(urls.host(F.col("url")), F.lit("")).alias("host"))
    return rows.groupBy("host").applyInPandasWithState(serve, "url string, host string, fetch_at timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def new_urls(found: DataFrame, delay: str = "1 day") -> DataFrame:
    """Urls of a stream of ``url, at`` that weren't seen within ``delay`` before; state older than that is dropped."""
    return found.withWatermark("at", delay).dropDuplicatesWithinWatermark(["url"])
