"""Lines that a page shares with the page of the nearest url on its host."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned(a: list[str], b: list[str]) -> list[int]:
    """Indexes of the lines of ``a`` in a longest common subsequence with ``b``; blank lines match nothing.

    Equal beginnings and ends are matched at once; between them pairs of equal lines
    are chained, so lines that occur once cost one step each.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    places: dict[str, list[int]] = defaultdict(list)
    for j in range(len(b) - last - 1, first - 1, -1):
        if b[j]:
            places[b[j]].append(j)
    ends: list[int] = []  # the least place in b at which a chain of each length ends
    chains: list[tuple] = []
    for i in range(first, len(a) - last):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    out = [*(k for k in range(first) if a[k]), *(k for k in range(len(a) - last, len(a)) if a[k])]
    chain = chains[-1] if chains else None
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return sorted(out)


_SCHEMA = "page_id long, neighbour_id long, n_lines int, n_shared int, text string"


def differenced(pages: DataFrame) -> DataFrame:
    """``page_id, neighbour_id, n_lines, n_shared, text``: each page without the lines it shares with its neighbour.

    ``pages(page_id, host, path, text)``. In the order of paths a page's neighbour is
    the one before it on its host: none shares a longer beginning but maybe the
    next. Pages are sorted in range partitions, so a host of any size is spread;
    where a partition begins, the next page is the neighbour. A page alone on its
    host and partition keeps its text and has a null neighbour. Lines are compared
    without white space around them; what is deleted is a longest common
    subsequence, blank lines stay. Rows with null host, path or text are left out,
    repeated rows are neighbours of each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None  # the last page: id, host, lines, whether it was put out

        def difference(ident: int, lines: list[str], other: tuple | None) -> tuple:
            if other is None:
                return ident, None, len(lines), 0, "\n".join(lines)
            gone = set(aligned([x.strip() for x in lines], [x.strip() for x in other[2]]))
            return ident, other[0], len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)

        for batch in batches:
            out = []
            for ident, host, text in zip(batch["page_id"].tolist(), batch["host"], batch["text"], strict=True):
                lines = text.split("\n")
                same = before is not None and before[1] == host
                if before is not None and not before[3]:
                    out.append(difference(before[0], before[2], (ident, host, lines) if same else None))
                if same:
                    out.append(difference(ident, lines, before))
                before = (ident, host, lines, same)
            yield pd.DataFrame(out, columns=["page_id", "neighbour_id", "n_lines", "n_shared", "text"]).astype({"neighbour_id": "Int64"})
        if before is not None and not before[3]:
            yield pd.DataFrame([difference(before[0], before[2], None)], columns=["page_id", "neighbour_id", "n_lines", "n_shared", "text"]).astype({"neighbour_id": "Int64"})

    rows = pages.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("text").isNotNull()).select(F.col("page_id").cast("long"), "host", "path", "text")
    return rows.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id").select("page_id", "host", "text").mapInPandas(run, _SCHEMA)
