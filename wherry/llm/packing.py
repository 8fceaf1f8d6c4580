"""Filling containers of fixed capacity with documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that one task packs together; bounds a group whatever the input.
SHARD_ROWS = 100_000
#: Tasks of a packing at most, so that small shards don't each need one.
MAX_TASKS = 20_000
_SCHEMA = "kind string, capacity long, shard int, container_no long, doc_id long, piece int, offset long, n_tokens long"


class _Stock:
    """Available lengths with counts, and the same as bit sets so that sums are looked up in a few machine words."""

    def __init__(self, lengths: dict[int, int], capacity: int) -> None:
        self.counts = {n: c for n, c in lengths.items() if c > 0}
        self.capacity = capacity
        self.bits = sum(1 << n for n in self.counts)
        self.mirror = sum(1 << (capacity - n) for n in self.counts)

    def times(self, parts: tuple[int, ...]) -> int:
        """How often all ``parts`` together are available."""
        return min(self.counts.get(p, 0) // parts.count(p) for p in set(parts))

    def use(self, parts: tuple[int, ...], times: int) -> None:
        for p in parts:
            self.counts[p] -= times
            if not self.counts[p]:
                del self.counts[p]
                self.bits ^= 1 << p
                self.mirror ^= 1 << (self.capacity - p)

    def complement(self, held: tuple[int, ...], gap: int) -> tuple[int, tuple[int, ...]]:
        """One, two or three available lengths that fill ``gap`` exactly beside ``held``; how often, and which."""
        if gap == 0:
            return self.times(held), ()
        if self.bits >> gap & 1 and (t := self.times((*held, gap))):
            return t, (gap,)
        if pair := self._pair(held, gap):
            return pair
        for c in sorted((x for x in self.counts if x < gap), reverse=True):
            if pair := self._pair((*held, c), gap - c):
                return pair[0], (c, *pair[1])
        return 0, ()

    def _pair(self, held: tuple[int, ...], gap: int) -> tuple[int, tuple[int, ...]] | None:
        both = self.bits & (self.mirror >> (self.capacity - gap))
        while both:
            a = both.bit_length() - 1
            if a * 2 < gap:
                return None
            if t := self.times((*held, a, gap - a)):
                return t, (a, gap - a)
            both ^= 1 << a
        return None


def pack_lengths(lengths: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Containers for ``lengths`` (length -> count), as (lengths in a container, number of such containers).

    Exact-complement hashing: a container starts with the largest length left and,
    while four items can't fill it, takes the next largest; the gap is then looked
    up among single lengths, sums of two and sums of three, and a combination that
    fills it exactly is used as often as its lengths are available. What finds no
    complement is packed best fit decreasing. Lengths must lie between 1 and
    ``capacity``.
    """
    stock = _Stock(lengths, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    residual: dict[int, int] = {}
    for n in sorted(stock.counts, reverse=True):
        while n in stock.counts:
            held, gap = (n,), capacity - n
            while gap > 3 * n and stock.times((*held, n)):
                held, gap = (*held, n), gap - n
            times, parts = stock.complement(held, gap)
            if not times and len(held) > 1:
                held, gap = (n,), capacity - n
                times, parts = stock.complement(held, gap)
            if not times:
                residual[n] = stock.counts[n]
                stock.use((n,), residual[n])
                break
            stock.use((*held, *parts), times)
            out.append(((*held, *parts), times))
    out.extend(_best_fit(residual, capacity))
    return out


def _best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing by remaining room; containers of equal contents are kept as one with a count."""
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for n in sorted(lengths, reverse=True):
        count = lengths[n]
        while count:
            room = min((r for r in rooms if r >= n and rooms[r]), default=0)
            if not room:
                per = min(count, capacity // n)
                times = count // per
                parts, rest = (n,) * per, capacity - n * per
            else:
                held, there = next(iter(rooms[room].items()))
                per = min(count, room // n)
                times = min(there, count // per)
                parts, rest = held + (n,) * per, room - n * per
                rooms[room][held] -= times
                if not rooms[room][held]:
                    del rooms[room][held]
            rooms[rest][parts] = rooms[rest].get(parts, 0) + times
            count -= per * times
    return [(parts, times) for by in rooms.values() for parts, times in by.items()]


def _pack_shard(capacities: list[tuple[str, int]]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n_tokens"])
        out = []
        for kind, capacity in [capacities[int(key[1])]]:
            whole: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            no = 0
            for doc, n in zip(rows["doc_id"].tolist(), rows["n_tokens"].tolist(), strict=True):
                pieces, rest = divmod(n, capacity) if n > capacity else (0, n)
                for k in range(pieces):
                    out.append((kind, capacity, int(key[0]), no, doc, k, k * capacity, capacity))
                    no += 1
                if rest or not n:
                    whole[rest].append((doc, pieces, pieces * capacity))
            empty = whole.pop(0, [])
            for parts, times in pack_lengths({n: len(x) for n, x in whole.items()}, capacity):
                for _ in range(times):
                    for n in parts:
                        doc, piece, at = whole[n].pop()
                        out.append((kind, capacity, int(key[0]), no, doc, piece, at, n))
                    no += 1
            out.extend((kind, capacity, int(key[0]), 0, doc, 0, 0, 0) for doc, _, _ in empty)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return pack


def pack(sized: DataFrame, containers: list[tuple[str, int]], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Containers of each kind filled with the items of ``sized(doc_id, n_tokens)``.

    One row per piece: ``kind, capacity, shard, container_no`` name the container,
    ``piece, offset, n_tokens`` the part of the document. Only an item larger than
    the capacity is split: into full containers and a rest that is packed like any
    other item. Items are spread by a hash of their id over shards of about
    ``shard_rows`` items (a bound on a task's input that no size of input or hot
    length can break), each packed by :func:`pack_lengths`; at most one container
    per shard and kind stays badly filled. Null sizes are left out, empty items
    lie in container 0 without room, repeated rows are items of their own.
    """
    if not containers:
        return sized.sparkSession.createDataFrame([], _SCHEMA)
    rows = sized.where(F.col("doc_id").isNotNull() & (F.col("n_tokens") >= 0)).select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"))
    shards = max(1, -(-rows.count() // shard_rows))
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    # Every kind packs the items anew, so shards and kinds are worked on side by side; a number of partitions given is not merged.
    per_kind = keyed.withColumn("_k", F.explode(F.array(*map(F.lit, range(len(containers))))))
    spread = per_kind.repartition(max(1, min(shards * len(containers), MAX_TASKS)), "shard", "_k")
    return spread.groupBy("shard", "_k").applyInPandas(_pack_shard(containers), _SCHEMA)


def fill(pieces: DataFrame) -> DataFrame:
    """``kind, capacity, n_containers, n_tokens, share`` of the containers of :func:`pack`: how much of their room is used."""
    used = pieces.where("n_tokens > 0").groupBy("kind", "capacity", "shard", "container_no").agg(F.sum("n_tokens").alias("n"))
    totals = used.groupBy("kind", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return totals.withColumn("share", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))


@cache
def _encoder(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str | None = None, pattern: str = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+|\s+") -> DataFrame:
    """``doc_id, n_tokens``: UTF-8 bytes of the text, or tokens of the byte-pair vocabulary file ``tokenizer``, which splits text by ``pattern`` first. Null for a null text.

    ``tokenizer`` is the path of a .tiktoken file that every executor can read.
    """
    if tokenizer is None:
        return documents.select("doc_id", F.octet_length("text").cast("long").alias("n_tokens"))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(tokenizer, pattern)
        for series in texts:
            yield pd.Series([None if t is None else len(encoder.encode_ordinary(t)) for t in series], dtype="Int64")

    return documents.select("doc_id", count("text").alias("n_tokens"))
