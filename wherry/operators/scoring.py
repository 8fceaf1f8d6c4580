"""Scores of a block of queries against the documents of a task: sums over arrays, one query at a time, so that no pair of query and document is sorted or kept."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Digits to which scores are rounded before they are compared, as sums have no fixed order.
DIGITS = 9
#: Postings that a task adds up at once, and rows that it hands on at once.
CHUNK_POSTINGS, BATCH_ROWS = 2_000_000, 100_000
#: Greater than any place of a term.
_NEVER = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Block:
    """The vectors of some queries: those of query ``i`` are the rows ``starts[i]`` to ``starts[i + 1]``, the first term of its text last."""

    ids: pa.Array
    starts: np.ndarray
    term: np.ndarray
    first_pos: np.ndarray
    qweight: np.ndarray
    counted: np.ndarray
    qlength: np.ndarray
    idf: np.ndarray


def block(rows: pa.Table) -> tuple[Block, list[str]]:
    """The vectors ``rows(query_id, term, first_pos, idf, qweight, counted)`` and their distinct terms, whose places in the list are their numbers."""
    coded = rows["term"].combine_chunks().dictionary_encode()
    queries = rows["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    term, query, first = coded.indices.to_numpy(), queries.indices.to_numpy(), rows["first_pos"].to_numpy()
    order = np.lexsort((-first, query))
    idf = np.zeros(len(coded.dictionary))
    idf[term] = rows["idf"].to_numpy()
    weight = rows["qweight"].to_numpy()[order]
    starts = np.searchsorted(query[order], np.arange(len(queries.dictionary) + 1))
    lengths = np.sqrt(np.add.reduceat(weight * weight, starts[:-1])) if len(weight) else weight
    return Block(queries.dictionary, starts, term[order], first[order].astype(np.int32), weight, rows["counted"].to_numpy()[order], lengths, idf), coded.dictionary.to_pylist()


@dataclass
class Hits:
    """Documents that share a term with query ``query``, by place ``at`` in ``docs``, which is in order of id."""

    query: int
    docs: Documents
    at: np.ndarray
    score: np.ndarray
    first_pos: np.ndarray

    def where(self, rows: np.ndarray) -> Hits:
        return Hits(self.query, self.docs, self.at[rows], self.score[rows], self.first_pos[rows])

    def best(self, k: int) -> Hits:
        """The first ``k`` in order of score, first matching term and id."""
        hits = self
        if len(self.score) > k:
            hits = self.where(self.score >= np.partition(self.score, len(self.score) - k)[len(self.score) - k])
        return hits.where(np.lexsort((hits.at, hits.first_pos, -hits.score))[:k])

    def held(self) -> np.ndarray:
        """Sums of what the matched terms count in re-ranking."""
        return self.docs.held(self.query, self.at)


def chunks(batches: Iterator[pa.RecordBatch], least: int = CHUNK_POSTINGS) -> Iterator[pa.Table]:
    """The batches put together until they hold ``least`` postings."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch["p"].flatten())
        if n >= least:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class Documents:
    """The documents ``docid, length, p`` of a chunk in order of id, their postings ``p(t, w)`` by term."""

    def __init__(self, block: Block, docs: pa.Table) -> None:
        docs = docs.take(np.argsort(docs["docid"].to_numpy(), kind="stable")).combine_chunks()
        lists = docs["p"].combine_chunks()
        number, count = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        order = np.argsort(number, kind="stable")
        self.block, self.docid = block, docs["docid"].to_numpy()
        self.length = docs["length"].to_numpy() if "length" in docs.column_names else None
        self.place = np.repeat(np.arange(len(self.docid)), np.diff(lists.offsets.to_numpy()))[order]
        self.weight = (1 + np.log10(count[order])) * block.idf[number[order]]
        ends = np.searchsorted(number[order], np.arange(len(block.idf) + 1)).tolist()
        terms, starts = block.term.tolist(), block.starts.tolist()
        #: Of each query, for each of its terms that these documents hold: the term's row in the block, and the slice of its postings.
        self.rows = [[(j, slice(ends[t], ends[t + 1])) for j, t in enumerate(terms[a:b], a) if ends[t + 1] > ends[t]] for a, b in zip(starts, starts[1:])]

    def hits(self) -> Iterator[Hits]:
        """The hits of each query that has any; scores are cosines, or dot products where no length is known."""
        block, dot, first = self.block, np.zeros(len(self.docid)), np.empty(len(self.docid), np.int32)
        weights, places = block.qweight.tolist(), block.first_pos.tolist()
        for q, rows in enumerate(self.rows):
            if not rows:
                continue
            if len(rows) == 1:
                ((j, own),) = rows
                found, score = self.place[own], 0 + weights[j] * self.weight[own]
                pos = np.full(len(found), places[j], np.int32)
            else:
                dot.fill(0)
                first.fill(_NEVER)
                for j, own in rows:
                    at = self.place[own]
                    dot[at] += weights[j] * self.weight[own]
                    first[at] = places[j]
                found = np.flatnonzero(first != _NEVER)
                score, pos = dot[found], first[found]
            if self.length is not None:
                score = np.round(score / self.length[found] / block.qlength[q], DIGITS)
            yield Hits(q, self, found, score, pos)

    def held(self, query: int, at: np.ndarray) -> np.ndarray:
        """Sums of what the terms of a query that the documents ``at`` hold count in re-ranking."""
        total = np.zeros(len(at))
        for j, own in self.rows[query]:
            if self.block.counted[j] and len(at):
                place = self.place[own]
                total[place[np.minimum(np.searchsorted(place, at), len(place) - 1)] == at] += self.block.counted[j]
        return total


def batches(block: Block, found: Iterator[Hits], least: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Hits as rows ``query_id, docid, score, first_pos, held``."""
    kept: list[tuple] = []
    n = 0

    def out() -> pa.RecordBatch:
        ids = block.ids.take(pa.array(np.repeat([h[0] for h in kept], [len(h[1]) for h in kept])))
        columns = [pa.array(np.concatenate(x)) for x in list(zip(*kept, strict=True))[1:]]
        return pa.RecordBatch.from_arrays([ids, *columns], ["query_id", "docid", "score", "first_pos", "held"])

    for h in found:
        if len(h.at):
            kept.append((h.query, h.docs.docid[h.at], h.score, h.first_pos, h.held()))
            n += len(h.at)
        if n >= least:
            yield out()
            kept, n = [], 0
    if n:
        yield out()


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` to so many decimals as Spark's ``round`` has it: halves of the number as it is written go away from zero. For numbers under 2**52 / 10**digits."""
    scale = 10.0**digits
    low = np.floor(np.abs(x) * scale)
    return np.copysign((low + (np.abs(x) >= (low + 0.5) / scale)) / scale, x) + 0.0  # no negative zero


def pairs(block: Block, found: Iterator[Hits], digits: int, name: str, least: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Hits as rows ``query_id, docid`` and the rounded score as column ``name``: no more than that is worked out."""
    kept: list[Hits] = []
    n = 0

    def out() -> pa.RecordBatch:
        ids = block.ids.take(pa.array(np.repeat([h.query for h in kept], [len(h.at) for h in kept])))
        scores = rounded(np.concatenate([h.score for h in kept]), digits)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([h.docs.docid[h.at] for h in kept])), pa.array(scores)], ["query_id", "docid", name])

    for h in found:
        kept.append(h)
        n += len(h.at)
        if n >= least:
            yield out()
            kept, n = [], 0
    if n:
        yield out()


def ranks(k: int) -> np.ndarray:
    """Ranks up to ``k``, each some 1.4 times the one before."""
    return np.unique([*(round(2 ** (x / 2)) for x in range(64) if 2 ** (x / 2) < k), k])


def levels(block: Block, found: Iterator[Hits], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of the hits at the :func:`ranks` of each query; ``held`` is how many ranks a row stands for."""
    at = ranks(k)
    steps = np.diff(at, prepend=0).astype(float)

    class Reported(Hits):
        def held(self) -> np.ndarray:
            return steps[: len(self.at)]

    def some() -> Iterator[Hits]:
        for h in found:
            top = h.best(k)
            rows = top.where(at[: np.searchsorted(at, len(top.at), "right")] - 1)
            yield Reported(rows.query, rows.docs, rows.at, rows.score, rows.first_pos)

    return batches(block, some())


def within(block: Block, found: Iterator[Hits], k: int, bounds: dict[int, tuple[float, int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of the hits that aren't behind their query's bound (score, first matching term, id), ``k`` of each query at most."""

    def some() -> Iterator[Hits]:
        for h in found:
            if bound := bounds.get(h.query):
                score, first, docid = bound
                h = h.where(np.flatnonzero(h.score >= score))
                if (tied := h.score == score).any():
                    h = h.where(~tied | (h.first_pos < first) | ((h.first_pos == first) & (h.docs.docid[h.at] <= docid)))
            yield h.best(k) if len(h.at) > k else h

    return batches(block, some())
