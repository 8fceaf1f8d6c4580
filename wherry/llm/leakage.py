"""Passages of held-out evaluation items inside training documents."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passages are windows of this many normalised characters; consecutive ones overlap by half.
WINDOW, STRIDE = 60, 30
#: Terms are character triples. A passage that holds a whole match of RUN characters has RUN - 2 of the item's.
RUN, GRAM = 30, 3
#: Rank of the latent space, oversampling and power steps of the randomised SVD, and least cosine of a candidate.
RANK, OVERSAMPLE, POWER_STEPS, CANDIDATE = 256, 32, 2, 0.3
#: Items of one latent space, and such blocks searched in one scan of the documents; bounds what is broadcast.
BLOCK_ITEMS, PASS_BLOCKS = 2000, 25
#: Rows of a matrix that travel together when partial products are summed.
CHUNK_ROWS = 512
#: A paraphrase holds LEAST of an item's units in order within a window of WIDTH times its length, and ANSWERS of its answers.
LEAST, WIDTH, ANSWERS = 0.8, 2, 0.5

_DROP = regex.compile(r"[^\p{L}\p{N}]+")


def normalise(text: str) -> str:
    """NFKC, lower case, letters and digits only."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower())


def _grams(points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (points[2:] * np.uint64(0x165667B19E3779F9))
        return mixed ^ (mixed >> np.uint64(29))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Vocabulary:
    """The triples of the items of a block, and where a batch of texts holds them."""

    def __init__(self, items: list[str]) -> None:
        self.extend(np.unique(np.concatenate([_grams(_points(x)) for x in items if len(x) >= GRAM] or [np.zeros(0, np.uint64)])))

    def extend(self, terms: np.ndarray) -> None:
        """Takes ``terms``, sorted and distinct, as the vocabulary."""
        self.terms = terms
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, position in the text and term number of every occurrence."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + 2)
        points = _points("".join(f"{t}\x00\x00" for t in texts))
        if len(points) < GRAM or not len(self.terms):
            return (np.zeros(0, np.int64),) * 3
        grams = _grams(points)
        at = np.flatnonzero(self.sieve[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        term = np.searchsorted(self.terms, grams[at])
        ok = self.terms[np.minimum(term, len(self.terms) - 1)] == grams[at]
        at, term = at[ok], term[ok]
        text = np.searchsorted(ends, at, side="right")
        return text, at - (ends[text] - lengths[text] - 2), term

    def passages(self, texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passages with at least ``least`` occurrences of terms, as sparse counts: text of each passage, and (passage, term, count) by passage."""
        text, position, term = self.hits(texts)
        window = position // STRIDE
        text, window, term = (np.concatenate([a, b]) for a, b in ((text, text), (window, window - 1), (term, term)))
        ok = (window >= 0) & (np.concatenate([position, position]) - window * STRIDE <= WINDOW - GRAM)
        key = (text[ok] << 32) | window[ok]
        keys, passage, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[passage] >= least
        renumber = np.cumsum(counts >= least) - 1
        pair, tf = np.unique((renumber[passage[keep]] << 32) | term[ok][keep], return_counts=True)
        return keys[counts >= least] >> 32, pair >> 32, pair & 0xFFFFFFFF, tf


def document_frequencies(documents: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many documents each term of ``vocabulary`` occurs, and the number of documents; partial sums by partition."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(len(vocabulary.terms), np.int64), 0
        for batch in batches:
            text, _, term = vocabulary.hits([normalise(t) for t in batch["text"]])
            rows += len(batch)
            total += np.bincount(np.unique((text << 32) | term) & 0xFFFFFFFF, minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(total[at], rows)})

    summed = documents.mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary.terms) + 1, np.int64)
    df[summed["term"].to_numpy()] = summed["n"].to_numpy()  # the last place holds the number of documents
    return df[:-1], int(df[-1])


class Passages:
    """Unit rows of TF-IDF of the passages of some texts, as sparse triplets ordered by row."""

    def __init__(self, texts: list[str], vocabulary: Vocabulary, idf: np.ndarray) -> None:
        self.text_of, self.row, self.term, tf = vocabulary.passages(texts, 1)
        value = tf * idf[self.term]
        self.n, self.n_terms = len(self.text_of), len(idf)
        self.value = value / np.sqrt(np.bincount(self.row, value**2, minlength=self.n))[self.row] if self.n else value
        self.starts = np.flatnonzero(np.diff(self.row, prepend=-1))

    def times(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """The rows' dot products with the columns of ``x``."""
        out, ends = np.zeros((self.n, x.shape[1])), np.append(self.starts, len(self.row))
        for a in range(0, self.n, block):
            b = min(a + block, self.n)
            lo, hi = ends[a], ends[b]
            out[a:b] = np.add.reduceat(self.value[lo:hi, None] * x[self.term[lo:hi]], self.starts[a:b] - lo, axis=0)
        return out

    def transposed_times(self, y: np.ndarray, block: int = 256) -> np.ndarray:
        """The sum over rows of each row times its row of ``y``."""
        out, ends = np.zeros((self.n_terms, y.shape[1])), np.append(self.starts, len(self.row))
        for a in range(0, self.n, block):
            lo, hi = ends[a], ends[min(a + block, self.n)]
            np.add.at(out, self.term[lo:hi], self.value[lo:hi, None] * y[self.row[lo:hi]])
        return out


def _summed(items: DataFrame, product, rows: int, columns: int) -> np.ndarray:
    """The sum of the matrices that ``product`` makes of the texts of each batch, added up in chunks of rows by the executors."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rows, columns))
        for batch in batches:
            total += product([normalise(t) for t in batch["text"]])
        at = range(0, rows, CHUNK_ROWS)
        yield pd.DataFrame({"chunk": list(at), "data": [total[k : k + CHUNK_ROWS].tobytes() for k in at]})

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [key[0]], "data": [sum(np.frombuffer(d) for d in parts["data"]).tobytes()]})

    out = np.zeros((rows, columns))
    for r in items.mapInPandas(partial, "chunk long, data binary").groupBy("chunk").applyInPandas(add, "chunk long, data binary").toLocalIterator():
        part = np.frombuffer(r["data"]).reshape(-1, columns)
        out[r["chunk"] : r["chunk"] + len(part)] = part
    return out


def latent_space(items: DataFrame, vocabulary: Vocabulary, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Right singular vectors (columns) of the ``rank`` largest singular values of the TF-IDF passages of ``items(text)``.

    A distributed randomised SVD: a random matrix is multiplied with the passages and
    back, orthonormalised between ``POWER_STEPS`` rounds; every product is a sum
    over partitions, sparse, and only matrices of the vocabulary's height and some
    hundred columns reach the driver.
    """
    n_terms, shared = len(idf), items.sparkSession.sparkContext.broadcast((vocabulary, idf))
    k = min(rank + OVERSAMPLE, n_terms)

    def passages(texts: list[str]) -> Passages:
        return Passages(texts, *shared.value)

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, k)))[0]
    for _ in range(POWER_STEPS):
        handed = items.sparkSession.sparkContext.broadcast(basis)

        def step(texts: list[str], handed=handed) -> np.ndarray:
            own = passages(texts)
            return own.transposed_times(own.times(handed.value))

        basis = np.linalg.qr(_summed(items, step, n_terms, k))[0]
        handed.unpersist()
    handed = items.sparkSession.sparkContext.broadcast(basis)

    def gram(texts: list[str]) -> np.ndarray:
        y = passages(texts).times(handed.value)
        return y.T @ y

    values, vectors = np.linalg.eigh(_summed(items, gram, k, k))
    keep = np.argsort(-values)[:rank]
    return np.ascontiguousarray((basis @ vectors[:, keep[values[keep] > 1e-12 * max(values.max(), 1e-300)]]).astype(np.float32))


class LatentIndex:
    """The items' passages in the latent space of their TF-IDF matrix, weighted by the corpus."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: Vocabulary, idf: np.ndarray, space: np.ndarray) -> None:
        self.items, self.vocabulary, self.idf, self.space = items, vocabulary, idf, space
        own = Passages([t for _, t in items], vocabulary, idf)
        self.item_of, self.latent = own.text_of, own.times(space).astype(np.float32)

    def candidates(self, texts: list[str], least: int = RUN - GRAM + 1, cosine: float = CANDIDATE) -> list[tuple[int, int, float]]:
        """(text number, item number, greatest cosine) of texts with a passage near one of an item.

        The cosine is taken of the passage's length in the items' terms and its
        projection to the latent space, so a passage of other words isn't near.
        """
        text_of, passage, term, tf = self.vocabulary.passages(texts, least)
        if not len(text_of):
            return []
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        value = tf * self.idf[term]
        best: dict[tuple[int, int], float] = {}
        for a in range(0, len(starts), 512):
            b = min(a + 512, len(starts))
            lo, hi = starts[a], starts[b] if b < len(starts) else len(value)
            z = np.add.reduceat(value[lo:hi, None] * self.space[term[lo:hi]], starts[a:b] - lo, axis=0)
            norm = np.sqrt(np.add.reduceat(value[lo:hi] ** 2, starts[a:b] - lo))
            near = (z @ self.latent.T) / norm[:, None]
            for p, q in zip(*np.nonzero(near >= cosine), strict=True):
                pair = (int(text_of[a + p]), int(self.item_of[q]))
                best[pair] = max(best.get(pair, 0.0), float(near[p, q]))
        return [(t, i, c) for (t, i), c in best.items()]


def shares_run(document: str, item: str, run: int = RUN) -> bool:
    """Whether two normalised texts share ``run`` consecutive characters."""
    return any(item[k : k + run] in document for k in range(len(item) - run + 1))


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two sequences, by bit-parallel rows."""
    where: dict = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << k)
    row = 0
    for c in b:
        x = row | where.get(c, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``BLOCK_ITEMS``, normalised; null texts are left out."""
    block: list[tuple[int, str]] = []
    for r in items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").orderBy("item_id").toLocalIterator():
        block.append((int(r["item_id"]), normalise(r["text"])))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def _indexes(rows: DataFrame, items: DataFrame, blocks: list[list[tuple[int, str]]]) -> list[LatentIndex]:
    """A latent index of each block; the document frequencies of all come from one scan."""
    vocabularies = [Vocabulary([t for _, t in block]) for block in blocks]
    whole = Vocabulary([])
    whole.extend(np.unique(np.concatenate([v.terms for v in vocabularies])))
    if not len(whole.terms):
        return []
    df, n_docs = document_frequencies(rows, whole)
    out = []
    for block, vocabulary in zip(blocks, vocabularies, strict=True):
        if len(vocabulary.terms):
            idf = np.log((1 + n_docs) / (1.0 + df[np.searchsorted(whole.terms, vocabulary.terms)])) + 1
            own = items.where(F.col("item_id").between(block[0][0], block[-1][0])).select("text")
            out.append(LatentIndex(block, vocabulary, idf, latent_space(own, vocabulary, idf)))
    return out


def _search(documents: DataFrame, items: DataFrame, check, schema: str) -> DataFrame:
    spark = documents.sparkSession
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    named = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text")
    found = spark.createDataFrame([], schema)
    for blocks in batched(_blocks(items), PASS_BLOCKS):
        shared = [spark.sparkContext.broadcast(x) for x in _indexes(rows, named, list(blocks))]

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts, ids, out = [normalise(t) for t in batch["text"]], batch["doc_id"].tolist(), []
                for index in shared:
                    for k, i, c in index.value.candidates(texts):
                        out += check(ids[k], texts[k], *index.value.items[i], c)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        if shared:
            found = found.unionByName(rows.mapInPandas(run, schema))
    return found


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, item_id, cosine``: documents that share ``run`` consecutive normalised characters with an item.

    Latent semantic retrieval finds the candidates: TF-IDF over character triples
    with document frequencies of the whole corpus, distributed randomised SVD of the
    items' passages, cosine of every passage of every document with every item
    passage in that space; an exact comparison of the whole texts decides. A passage of a
    match holds all its triples, so passages with fewer are left out at no loss.
    The items go in blocks of bounded size against all documents; nothing of the
    documents is shuffled or gathered. Null texts, and items or documents shorter
    than ``run``, match nothing; repeated documents each give their rows.
    """

    def check(doc: int, text: str, item: int, item_text: str, cosine: float) -> list[tuple]:
        return [(doc, item, cosine)] if shares_run(text, item_text, run) else []

    return _search(documents, items, check, "doc_id long, item_id long, cosine double")


_UNITS = regex.compile(r"[a-z0-9]+|[\p{L}\p{N}]")
_NUMBERS = regex.compile(r"\d+(?:\.\d+)?")


def units(text: str) -> list[str]:
    """Latin words and numbers, and the single letters of other scripts, of a text: NFKC, lower case."""
    return _UNITS.findall(unicodedata.normalize("NFKC", text).lower())


def answers(text: str, question: str | None) -> list[str]:
    """The numbers that an item states and its question doesn't give away: what an answer to it would say."""
    given = set(_NUMBERS.findall(unicodedata.normalize("NFKC", question or "")))
    return [n for n in dict.fromkeys(_NUMBERS.findall(unicodedata.normalize("NFKC", text))) if n not in given]


def overlap(item: list[str], document: list[str]) -> tuple[float, int, int]:
    """The greatest share of ``item`` that a window of ``document`` holds in order, and that window.

    Windows are ``WIDTH`` times as long as the item and begin every half of its
    length, so every stretch of one and a half lengths lies in one whole.
    """
    n = len(item)
    size, step = WIDTH * n, max(1, n // 2)
    best = (0.0, 0, 0)
    for a in range(0, max(1, len(document) - size + step), step):
        share = lcs_length(item, document[a : a + size]) / n
        if share > best[0]:
            best = (share, a, min(a + size, len(document)))
    return best


class UnitCounts:
    """How often each item holds each unit, which bounds common subsequences from above."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]]) -> None:
        self.items = [x for x in items if x[1]]
        self.lengths = np.array([len(u) for _, u, _ in self.items])
        self.place = {c: k for k, c in enumerate(sorted({c for _, u, _ in self.items for c in u}))}
        self.counts = np.zeros((len(self.place), len(self.items)), np.int32)
        for k, (_, u, _) in enumerate(self.items):
            for c, n in Counter(u).items():
                self.counts[self.place[c], k] = n

    def candidates(self, document: list[str], least: float) -> np.ndarray:
        """Numbers of the items of which ``document`` may hold a subsequence of the share ``least``: no such item is missing."""
        held = [(self.place[c], n) for c, n in Counter(document).items() if c in self.place]
        if not held:
            return np.zeros(0, np.int64)
        rows, n = np.array(held, np.int64).T
        bound = np.minimum(self.counts[rows], n[:, None]).sum(axis=0)
        return np.flatnonzero(bound / self.lengths >= least)


def paraphrases(documents: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, overlap, answered``: documents that hold ``least`` of an item in order, whether or not any run is whole.

    Compared are Latin words and single letters of other scripts; the longest common
    subsequence counts within windows of :func:`overlap`, so that a long document
    can't hold an item by its length alone. The answer check asks for ``ANSWERS`` of
    the numbers that the item states and its question doesn't (``answered`` is their
    share in the window, 1 for an item without any); pairs below are left out. A
    subsequence can't hold a unit more often than either text does; pairs that this
    bound rules out are left out at no loss, all others are compared. ``items`` may
    lack ``question``. Null texts and items without letters match nothing.
    """
    schema = "doc_id long, item_id long, overlap double, answered double"
    spark = documents.sparkSession
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    asked = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text", "question" if "question" in items.columns else F.lit(None).cast("string").alias("question"))
    found = spark.createDataFrame([], schema)
    listed = ((r["item_id"], units(r["text"]), answers(r["text"], r["question"])) for r in asked.orderBy("item_id").toLocalIterator())
    for block in batched(listed, BLOCK_ITEMS * PASS_BLOCKS):
        shared = [spark.sparkContext.broadcast(UnitCounts(list(part))) for part in batched(block, BLOCK_ITEMS)]

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc, text in zip(batch["doc_id"].tolist(), map(units, batch["text"]), strict=True):
                    for index in shared:
                        for k in index.value.candidates(text, least):
                            item, own, wanted = index.value.items[k]
                            share, a, b = overlap(own, text)
                            if share >= least:
                                there = set(text[a:b])
                                # A decimal number is two units, so its parts are looked for.
                                answered = sum(set(n.split(".")) <= there for n in wanted) / len(wanted) if wanted else 1.0
                                if answered >= ANSWERS:
                                    out.append((doc, item, share, answered))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "overlap", "answered"])

        found = found.unionByName(rows.mapInPandas(run, schema))
    return found
