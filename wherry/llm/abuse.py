"""Abusive, hateful and sexual language, plainly written or disguised."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ["abuse", "hate", "sexual"]
#: Bounds of the fit, whatever there is: labelled documents read, those without any vote that are used, landmarks.
MAX_DOCUMENTS, MAX_CLEAN, LANDMARKS = 8000, 2500, 400
#: Subsequences of two and three characters; a skipped character costs DECAY. Places of the hashed feature table.
DECAY, TABLE = 0.7, 1 << 18
_SHAPES = [(0, 1), (0, 2), (0, 3), (0, 1, 2), (0, 1, 3), (0, 2, 3)]
#: Ridge of the machine, rounds of choosing the sentences that make a document positive, folds that find the decision.
RIDGE, ROUNDS, FOLDS = 1.0, 3, 3
#: Sentences of this kernel value are near each other; the value is taken from sketches of so many numbers.
NEAR, SKETCH = 0.5, 256
#: A score above this is a case: margins are shifted so that it is the decision the folds found.
DECISION = 0.0
#: Least positive documents of a category for the folds; with fewer the decision is the machine's own.
LEAST_POSITIVE = 12

# Characters that stand for letters in disguised words.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "+": "t", "!": "i", "|": "l", "€": "e", "£": "l"})

#: Ends of sentences, and gaps after a run of Han text (not those between single characters).
_SENTENCES = re.compile(r"(?<=[。！？!?])|\n|(?<=[a-z]{3}[.;]) +|(?<=[一-鿿）)0-9”]{5})[ ;；]+|(?<=[一-鿿）)”]{4}[;；])")
#: What a colon follows, if no longer than this, names a speaker or field and is no sentence.
LABEL = 12
#: A longer sentence is scored in overlapping parts of this many letters.
PART = 80
#: Letters scored at a time, which bounds the memory of a worker whatever the size of its batch.
SCORED_LETTERS = 200_000
_LEET_WORD = re.compile(r"[a-z0-9@$+!|]*[a-z][a-z0-9@$+!|]*")
_LETTERS = re.compile(r"[\W_]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text as bare letters: NFKC, lower case, digits inside words read as letters, other digit runs as 0, nothing between."""
    out = []
    for line in _SENTENCES.split(unicodedata.normalize("NFKC", text).lower()):
        *before, last = line.split(":")
        for part in [p for p in before if len(p) > LABEL] + [last]:
            words = _LEET_WORD.sub(lambda m: m[0].rstrip("!").translate(_LEET), part)
            bare = re.sub(r"\d+", "0", _LETTERS.sub("", words))
            if len(bare) > PART:
                out += [bare[k : k + PART] for k in range(0, len(bare) - PART // 2, PART // 2)]
            elif len(bare) > 1:
                out.append(bare)
    return out


def kernel_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Explicit features of the gap-weighted subsequence kernel of many sentences: table places, weights, and the sentence of each, in order of sentences."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(f"\x02{t}\x03" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths + 2)
    n = len(points)
    padded, who = np.append(points, np.zeros(3, np.uint64)), np.append(owner, np.full(3, -1))
    places, weights, valid = [], [], []
    with np.errstate(over="ignore"):
        for shape in _SHAPES:
            mixed = np.full(n, len(shape), np.uint64)
            for s in shape:
                mixed = (mixed ^ padded[s : n + s]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
            places.append((mixed >> np.uint64(20)) % np.uint64(TABLE))
            weights.append(np.full(n, DECAY ** (shape[-1] + 1 - len(shape)), np.float32))
            valid.append(who[shape[-1] : n + shape[-1]] == owner)
    place, weight, ok = (np.stack(x, axis=1).reshape(-1) for x in (places, weights, valid))
    return place[ok].astype(np.int64), weight[ok], np.repeat(owner, len(_SHAPES))[ok]


def _norms(weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(owner, weight.astype(np.float64) ** 2, minlength=n), 1e-9))


@dataclass
class StringKernelMachine:
    """A support vector machine on Nyström features of the subsequence kernel, folded into one weight per subsequence and category."""

    table: np.ndarray  # TABLE x categories, float32
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Margin of each sentence in each category."""
        out, ends = [np.zeros((0, len(self.bias)))], np.cumsum([len(t) + 2 for t in texts])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCORED_LETTERS, side="right")))
            out.append(self._scores(texts[at:end]))
            at = end
        return np.concatenate(out)

    def _scores(self, texts: list[str]) -> np.ndarray:
        place, weight, owner = kernel_features(texts)
        total = np.stack([np.bincount(owner, weight * self.table[place, c], minlength=len(texts)) for c in range(len(self.bias))], axis=1)
        return total / _norms(weight, owner, len(texts))[:, None] + self.bias

    def document_scores(self, documents: list[str]) -> np.ndarray:
        """Greatest margin of any sentence of each document; -9 for a document without sentences."""
        split = [sentences(d) for d in documents]
        by_sentence = self.scores([s for x in split for s in x])
        out, at = np.full((len(documents), len(self.bias)), -9.0), 0
        for k, x in enumerate(split):
            if x:
                out[k] = by_sentence[at : at + len(x)].max(axis=0)
                at += len(x)
        return out


#: Fixed margin of a sentence that shares nothing with any landmark.
BIAS = -1.0


def _fit_svm(z: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Weights of a squared-hinge machine with the bias ``BIAS`` for the rows of ``z`` named, by Newton steps on the active set."""
    at = np.concatenate([positive, negative])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    cost = np.where(y > 0, np.clip(len(negative) / max(1, len(positive)) / 4, 1.0, 5.0), 1.0).astype(np.float32)
    x, w = z[at], np.zeros(z.shape[1])
    for _ in range(30):
        active = y * (x @ w.astype(np.float32) + BIAS) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve((a.T @ x[active]).astype(np.float64) + RIDGE * np.eye(z.shape[1]), a.T @ (y[active] - BIAS))
        done = np.abs(new - w).max() < 1e-5
        w = new
        if done:
            break
    return w


class _Nystroem:
    """Kernel values to landmarks, by the subsequences that landmarks hold, and the map that makes their dot products the kernel."""

    def __init__(self, landmarks: list[str]) -> None:
        self.n = len(landmarks)
        place, weight, owner = kernel_features(landmarks)
        norm = _norms(weight, owner, self.n)
        self.held, row = np.unique(place, return_inverse=True)
        self.row_of = np.full(TABLE, len(self.held), np.int64)
        self.row_of[self.held] = np.arange(len(self.held))
        self.rows = np.zeros((len(self.held) + 1, self.n), np.float32)
        np.add.at(self.rows, (row, owner), weight / norm[owner].astype(np.float32))
        kernel = self.kernel(landmarks)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        ok = values > 1e-6 * values.max()
        self.whiten = vectors[:, ok] / np.sqrt(values[ok])

    def kernel(self, texts: list[str], block: int = 100) -> np.ndarray:
        out = np.zeros((len(texts), self.n), np.float32)
        for a in range(0, len(texts), block):
            part = texts[a : a + block]
            place, weight, owner = kernel_features(part)
            norm, row = _norms(weight, owner, len(part)), self.row_of[place]
            ok = row < len(self.held)
            row, weight, owner = row[ok], weight[ok], owner[ok]
            if len(row):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                out[a + owner[starts]] = np.add.reduceat(self.rows[row] * weight[:, None], starts, axis=0) / norm[owner[starts]][:, None]
        return out

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """Weights on the mapped features as one weight per place of the table."""
        table = np.zeros(TABLE, np.float32)
        table[self.held] = (self.rows @ (self.whiten @ weights))[:-1]
        return table


def _sketches(texts: list[str], block: int = 1000) -> np.ndarray:
    """Kernel features of sentences, normalised and hashed into ``SKETCH`` signed sums; dot products approximate the kernel."""
    out = np.zeros((len(texts), SKETCH), np.float32)
    for a in range(0, len(texts), block):
        part = texts[a : a + block]
        place, weight, owner = kernel_features(part)
        mixed = place.astype(np.uint64) * np.uint64(0x9E3779B1)
        sign = np.where(mixed >> np.uint64(20) & np.uint64(1), -weight, weight)
        sums = np.bincount(owner * SKETCH + (mixed >> np.uint64(21)).astype(np.int64) % SKETCH, sign, minlength=len(part) * SKETCH)
        out[a : a + len(part)] = sums.reshape(len(part), SKETCH) / _norms(weight, owner, len(part))[:, None]
    return out


class _Bags:
    """Labelled documents as bags of numbered sentences with their votes."""

    def __init__(self, labelled: list[tuple[str, dict[str, float]]], rng: np.random.Generator) -> None:
        split = [(list(dict.fromkeys(sentences(t))), [v.get(c, 0.0) for c in CATEGORIES]) for t, v in labelled]
        marked = [x for x in split if x[0] and any(x[1])]
        clean = [x for x in split if x[0] and not any(x[1])]
        bags = marked + [clean[k] for k in sorted(rng.permutation(len(clean))[:MAX_CLEAN].tolist())]
        self.texts = sorted({s for x, _ in bags for s in x})
        number = {s: k for k, s in enumerate(self.texts)}
        self.members = [np.array([number[s] for s in x], np.int64) for x, _ in bags]
        self.votes = np.array([v for _, v in bags]).reshape(len(bags), len(CATEGORIES))
        self.flat = np.concatenate([*self.members, np.zeros(0, np.int64)])
        self.starts = np.cumsum([0, *map(len, self.members)])[:-1]
        self.sketch = _sketches(self.texts)

    def density(self, at: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence of ``at`` and category the votes of the bags with a sentence near it, and how many such bags nobody voted for."""
        yes, no = np.zeros((len(at), len(CATEGORIES))), np.zeros((len(at), len(CATEGORIES)))
        unvoted = (self.votes == 0).astype(np.float32)
        for a in range(0, len(at), block):
            near = (self.sketch[at[a : a + block]] @ self.sketch.T) >= NEAR
            bags = np.logical_or.reduceat(near[:, self.flat], self.starts, axis=1).astype(np.float32)
            yes[a : a + block], no[a : a + block] = bags @ self.votes, bags @ unvoted
        return yes, no


def fit(labelled: list[tuple[str, dict[str, float]]], seed: int = 5) -> StringKernelMachine:
    """A machine from documents with, for each category, the share of raters that saw it.

    A document is a bag of sentences, as the votes are on documents. Which sentences
    make a document positive is told by diverse density: a seed is a sentence near
    which (kernel value ``NEAR``) two or more voted documents lie, and more than
    unvoted ones. The machine is fitted to seeds against the sentences of unvoted
    documents; in further rounds every voted document gives those sentences that
    the machine puts on the positive side and that aren't near more unvoted
    documents, and documents without any (a rater erred) drop out, as do negatives
    near which the voted documents prevail (a rater overlooked them). The decision
    is found by folds over documents: the margin that gives held-out documents the
    greatest F1, in the middle of equals. Without any voted document every score of
    a category is negative.
    """
    rng = np.random.default_rng(seed)
    table, bias = np.zeros((TABLE, len(CATEGORIES)), np.float32), np.full(len(CATEGORIES), BIAS)
    bags = _Bags(labelled, rng)
    voted = [np.flatnonzero(bags.votes[:, c] >= 0.5) for c in range(len(CATEGORIES))]
    if not any(map(len, voted)):
        return StringKernelMachine(table, bias)
    candidates = np.unique(np.concatenate([bags.members[k] for k in np.unique(np.concatenate(voted))]))
    yes, no = bags.density(candidates)
    seeds = [_seeds(bags, voted[c], candidates, yes[:, c], no[:, c]) for c in range(len(CATEGORIES))]
    landmarks = sorted({k for s in seeds for k in _spread(bags.sketch, s, LANDMARKS // 5)})
    rest = np.setdiff1d(rng.permutation(len(bags.texts)), landmarks)
    landmarks = sorted({*landmarks, *rng.permutation(rest)[: LANDMARKS - len(landmarks)].tolist()})
    space = _Nystroem([bags.texts[k] for k in landmarks])
    z = (space.kernel(bags.texts) @ space.whiten).astype(np.float32)
    fold = rng.permutation(len(bags.members)) % FOLDS
    prevail = np.ones((len(bags.texts), len(CATEGORIES)), bool)
    prevail[candidates] = yes > no
    for c in range(len(CATEGORIES)):
        if len(seeds[c]):
            weights, decision = _choose(bags, c, z, seeds[c], prevail[:, c], fold)
            table[:, c], bias[c] = space.folded(weights), BIAS - decision
    return StringKernelMachine(table, bias)


def _choose(bags: _Bags, c: int, z: np.ndarray, seeds: np.ndarray, prevail: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and decision of one category after rounds of choosing sentences, each judged by the machine that wasn't fitted to its document.

    With fewer than ``LEAST_POSITIVE`` voted documents there are no folds; the
    machine judges its own documents and the decision is 0.
    """
    size = np.array(list(map(len, bags.members)))
    owner = np.repeat(np.arange(len(size)), size)
    voted, unvoted = bags.votes[:, c] >= 0.5, bags.votes[:, c] == 0
    chosen, negative, decision = seeds, np.setdiff1d(bags.flat[unvoted[owner]], seeds), 0.0
    split = fold if voted.sum() >= LEAST_POSITIVE else np.full(len(size), -1)
    for _ in range(ROUNDS):
        margin = np.full(len(owner), BIAS)
        for f in np.unique(split):
            kept = bags.flat[(split[owner] != f) | (f < 0)]
            fit_to = np.intersect1d(chosen, kept)
            if len(fit_to):
                held = split[owner] == f
                margin[held] = z[bags.flat[held]] @ _fit_svm(z, fit_to, np.intersect1d(negative, kept)) + BIAS
        if split[0] >= 0:
            decision = _decision(np.maximum.reduceat(margin, bags.starts), voted, unvoted)
        above = margin > decision
        new = np.unique(bags.flat[above & voted[owner] & prevail[bags.flat]])
        chosen = new if len(new) else chosen
        raised = np.intersect1d(bags.flat[above & unvoted[owner]], negative)
        yes, no = bags.density(raised)
        negative = np.setdiff1d(negative, np.concatenate([raised[yes[:, c] > no[:, c]], chosen]))
    return _fit_svm(z, chosen, negative), decision


def _decision(top: np.ndarray, voted: np.ndarray, unvoted: np.ndarray) -> float:
    """The margin of greatest F1 on documents whose greatest margins are ``top``, in the middle of equals."""
    order = np.argsort(-top)
    order = order[(voted | unvoted)[order]]
    f1 = 2 * np.cumsum(voted[order]) / (np.arange(1, len(order) + 1) + voted.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(np.clip((top[order[best[0]]] + top[order[min(best[-1] + 1, len(order) - 1)]]) / 2, -0.9, 0.9))


def _seeds(bags: _Bags, voted: np.ndarray, candidates: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """The sentences of voted documents near which two votes and more than unvoted documents lie; where there are none, the one of each document near the fewest unvoted ones."""
    if not len(voted):
        return np.zeros(0, np.int64)
    own = np.isin(candidates, np.concatenate([bags.members[k] for k in voted]))
    found = candidates[own & (yes >= 2) & (yes > no)]
    if len(found):
        return found
    rank = dict(zip(candidates.tolist(), (no - yes).tolist(), strict=True))
    return np.unique([min(bags.members[k].tolist(), key=lambda s: rank[s]) for k in voted])


def _spread(sketch: np.ndarray, at: np.ndarray, most: int) -> list[int]:
    """Up to ``most`` of the sentences ``at``, each next one the farthest from those before."""
    if not len(at):
        return []
    chosen = [int(at[0])]
    nearest = sketch[at] @ sketch[chosen[0]]
    while len(chosen) < min(most, len(at)):
        k = int(np.argmin(nearest))
        chosen.append(int(at[k]))
        nearest = np.maximum(nearest, sketch[at] @ sketch[at[k]])
        nearest[k] = np.inf
    return chosen


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int = MAX_DOCUMENTS) -> list[tuple[str, dict[str, float]]]:
    """At most ``limit`` labelled documents with the share of raters per category, chosen by a hash of the id."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("category").isNotNull())
    votes = named.groupBy("doc_id").agg(F.count_distinct("rater").alias("raters"), *(F.count_distinct(F.when(F.col("category") == c, F.col("rater"))).alias(c) for c in CATEGORIES))
    picked = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return [(r["text"], {c: r[c] / max(1, r["raters"]) for c in CATEGORIES}) for r in found]


def score_documents(documents: DataFrame, machine: StringKernelMachine) -> DataFrame:
    """``doc_id, source`` and the greatest margin of any sentence in each category (columns ``abuse, hate, sexual``). A null or empty text has -9."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                out = part[["doc_id", "source"]].copy()
                out[CATEGORIES] = shared.value.document_scores([t or "" for t in part["text"]])
                yield out

    return documents.select(F.col("doc_id").cast("long"), "source", "text").mapInPandas(run, "doc_id long, source string, abuse double, hate double, sexual double")


def flagged(scores: DataFrame, decision: float = DECISION) -> DataFrame:
    """``doc_id, category`` of every score above ``decision``."""
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES))).alias("x")
    return scores.select("doc_id", one).select("doc_id", "x.category", "x.score").where(F.col("score") > decision)


def rates(scores: DataFrame, decision: float = DECISION) -> DataFrame:
    """``source, category, n_docs, n_flagged, rate``."""
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES))).alias("x")
    rows = scores.select("source", one).select("source", "x.category", "x.score")
    counts = rows.groupBy("source", "category").agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") > decision).alias("n_flagged"))
    return counts.withColumn("rate", F.round(F.col("n_flagged") / F.col("n_docs"), 6))
