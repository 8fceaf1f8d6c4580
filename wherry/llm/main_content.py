"""The main body of a page, told from the site's own pieces around it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherry.llm.labelled_pages import LINES
from wherry.llm.markup import markup_kind

#: Steps, rate and penalty of the fit; scores are bounded so that no long line outweighs a page.
FIT_STEPS, RATE, RIDGE, BOUND = 1500, 4.0, 0.0003, 6.0
#: Scores beyond this are certain; a title-like line between minus twice and once this is decided by its place.
CERTAIN = 2.2
#: Hashed character pairs and quadruples; shape tags have places of their own behind them.
TABLE, TAGS = 1 << 18, 16

_SENTENCE_END = re.compile(r"(?:[。！？；.!?;：:]|[。！？.!?][”\"’」』）)])$")
_ENTRY_DATE = re.compile(r"^\[0[-/.]0\]|\S\s0[-/.]0[-/.]0$")
_CUT = re.compile(r"(?:…+|\.{3,})\s*(?:[\[(【（]?[\w\s]{2,12}[\])】）]?)?$")
_LIST_HEADING = re.compile(r"^(?:(?:相关|推荐|热点|热门|最新|近期|更多)(?:新闻|阅读|文章|公告|内容|通知|推荐|资讯)|猜你喜欢|延伸阅读|you may also like|related (?:news|articles|posts|stories)|latest (?:news|posts)|read (?:also|next)|most read|see also):?$")
_LABEL = re.compile(r"^[^\s:。，,.]{2,8}:")
_PATH = re.compile(r"(?:^|[:\s])(?:首页|主页|home)\s?(?:>+|»|/|→|›)|(?:\s?(?:>>|»|›|→)\s?\S.*){2}")
_MENU = re.compile(r"(?:[^|>»/·•—\s]{1,12}\s*(?:[|>»/·•—]\s*|\s)){2,}[^|>»/·•—]{1,12}$")


def tidy_all(lines: list[str]) -> list[str]:
    """NFKC, lower case, digit runs as 0, single spaces; all lines at once."""
    joined = unicodedata.normalize("NFKC", "\n".join(lines)).lower()
    joined = re.sub(r" ?\n ?", "\n", re.sub(r"[^\S\n]+", " ", re.sub(r"\d+", "0", joined)))
    return joined.strip(" ").split("\n")


def tidy(line: str) -> str:
    return tidy_all([line.replace("\n", " ")])[0]


def _tags(text: str) -> list[int]:
    """Shape tags of a tidied line."""
    out = []
    if _SENTENCE_END.search(text):
        out += [0, 1 + min(3, len(text) // 12)]
    elif len(text) <= 12:
        out.append(5)
    if len(text) <= 120:
        if _ENTRY_DATE.search(text) and not _LABEL.match(text):
            out += [6] * 4
        if _LIST_HEADING.match(text):
            out += [7, 7, 7]
        if _PATH.search(text):
            out += [11] * 4
        if _MENU.match(text):
            out += [9, 9, 9]
    if _CUT.search(text):
        out += [10] * 4
    return out


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all character pairs and quadruples, line after line, and where each line's begin. Line ends count as characters."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n\n\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points) - 3
    with np.errstate(over="ignore"):
        pair = points[:n] * np.uint64(1000003) + points[1 : n + 1]
        quad = (pair * np.uint64(1000003) + points[2 : n + 2]) * np.uint64(1000003) + points[3 : n + 3]
        both = np.stack([pair * np.uint64(0x9E3779B97F4A7C15), quad * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)], axis=1) >> np.uint64(46)
    ends = np.flatnonzero(points == 10)[: len(texts)]  # the mark before each line
    return both.reshape(-1).astype(np.int64), ends * 2


@cache
def weights(of_pieces: bool = False) -> np.ndarray:
    """Logistic weights of character pairs, quadruples and tags, positive for the article, fitted to all of ``LINES``, or to the pieces they fall into."""
    lines = [(x[0], x[2:]) for x in LINES.splitlines() if x]
    texts = tidy_all([x for _, x in lines])
    if of_pieces:
        lines = [(label, p) for (label, _), t in zip(lines, texts, strict=True) for p in pieces(t)]
        texts = [p for _, p in lines]
    places, starts = _hashed(texts)
    sizes = np.diff(np.append(starts, len(places)))
    line = np.repeat(np.arange(len(texts)), sizes)
    tags = [(k, TABLE + t) for k, text in enumerate(texts) for t in _tags(text)]
    line = np.concatenate([line, [k for k, _ in tags]]).astype(np.int64)
    place = np.concatenate([places, [t for _, t in tags]]).astype(np.int64)
    used, column = np.unique(place, return_inverse=True)
    x = np.zeros((len(texts), len(used)), np.float32)
    np.add.at(x, (line, column), 1.0)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    y = np.array([{"+": 1.0, "-": 0.0, "=": 0.35}[label] for label, _ in lines])
    # Gradient steps on the weights, which are sums of rows: only the rows' coefficients need to be kept.
    gram, rows = (x @ x.T).astype(np.float64), np.zeros(len(texts))
    for _ in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-gram @ rows))
        rows -= RATE / len(y) * (p - y) + RATE * RIDGE * rows
    full = np.zeros(TABLE + TAGS)
    full[used] = x.T @ rows
    return full


def scores(texts: list[str], of_pieces: bool = False) -> np.ndarray:
    """Score of each tidied line, or piece: twice the sum of its weights over the root of their number, within plus or minus ``BOUND``."""
    if not texts:
        return np.zeros(0)
    w = weights(of_pieces)
    places, starts = _hashed(texts)
    total = np.add.reduceat(w[places], starts)
    count = np.diff(np.append(starts, len(places))).astype(float)
    for k, text in enumerate(texts):
        tags = _tags(text)
        total[k] += sum(w[TABLE + t] for t in tags)
        count[k] += len(tags)
    return np.clip(2 * total / np.sqrt(count), -BOUND, BOUND)


def score(line: str) -> float:
    return float(scores([tidy(line)])[0])


def is_entry(text: str, points: float) -> bool:
    """Whether a tidied line reads like a title: no sentence and no certain words."""
    return not _SENTENCE_END.search(text) and len(text) <= 80 and -2 * CERTAIN < points < CERTAIN


def best_span(points: list[float]) -> tuple[int, int]:
    """The contiguous part of greatest sum as half-open interval, by one linear scan; the first and longest among equals. Empty if no sum is positive."""
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for k, p in enumerate(points):
        if total <= 0:
            total, start = 0.0, k
        total += p
        if total > best:
            best, span = total, (start, k + 1)
    return span


def foreign_lines(content: str, texts: list[str] | None = None, points: list[float] | None = None) -> list[int]:
    """1-based numbers of the lines of a page that aren't part of its article. Blank lines never count.

    ``texts`` and ``points`` are the tidied lines and their scores, if already known.
    """
    if texts is None:
        texts = tidy_all(content.split("\n"))
    if points is None:
        points = scores(texts).tolist()
    if markup_kind(content) != "plain":
        return [k for k, (t, p) in enumerate(zip(texts, points, strict=True), 1) if t and p <= -2 * CERTAIN and _PROSE.search(t) and not _MARKED.search(t)]
    kept = [k for k, text in enumerate(texts) if text]
    lines, points = [texts[k] for k in kept], [points[k] for k in kept]
    entry = [is_entry(t, p) for t, p in zip(lines, points, strict=True)]
    a, b = best_span([min(p, -0.5) if e else p for p, e in zip(points, entry, strict=True)])
    heading = next((k for k, t in enumerate(lines) if _LIST_HEADING.match(t)), len(lines))
    first = next((k for k in range(heading) if not entry[k] and points[k] > 0), a)
    a = min(a, first)
    while a and entry[a - 1] and not _ENTRY_DATE.search(lines[a - 1]) and (a == first or points[a] > 0):
        a -= 1  # the title above, and a doubtful line between it and the text
    out, listed = [], False
    for k, (t, p, e) in enumerate(zip(lines, points, entry, strict=True)):
        if _LIST_HEADING.match(t):
            listed = True
        elif not e and p > 0:
            listed = False
        own = not listed and (a <= k < b or p > 0.3) if e else a <= k < b and p > 0
        if not own and (e or p < CERTAIN):
            out.append(kept[k] + 1)
    return out


#: In a page of markup only lines of prose without any mark are judged; code isn't prose.
_PROSE = re.compile(r"[㐀-鿿]{2}|©|[a-z]{3,} [a-z]{2,} [a-z]{2,}")
_MARKED = re.compile(r"[<>\\{}\[\]$*#=`_~+()]|^-|^0\.|-$")


#: A region of an abstract may be the site's own from this sum of negative scores on; this many Latin words are scored together; a Han word standing alone may be a menu's from this score down.
REGION, WORDS, MENU = 1.0, 4, -3.5
_BREAKS = re.compile(r"(?<=[。！？；!?])\s*|(?<=[a-z0)”\"]\.)\s*(?=[a-z©])|\s*[|»→·•›>【】\[\]]+\s*|\s+/\s+|(?<=[㐀-鿿）)0:：])\s+(?=\S)|(?<=\S)\s+(?=[㐀-鿿©【\[])|(?=©)")


def pieces(text: str) -> list[str]:
    """A tidied abstract, whose lines run on, cut at sentence ends, separators and gaps between Han words; long Latin pieces in steps of ``WORDS`` words."""
    out: list[str] = []
    for piece in _BREAKS.split(text):
        words = piece.split(" ") if piece else []
        if len(words) > WORDS:
            out += [" ".join(words[k : k + WORDS]) for k in range(0, len(words), WORDS)]
        else:
            out.append(piece)
    return [p for p in out if sum(map(str.isalpha, p)) > 1 or "©" in p]


#: Marks of the site's own pieces, one of which a region must hold: words alone can't tell a breadcrumb's title from the article's.
_PIECE_TAG = re.compile(
    r"©|版权所有(?!者|权)|版权均属|未经授权禁止转载(?!的)|^all r(?:i(?:g(?:hts?.{0,10})?)?)?$|all rights res|(?:^|[\s。！？”])(?:上|下)一[篇条页]\s?:|(?:当前|您的|所在)位置\s?:|you are here:|(?:^|[\s.])(?:previous|next):\s|you may also like|tell a friend \||follow us for"
    r"|(?:^|\s)(?:相关|推荐|热点|热门|最新)(?:新闻|阅读|文章|公告)(?:\s|$)|(?:^|\s)(?:首页|home)\s?[|>·/»]|^home(?: (?:people|alumni|contact|events|research|admissions|jobs|news)){2}|log ?in \| |登录 \||skip to content|跳到主要内容|设为首页 |分享到:|【打印|扫码关注.{1,12}公众号|[\[【]接受|cookies? to improve|cookies help us|使用cookie改善|记录cookie信息|cookies? 统计访问量|阅读次数:|位访客|(?:^|\s)views: 0|terms of use \||is not responsible for the content of ext|转载请注明来源:"
)


def foreign_abstract_flags(abstracts: list[str]) -> list[bool]:
    """For each abstract whether it holds a region of the site's own.

    The region is the contiguous pieces whose negated scores add up to most: the
    maximum-scoring subsequence turned round, as in an abstract the article is the
    rule. It counts from ``REGION`` on, if a mark of such pieces or two words of a menu
    bears it out.
    """
    texts = tidy_all([a.replace("\n", " ") for a in abstracts])
    marked = [bool(_PIECE_TAG.search(t)) for t in texts]
    cut = [pieces(t) for t in texts]
    short = [[2 <= len(p) <= 8 and "\u4e00" <= p[0] <= "\u9fff" for p in x] for x in cut]
    asked = [k for k, s in enumerate(short) if marked[k] or sum(s) > 1]  # no other can have a region that is borne out
    points, at, out = (-scores([p for k in asked for p in cut[k]], True)).tolist(), 0, [False] * len(texts)
    for k in asked:
        own = points[at : at + len(cut[k])]
        a, b = best_span(own)
        words = sum(w and s >= -MENU for w, s in zip(short[k][a:b], own[a:b], strict=True))
        out[k] = sum(own[a:b]) >= REGION and (marked[k] or words > 1)
        at += len(own)
    return out


def main_content(content: str) -> str:
    """The article of a page alone."""
    foreign = set(foreign_lines(content))
    return "\n".join(line for k, line in enumerate(content.split("\n"), 1) if k not in foreign)


def _foreign_of_batch(contents: list[str]) -> list[list[int]]:
    """:func:`foreign_lines` of many pages with one pass of scoring."""
    split = [c.split("\n") for c in contents]
    texts = tidy_all([line for lines in split for line in lines])
    points, at, out = scores(texts).tolist(), 0, []
    for content, lines in zip(contents, split, strict=True):
        out.append(foreign_lines(content, texts[at : at + len(lines)], points[at : at + len(lines)]))
        at += len(lines)
    return out


def foreign_line_rows(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``row_id, line_no`` of every line that isn't part of the article. Null texts give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, n) for i, lines in zip(batch["row_id"], _foreign_of_batch(batch["text"].tolist()), strict=True) for n in lines]
            yield pd.DataFrame(found, columns=["row_id", "line_no"])

    source = rows.where(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("row_id"), F.col(text).alias("text"))
    return source.mapInPandas(run, "row_id long, line_no int")


def foreign_abstracts(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``row_id`` of every abstract that holds a piece of the site."""

    @F.pandas_udf("boolean")
    def foreign(texts: pd.Series) -> pd.Series:
        return pd.Series(foreign_abstract_flags(texts.tolist()))

    return rows.where(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("row_id"), F.col(text).alias("text")).where(foreign("text")).select("row_id")


def main_contents(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``row_id, article`` of every row with text."""

    @F.pandas_udf("string")
    def article(texts: pd.Series) -> pd.Series:
        return texts.map(main_content)

    return rows.where(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("row_id"), article(text).alias("article"))
