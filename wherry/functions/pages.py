"""HTML pages parsed once into every field the engine uses.

A parser is a loop over tags, which no expression can say; it runs in Arrow
batches. The rules of HTML for tags that are left out hold: a paragraph ends
where a block begins, a list item where the next one does.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wherry.functions.links import normalise_link

# Elements and classes that hold the main text of a page, by preference; any list may be given instead.
CONTAINERS = ["article", "main", ".article-content", ".article_content", ".detail", ".content", ".v_news_content", ".TRS_Editor", ".zi"]
#: Elements without text for a reader, and those that aren't part of the main text.
UNSEEN = frozenset(["script", "style", "noscript", "template", "svg"])
ASIDE = frozenset(["nav", "footer"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements whose start ends an open paragraph.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section table ul".split()) | {*_HEADINGS}
#: For each element the open ones that its start ends, and where the search for them stops.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_REFRESH = re.compile(r"""url\s*=\s*(?:"([^"]+)"|'([^']+)'|([^;\s]+))""", re.I)
_SCRIPTED = [re.compile(r"""location\.href\s*=\s*(["'])(.*?)\1""", re.I | re.S), re.compile(r"""location\.replace\s*\(\s*(["'])(.*?)\1\s*\)""", re.I | re.S)]

SCHEMA = "title string, title_spaced string, headings array<string>, headings_spaced array<string>, paragraphs array<string>, paragraphs_spaced array<string>, visible string, content string, meta_names array<string>, meta_contents array<string>, links array<string>, redirects array<string>, n_errors int"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class PageParser(HTMLParser):
    """One page; see :func:`parse_page`."""

    def __init__(self, base: str, containers: list[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.containers = base, containers
        self.open: list[tuple[str, int, tuple[int, ...]]] = []  # tag, number of texts before it, containers it is
        self.texts: list[tuple[str, bool]] = []  # text, whether it belongs to the main part
        self.unseen = self.aside = 0
        self.title: tuple[int, int] | None = None
        self.body_at: int | None = None
        self.headings: list[tuple[int, int]] = []
        self.paragraphs: list[tuple[int, int]] = []
        self.held: list[tuple[int, int, int]] = []
        self.metas: dict[str, str] = {}
        self.links: dict[str, None] = {}
        self.redirects: dict[str, None] = {}
        self.script: list[str] = []

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        values: dict[str, str] = {}
        for name, value in attributes:
            values.setdefault(name, value or "")
        if tag in _BLOCKS:
            self._end("p", _BLOCKS - {"p"})
        if tag in _HEADINGS and self.open and self.open[-1][0] in _HEADINGS:
            self._pop()
        if tag in _ENDS:
            ended, stops = _ENDS[tag]
            for t in ended:
                self._end(t, stops)
        if tag == "body" and self.body_at is None:
            self._close(0)
            self.body_at = len(self.texts)
        elif tag == "meta":
            self._meta(values)
        elif tag == "a" and "href" in values and not self.unseen and (link := normalise_link(values["href"], self.base)):
            self.links.setdefault(link)
        if tag in _VOID:
            return
        classes = values.get("class", "").split()
        kinds = tuple(k for k, c in enumerate(self.containers) if (c[1:] in classes if c[0] == "." else c == tag))
        self.open.append((tag, len(self.texts), kinds))
        self.unseen += tag in UNSEEN
        self.aside += tag in ASIDE

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "script":
            self.script.append(data)
        if not self.unseen and (text := data.strip()):
            self.texts.append((text, not self.aside))

    def _meta(self, values: dict[str, str]) -> None:
        content = values.get("content", "")
        for key in ("name", "property"):
            if values.get(key):
                self.metas.setdefault(values[key], content)
        if values.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.search(content)):
            self._redirect(next(g for g in m.groups() if g is not None))

    def _redirect(self, target: str) -> None:
        if link := normalise_link(target, self.base):
            self.redirects.setdefault(link)

    def _end(self, tag: str, stops) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return
            if self.open[k][0] in stops:
                return

    def _close(self, k: int) -> None:
        while len(self.open) > k:
            self._pop()

    def _pop(self) -> None:
        tag, start, kinds = self.open.pop()
        self.unseen -= tag in UNSEEN
        self.aside -= tag in ASIDE
        span = (start, len(self.texts))
        if tag == "title" and self.title is None:
            self.title = span
        elif tag in _HEADINGS[:3]:
            self.headings.append(span)
        elif tag == "p":
            self.paragraphs.append(span)
        elif tag == "script":
            whole = "".join(self.script)
            self.script = []
            for pattern in _SCRIPTED:
                for m in pattern.finditer(whole):
                    self._redirect(m[2])
        self.held += [(c, *span) for c in kinds]

    def fields(self) -> list:
        self._close(0)
        join = lambda span, gap: gap.join(t for t, _ in self.texts[span[0] : span[1]])
        squeeze = lambda text: " ".join(text.split())
        self.headings.sort()
        self.paragraphs.sort()
        start = self.body_at if self.body_at is not None else (self.title[1] if self.title else 0)
        main = [squeeze(" ".join(t for t, own in self.texts[a:b] if own)) for _, a, b in sorted(self.held)]
        content = max(main, key=len) if main else squeeze(" ".join(t for t, own in self.texts[start:] if own))
        title = self.title or (0, 0)
        spans = [p for p in self.paragraphs if join(p, "")]
        return [
            join(title, ""), squeeze(join(title, " ")), [join(h, "") for h in self.headings], [squeeze(join(h, " ")) for h in self.headings], [join(p, "") for p in spans], [squeeze(join(p, " ")) for p in spans],
            squeeze(" ".join(t for t, _ in self.texts[start:])), content, list(self.metas), [squeeze(x) for x in self.metas.values()], list(self.links), list(self.redirects), 0,
        ]


def parse_page(page: str, base: str = "", containers: list[str] = CONTAINERS) -> list:
    """The values of ``FIELDS`` for a page; a page the parser gives up on has nulls and ``n_errors`` 1.

    Texts are stripped pieces joined without gap (``title``, ``headings``,
    ``paragraphs``) or by single spaces (``..._spaced``, ``visible``, ``content``).
    ``content`` is the longest text of any of ``containers``, without navigation and
    footers, else of the body. Of metas the first of each name counts. Links and
    redirects are absolute, normalised and distinct, in order of appearance.
    """
    parser = PageParser(base, containers)
    try:
        parser.feed(page)
        parser.close()
        return parser.fields()
    except (AssertionError, ValueError, RecursionError):
        return [None] * (len(FIELDS) - 1) + [1]


def parsed(page: Column, base: Column | None = None, containers: list[str] = CONTAINERS) -> Column:
    """The struct of :func:`parse_page`, null for a null page. ``base`` is the page's url, against which links are resolved."""
    containers = list(containers)

    @F.pandas_udf(SCHEMA)
    def parse(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        rows = [parse_page(p, b or "", containers) if p is not None else [None] * len(FIELDS) for p, b in zip(pages, bases, strict=True)]
        return pd.DataFrame(rows, columns=FIELDS).astype({"n_errors": "Int32"})

    return parse(page, F.lit("") if base is None else F.coalesce(base, F.lit("")))


def meta(page: Column, names: list[str]) -> Column:
    """Content of the first of ``names`` whose meta element has any, of a struct of :func:`parsed`; else null."""
    at = lambda name: F.array_position(page["meta_names"], name).cast("int")
    return F.coalesce(*(F.nullif(F.get(page["meta_contents"], at(n) - 1), F.lit("")) for n in names))
