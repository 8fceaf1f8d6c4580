"""Results of another search engine's pages, fetched by a function that is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

#: Parameters of redirecting links that hold the target.
TARGETS = ("uddg", "url", "q", "u")


def unwrapped(link: str, base: str = "") -> str | None:
    """The http target of a result link: the link itself, or what a parameter of a redirecting one holds."""
    full = urljoin(base, link.strip())
    parts = urlsplit(full)
    for name in TARGETS:
        for value in parse_qs(parts.query).get(name, []):
            if value.startswith(("http://", "https://")):
                return value
    return full if parts.scheme in ("http", "https") and parts.hostname else None


class _Results(HTMLParser):
    def __init__(self, title_class: str, snippet_class: str) -> None:
        super().__init__(convert_charrefs=True)
        self.classes = {title_class: "title", snippet_class: "snippet"}
        self.found: list[dict] = []
        self.open: tuple[str, str] | None = None

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        values = dict(attributes)
        kind = next((self.classes[c] for c in (values.get("class") or "").split() if c in self.classes), None)
        if kind == "title":
            self.found.append({"href": values.get("href") or "", "title": [], "snippet": []})
        if kind and self.found:
            self.open = (tag, kind)

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.open[0] == tag:
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.open:
            self.found[-1][self.open[1]].append(data)


def results(page: str, base: str, k: int, title_class: str = "result__a", snippet_class: str = "result__snippet") -> list[tuple[str, str, str]]:
    """Url, title and snippet of the first ``k`` results of a page whose result links and snippets have these classes; those without http target are left out."""
    parser = _Results(title_class, snippet_class)
    parser.feed(page)
    rows = [(unwrapped(r["href"], base), " ".join("".join(r["title"]).split()), " ".join("".join(r["snippet"]).split())) for r in parser.found]
    return [r for r in rows if r[0]][: max(k, 0)]


def search(queries: DataFrame, fetch: Callable[[str], str | None], address: str, k: int = 20) -> DataFrame:
    """``query_id, rank_no, url, title, snippet`` for ``queries(query_id, text)``.

    ``fetch`` maps an address to a page or None; ``address`` holds ``%s`` for the query.
    A query that is null or whose page can't be had has no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, text in zip(batch["query_id"], batch["text"], strict=True):
                page = fetch(asked := address.replace("%s", quote_plus(text))) if text else None
                out += [(ident, k_, *r) for k_, r in enumerate(results(page or "", asked if text else "", k), 1)]
            yield pd.DataFrame(out, columns=["query_id", "rank_no", "url", "title", "snippet"])

    return queries.select("query_id", "text").mapInPandas(run, "query_id long, rank_no int, url string, title string, snippet string")
