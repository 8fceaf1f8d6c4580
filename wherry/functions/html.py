"""Fields of HTML pages as column expressions over the source: those that need no parser (see ``pages`` for the others)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wherry.functions.text import clean_text

# Where a page may name its own title, date and abstract, by priority.
TITLE_METAS = ["citation_title", "ArticleTitle", "og:title", "twitter:title"]
DATE_METAS = ["PubDate", "publishdate", "article:published_time", "date"]
ABSTRACT_METAS = ["citation_abstract", "description", "og:description", "twitter:description"]
#: Entities that occur in running text; numeric ones are left alone.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def without_code(page: Column) -> Column:
    """A page without comments, scripts, styles and other unseen parts."""
    unseen = r"(?is)<!--.*?-->|<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>"
    return F.when(page.contains("<"), F.regexp_replace(page, unseen, " ")).otherwise(page)


def unescape(text: Column) -> Column:
    for entity, mark in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def inner_text(fragment: Column, gap: str = " ") -> Column:
    """Text of a fragment: tags become ``gap``, entities characters."""
    return clean_text(unescape(F.regexp_replace(fragment, r"<[^>]*>", gap)))


def title(page: Column) -> Column:
    """Text of the first title element, else empty."""
    return inner_text(F.regexp_extract(without_code(page), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def headings(page: Column) -> Column:
    """Texts of h1 to h3 in document order."""
    found = F.regexp_extract_all(without_code(page), F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>"), F.lit(1))
    return F.transform(found, lambda x: inner_text(x, ""))


def visible_text(page: Column) -> Column:
    """All text of the body that a reader sees."""
    body = F.regexp_extract(without_code(page), r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    return inner_text(body)


def may_redirect(page: Column) -> Column:
    """Cheap test that is true of every page with redirects."""
    return F.lower(page).rlike(r"location\.(?:href|replace)|http-equiv")
