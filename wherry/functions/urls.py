"""URL functions as column expressions. Text that is no url gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wherry.functions.text import WHITE

# Endings of files that are no pages.
IGNORED_SUFFIXES = [".zip", ".rar", ".7z", ".tar", ".tar.gz", ".tgz", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".mp3", ".wav", ".mp4", ".avi", ".mov"]
_SUFFIX = r"(?i)(?:" + "|".join(s.replace(".", r"\.") for s in IGNORED_SUFFIXES) + r")$"

_URL = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, k: int) -> Column:
    """Group ``k`` of a http url, read without white space: 1 scheme, 2 host, 3 port, 4 path, 5 query."""
    return F.regexp_extract(F.translate(url, WHITE, ""), _URL, k)


def host(url: Column) -> Column:
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(part(url, 4), "/"), lambda x: x != ""))


def priority(url: Column, parent: Column | None = None) -> Column:
    """Crawl priority: one for https, one for no query, less the depth, two for a root, two for the host of the parent."""
    score = F.when(F.lower(part(url, 1)) == "https", 1).otherwise(0) + F.when(part(url, 5) == "", 1).otherwise(0) - path_depth(url) + F.when(part(url, 4).isin("", "/"), 2).otherwise(0)
    return score if parent is None else score + F.when(host(url) == host(parent), 2).otherwise(0)


def is_ignored(url: Column) -> Column:
    """Whether path or any value of the query ends like a file that is no page."""
    values = F.transform(F.split(part(url, 5), "&"), lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)), F.lit("")))
    return F.coalesce(F.try_url_decode(part(url, 4)), part(url, 4)).rlike(_SUFFIX) | F.exists(values, lambda v: v.rlike(_SUFFIX))


def _form(text: Column) -> Column:
    """A name or value of a query decoded and encoded again, so that every spelling becomes one; text with bad escapes stays."""
    plain = F.try_url_decode(text)
    return F.when(plain.isNull() | plain.contains("\ufffd"), text).otherwise(F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def canonical(url: Column) -> Column:
    """Key of a page: lower-case scheme and host, no user, default port or fragment, single slashes, no final index.html or slash, parameters encoded in one way and sorted, one without ``=`` as an empty one."""
    scheme, port = F.lower(part(url, 1)), part(url, 3)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_replace(part(url, 4), "/{2,}", "/"), "/index\\.html$", "")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.transform(F.filter(F.split(part(url, 5), "&"), lambda p: p != ""), lambda p: F.concat(_form(F.substring_index(p, "=", 1)), F.lit("="), _form(F.regexp_extract(p, "=(.*)$", 1))))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(pairs), "&"))).otherwise("")
    return F.when(part(url, 2) != "", F.concat(scheme, F.lit("://"), F.lower(part(url, 2)), shown, path, query))
