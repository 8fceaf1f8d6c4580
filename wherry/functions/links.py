"""Links made absolute and normal, in Python: used where a page is parsed anyway."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

# Ports that go without saying.
DEFAULT_PORTS = {"http": 80, "https": 443}
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}")
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~")


def _escapes(text: str, safe: str) -> str:
    """Percent escapes in upper case, those of unreserved characters resolved, other characters than ``safe`` escaped."""

    def one(m: re.Match) -> str:
        c = chr(int(m[0][1:], 16))
        return c if c in _PLAIN else m[0].upper()

    return quote(_ESCAPE.sub(one, text), safe=safe + "%")


def _dots(path: str) -> str:
    """``path`` without ``.`` and ``..``, beginning with a slash."""
    out: list[str] = []
    parts = path.split("/")[1:] if path.startswith("/") else path.split("/")
    for part in parts:
        if part == "..":
            out = out[:-1]
        elif part != ".":
            out.append(part)
    if parts and parts[-1] in (".", ".."):
        out.append("")
    return "/" + "/".join(out)


def normalise_link(href: str | None, base: str = "") -> str | None:
    """Absolute http url of a link on the page ``base``, else None.

    Scheme and host in lower case (the host by its IDNA form), no default port,
    user, fragment or dot segments, at least ``/`` as path, percent escapes in one
    form. A host with a percent sign or a port that is no number is none.
    """
    link = (href or "").strip()
    if not link or link.lower().startswith("javascript:"):
        return None
    try:
        parts = urlsplit(urljoin(base.strip(), link))
        host, port = parts.hostname, parts.port
        if parts.scheme not in DEFAULT_PORTS or not host or "%" in host:
            return None
        host = host.encode("idna").decode() if not host.isascii() else host
    except (UnicodeError, ValueError):
        return None
    shown = f"[{host}]" if ":" in host else host
    netloc = shown if port in (None, DEFAULT_PORTS[parts.scheme]) else f"{shown}:{port}"
    return urlunsplit((parts.scheme, netloc, _escapes(_dots(parts.path), "/:@!$&'()*+,;="), _escapes(parts.query, "/?:@!$&'()*+,;="), ""))
