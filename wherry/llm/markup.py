"""Markup of four kinds turned into clean text and structural elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Element = tuple[str, str]


def squeeze(text: str) -> str:
    return " ".join(text.split())


# --- which markup -----------------------------------------------------------

_IS_HTML = re.compile(r"<!doctype html|</?(?:html|body|p|h[1-6]|ul|ol|li|div|pre|article|main|section|table|blockquote)\b[^<>]*>", re.I)
_IS_TEX = re.compile(r"\\(?:documentclass|chapter|(?:sub)*section\*?|begin|textbf|textit|emph|item|cite|footnote|href)\b")
_IS_WIKI = re.compile(r"^(={2,6})(?!=)[^\n]*?(?<!=)\1[ \t]*\r?$|\[\[[^\]\n]+\]\]|<(?:math|syntaxhighlight|ref|nowiki)\b|'''", re.M)
_IS_MARKDOWN = re.compile(r"^ {0,3}#{1,6}[ \t]+\S|^ {0,3}(?:```|~~~)|^[^\s>#=-][^\n]*\n {0,3}(?:=+|-{2,})[ \t]*\r?$|\[[^\]\n]*\]\([^)\s]+\)|\*\*[^*\s][^*\n]*\*\*|^\$\$", re.M)


def markup_kind(text: str) -> str:
    """``html``, ``tex``, ``wiki``, ``markdown`` or ``plain``."""
    for kind, pattern in (("html", _IS_HTML), ("tex", _IS_TEX), ("wiki", _IS_WIKI), ("markdown", _IS_MARKDOWN)):
        if pattern.search(text):
            return kind
    return "plain"


# --- formulas in running text -----------------------------------------------

_TEX_FORMULA = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])((?:\\.|[^$\\\n])*?)(?<=\S)\$(?![\d$])", re.S)


def _formulas(text: str, out: list[Element], keep: bool = True) -> str:
    """Adds the formulas of ``text`` to ``out``; the text with the bare TeX, or without formulas."""

    def put(m: re.Match) -> str:
        tex = next(g for g in m.groups() if g is not None)
        out.append(("formula", squeeze(tex)))
        return tex if keep else " "

    return _TEX_FORMULA.sub(put, text)


# --- HTML ---------------------------------------------------------------------

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<!doctype[^>]*>|<\?[^>]*>", re.S | re.I)
_RAW = re.compile(r"<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ASIDE = re.compile(r"<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)|<(nav|header|footer)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
_MATH_CLASS = re.compile(r"class\s*=\s*[\"']?[^\"'>]*\b(?:math|katex|tex)\b", re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())


def _html(text: str, out: list[Element]) -> str:
    text = _ASIDE.sub(" ", _RAW.sub(" ", _COMMENT.sub("", text)))
    clean: list[str] = []  # the page as text, without code and formulas of their own
    open_: list[list] = []  # captures: [kind, parts]; kind "list" only marks where a list began
    at = 0

    def close(k: int) -> None:
        while len(open_) > k:
            kind, parts = open_.pop()
            if kind == "list":
                continue
            body = "".join(parts)
            if kind == "code_block":
                out.append((kind, squeeze(body)))
                clean.append(f"\n{body}\n")
            elif kind == "formula":
                inner = _TEX_FORMULA.fullmatch(body.strip())
                out.append((kind, squeeze(next(g for g in inner.groups() if g is not None) if inner else body)))
                clean.append(body)
            else:
                found: list[Element] = []
                plain = _formulas(body, found)
                if item := squeeze(plain):
                    out.append((kind, item))
                out.extend(found)
                clean.append({"heading": "\n# ", "list_item": "\n- "}[kind] + squeeze(plain) + "\n")

    def say(chunk: str) -> None:
        if not chunk:
            return
        for kind, parts in reversed(open_):
            if kind != "list":
                parts.append(chunk)
                return
        clean.append(chunk)

    def last(*kinds: str) -> int:
        return next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] in kinds), -1)

    for m in _TAG.finditer(text):
        say(html.unescape(text[at : m.start()]))
        at = m.end()
        end, tag, attributes = m[1], m[2].lower(), m[3]
        if last("code_block") >= 0 and tag != "pre":
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            if end:
                if (k := last("list")) >= 0:
                    close(k)
            else:
                open_.append(["list", []])
        elif tag == "li":
            k, item = last("list"), last("list_item")
            if item > k:
                close(item)
            if not end:
                open_.append(["list_item", []])
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if (k := last("heading")) >= 0:
                close(k)
            if not end:
                open_.append(["heading", []])
        elif tag == "pre":
            if (k := last("code_block")) >= 0:
                close(k)
            if not end:
                open_.append(["code_block", []])
        elif tag == "math" or (tag in ("span", "div") and not end and _MATH_CLASS.search(attributes)):
            if not end:
                open_.append(["formula", []])
            elif (k := last("formula")) >= 0:
                close(k)
        elif tag in ("span", "div") and end and open_ and open_[-1][0] == "formula":
            close(len(open_) - 1)
        elif tag not in _INLINE:
            say(" " if open_ else "\n")
    say(html.unescape(text[at:]))
    close(0)
    return _formulas("".join(clean), out)


# --- LaTeX --------------------------------------------------------------------

_TEX_CODE = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]\n]*\])?(?:(?<=minted\})\{[^}]*\})?(.*?)\\end\{\1\}", re.S)
_TEX_DISPLAY = re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*?)\\end\{\1\}", re.S)
_TEX_HEADING = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section)\*?\s*(?:\[[^\]]*\])?\s*(?=\{)")
_TEX_DROP = re.compile(r"\\(?:label|cite[pt]?|footnote|ref|eqref|pageref|index|includegraphics|vspace|hspace|bibliographystyle|bibliography|usepackage|documentclass)\*?\s*(?:\[[^\]]*\])?\s*(?=\{)")
_TEX_ITEM = re.compile(r"\\item\b\s*(?:\[[^\]]*\])?|\\(begin|end)\{[^}]*\}(?:\[[^\]]*\])?")
_TEX_ESCAPES = {r"\%": "%", r"\&": "&", r"\_": "_", r"\#": "#", r"\$": "$", r"\{": "{", r"\}": "}", r"\textbackslash": "\\", r"\ldots": "…", r"\dots": "…"}


def _braced(text: str, at: int) -> int:
    """The index after the group that opens at ``at``."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(text)


def _tex_plain(text: str) -> str:
    """TeX without commands; arguments of text commands stay."""
    parts, at = [], 0
    for m in _TEX_DROP.finditer(text):
        if m.start() >= at:
            parts.append(text[at : m.start()])
            at = _braced(text, m.end())
    text = "".join(parts) + text[at:]
    text = re.sub(r"\\href\s*\{[^{}]*\}\s*(?=\{)|\\(?:textcolor|fontsize)\s*\{[^{}]*\}\s*(?=\{)", "", text)
    text = text.replace("\\\\", " ")
    text = re.sub(r"\\(?:%|&|_|#|\$|\{|\}|textbackslash\b|l?dots\b)", lambda m: {"{": "\x01", "}": "\x02"}.get(_TEX_ESCAPES[m[0]], _TEX_ESCAPES[m[0]]), text)
    text = re.sub(r"\\(?:begin|end)\{[^}]*\}", " ", text)
    text = re.sub(r"\\[a-zA-Z]+\*?\s*(?:\[[^\]]*\])?(?=\{)|\\[a-zA-Z]+\*?\s*", "", text)
    text = re.sub(r"\\[,;:! ]|~", " ", text)
    return text.replace("{", "").replace("}", "").replace("\x01", "{").replace("\x02", "}")


def _tex(text: str, out: list[Element]) -> str:
    kept: list[str] = []

    def keep(kind: str, body: str) -> str:
        out.append((kind, squeeze(body)))
        kept.append(body.strip("\n"))
        return f"\x00{len(kept) - 1}\x00"

    text = _TEX_CODE.sub(lambda m: keep("code_block", m[2]), text)
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    text = _TEX_DISPLAY.sub(lambda m: keep("formula", re.sub(r"\\label\{[^}]*\}", "", m[2])), text)
    text = _TEX_FORMULA.sub(lambda m: keep("formula", next(g for g in m.groups() if g is not None)), text)

    def finish(part: str) -> str:
        return squeeze(re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], _tex_plain(part)))

    pieces, at = [], 0
    for m in _TEX_HEADING.finditer(text):
        if m.start() < at:
            continue
        end = _braced(text, m.end())
        if title := finish(text[m.end() + 1 : end - 1]):
            out.append(("heading", title))
        pieces += [text[at : m.start()], f"\n# {title}\n"]
        at = end
    text = "".join(pieces) + text[at:]
    clean, at, item = [], 0, False
    for m in [*_TEX_ITEM.finditer(text), None]:
        part = finish(text[at : m.start() if m else len(text)]) if item else ""
        if item and part:
            out.append(("list_item", part))
            clean.append(f"\n- {part}\n")
        elif not item:
            clean.append(re.sub("\x00(\\d+)\x00", lambda k: kept[int(k[1])], _tex_plain(text[at : m.start() if m else len(text)])))
        if m:
            item, at = m[0].startswith("\\item"), m.end()
    return "".join(clean)


# --- wiki ---------------------------------------------------------------------

_WIKI_CODE = re.compile(r"<(syntaxhighlight|source|pre)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_WIKI_MATH = re.compile(r"<math\b[^>]*>(.*?)</math\s*>", re.S | re.I)
_WIKI_DROP = re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>|<!--.*?-->|__[A-Z]+__|\{\|.*?^\|\}", re.S | re.I | re.M)
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_WIKI_LINE = re.compile(r"^(={1,6})[ \t]*(?!=)(.+?)[ \t]*(?<!=)\1[ \t]*$")


def _wiki_plain(text: str) -> str:
    while (less := _WIKI_TEMPLATE.sub("", text)) != text:
        text = less
    text = re.sub(r"\[\[(?:File|Image|Category|文件|图像|分类):[^\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp)://\S+(?:\s+([^\]]*))?\]", lambda m: m[1] or "", text)
    return html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", re.sub(r"'{2,5}", "", text)))


def _wiki(text: str, out: list[Element]) -> str:
    kept: list[str] = []

    def keep(kind: str, body: str) -> str:
        out.append((kind, squeeze(body)))
        kept.append(body.strip("\n"))
        return f"\x00{len(kept) - 1}\x00"

    text = _WIKI_CODE.sub(lambda m: keep("code_block", html.unescape(m[2])), text)
    text = _WIKI_MATH.sub(lambda m: keep("formula", html.unescape(m[1])), text)
    lines = []
    for line in _WIKI_DROP.sub("", text).splitlines():
        bare = line.strip()
        if m := _WIKI_LINE.match(bare):
            kind, body, lead = "heading", m[2], "# "
        elif m := re.match(r"[*#]+[:;]*[ \t]*(.*)", bare):
            kind, body, lead = "list_item", m[1], "- "
        else:
            kind, body, lead = "", line, ""
        plain = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], _wiki_plain(body))
        if kind and (item := squeeze(plain)):
            out.append((kind, item))
            plain = item
        lines.append(lead + plain)
    return "\n".join(lines)


# --- Markdown -------------------------------------------------------------------

_MD_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*$")
_MD_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_MD_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")


def _md_plain(text: str) -> str:
    spans: list[str] = []

    def span(m: re.Match) -> str:
        spans.append(m[2].strip() if m[1] else m[0][1:])
        return f"\x00{len(spans) - 1}\x00"

    text = re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)|\\([!-/:-@\[-`{-~])", span, text)
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", text)
    text = re.sub(r"<(https?://[^>]+)>", r"\1", text)
    text = re.sub(r"</?[a-zA-Z][^<>]*>", "", text)
    for _ in range(3):
        text = re.sub(r"(\*{1,3})(?=\S)([^*]+?)(?<=\S)\1(?!\*)", r"\2", text)
    text = re.sub(r"(?<![^\W_])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?![^\W_])", r"\2", text)
    text = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", text)
    return re.sub("\x00(\\d+)\x00", lambda m: spans[int(m[1])], html.unescape(text))


def _markdown(text: str, out: list[Element]) -> str:
    clean: list[str] = []
    paragraph: list[str] = []  # lines of the block that is open
    mode = ""  # "", "list_item"

    def flush(kind: str = "") -> None:
        nonlocal mode
        if paragraph:
            body = "\n".join(paragraph)
            found: list[Element] = []
            kept: list[str] = []

            def keep(m: re.Match) -> str:
                kept.append(next(g for g in m.groups() if g is not None))
                found.append(("formula", squeeze(kept[-1])))
                return f"\x03{len(kept) - 1}\x03"

            marked = _TEX_FORMULA.sub(keep, re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: m[0].replace("$", "\x04"), body))
            plain = re.sub("\x03(\\d+)\x03", lambda m: kept[int(m[1])], _md_plain(marked.replace("\x04", "$")))
            kind = kind or mode
            if kind and (item := squeeze(plain)):
                out.append((kind, item))
                plain = {"heading": "# ", "list_item": "- "}[kind] + item
            out.extend(found)
            clean.append(plain)
        paragraph.clear()
        mode = ""

    lines = [re.sub(r"^ {0,3}>[ \t]?", "", line) for line in text.splitlines()]
    i, blank = 0, True
    while i < len(lines):
        line = lines[i]
        i += 1
        if m := _MD_FENCE.match(line):
            flush()
            body = []
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            out.append(("code_block", squeeze("\n".join(body))))
            clean.append("\n".join(body))
        elif line.strip() == "$$" or (line.strip().startswith("$$") and "$$" not in line.strip()[2:]):
            flush()
            body = [line.strip()[2:]]
            while i < len(lines) and "$$" not in lines[i]:
                body.append(lines[i])
                i += 1
            if i < len(lines):
                body.append(lines[i].replace("$$", ""))
            i += 1
            out.append(("formula", squeeze("\n".join(body))))
            clean.append("\n".join(body))
        elif not line.strip():
            flush()
        elif m := _MD_ATX.match(line):
            flush()
            paragraph.append(m[1] or "")
            flush("heading")
        elif paragraph and not mode and re.match(r"^ {0,3}(?:=+|-+)[ \t]*$", line):
            flush("heading")
        elif _MD_RULE.match(line):
            flush()
        elif m := _MD_ITEM.match(line):
            flush()
            paragraph.append(m[1])
            mode = "list_item"
        elif blank and not paragraph and re.match(r"^(?: {4}|\t)", line):
            body = [line]
            while i < len(lines) and re.match(r"^(?: {4}|\t)", lines[i]):
                body.append(lines[i])
                i += 1
            out.append(("code_block", squeeze("\n".join(body))))
            clean.append("\n".join(body))
        else:
            paragraph.append(line)
        blank = not line.strip()
    flush()
    return "\n".join(clean)


_PARSERS = {"html": _html, "tex": _tex, "wiki": _wiki, "markdown": _markdown}


def convert(text: str) -> tuple[str, list[Element]]:
    """Clean text and structural elements of ``text``; plain text comes back as it is, without elements.

    In the clean text a heading stands after ``# ``, a list item after ``- ``; code
    and formulas stand without delimiters.
    """
    text = text.replace("\r\n", "\n").replace("\x00", "")
    kind = markup_kind(text)
    if kind == "plain":
        return text, []
    out: list[Element] = []
    clean = re.sub(r"\n{3,}", "\n\n", _PARSERS[kind](text, out)).strip()
    return clean, list(dict.fromkeys(x for x in out if x[1]))


def convert_all(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``row_id, clean, elements`` of every row with text; ``elements`` are distinct (kind, item). Null texts give no row, empty ones an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [convert(x) for x in batch["text"]]
            yield pd.DataFrame({"row_id": batch["row_id"], "clean": [c for c, _ in done], "elements": [[{"kind": k, "item": i} for k, i in e] for _, e in done]})

    source = rows.where(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("row_id"), F.col(text).alias("text"))
    return source.mapInPandas(run, "row_id long, clean string, elements array<struct<kind string, item string>>")


def elements_of(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``row_id, kind, item``: the distinct structural elements of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, k, x) for i, t in zip(batch["row_id"], batch["text"], strict=True) for k, x in convert(t)[1]]
            yield pd.DataFrame(found, columns=["row_id", "kind", "item"])

    source = rows.where(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("row_id"), F.col(text).alias("text"))
    return source.mapInPandas(run, "row_id long, kind string, item string")
