"""Fragments of DuckDB SQL that say the same as the column expressions."""

from __future__ import annotations

from wherry.functions.html import ENTITIES
from wherry.functions.text import STOPWORDS

WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
HAN = r"\x{4e00}-\x{9fff}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(WHITE)}, ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def compact(x: str) -> str:
    return f"regexp_replace({fold(f'coalesce({x}, {quoted('')})')}, '[^0-9a-z{HAN}]+', '', 'g')"


def tokens(x: str) -> str:
    spaced = f"regexp_replace({fold(f'coalesce({x}, {quoted('')})')}, '([{HAN}]+)', ' \\1 ', 'g')"
    runs = f"regexp_extract_all({spaced}, '[\\p{{L}}\\p{{N}}]+')"
    return f"flatten(list_transform({runs}, lambda r: case when regexp_matches(r, '^[{HAN}]') then list_transform(range(1, greatest(2, length(r))), lambda k: substr(r, k, 2)) else [r] end))"


def terms(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: t <> '' and t not in ({', '.join(map(quoted, STOPWORDS))}))"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([。！？!?；;])', '\\1' || chr(1), 'g'), chr(1)), lambda s: {clean('s')}), lambda s: s <> '')"


def without_code(x: str) -> str:
    x = f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "noscript", "template", "svg"):
        x = f"regexp_replace({x}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'gis')"
    return x


def unescape(x: str, nbsp: str = " ") -> str:
    for entity, mark in [("&nbsp;", nbsp), *ENTITIES]:
        x = f"replace({x}, {quoted(entity)}, {quoted(mark)})"
    return x


def inner_text(x: str, gap: str = " ") -> str:
    return clean(unescape(f"regexp_replace({x}, '<[^>]*>', {quoted(gap)}, 'g')"))


#: A tag or comment, as a parser sees them.
TAG = r"</?[a-zA-Z][^<>]*>|<!--.*?-->|<![^>]*>"


def pieces(x: str, gap: str) -> str:
    """Text of a fragment as its stripped pieces between tags, joined by ``gap``."""
    marked = unescape(f"regexp_replace({x}, {quoted(TAG)}, chr(1), 'gs')", "\u00a0")
    space = WHITE.removesuffix("+") + "*"
    joined = f"regexp_replace({marked}, {quoted(space + '(?:' + chr(92) + 'x01' + space + ')+')}, {quoted(gap)}, 'g')"
    return f"regexp_replace({joined}, {quoted('^' + WHITE + '|' + WHITE + '$')}, '', 'g')"


_BLOCK = r"(?i)<(p|h[1-6]|ul|ol|div|pre|table|section|article|main|footer|nav)\b"


def paragraphs(x: str, gap: str) -> str:
    """The paragraphs of a page; one that isn't closed ends where the next block begins."""
    closed = f"regexp_replace({x}, {quoted(_BLOCK)}, '</p><\\1', 'g') || '</p>'"
    return f"list_filter(list_transform(regexp_extract_all({closed}, {quoted(r'(?is)<p(?:[ ][^>]*)?>(.*?)</p')}, 1), lambda x: {pieces('x', gap)}), lambda x: x <> '')"


BESIDE = r"(?is)<(?:nav|footer)\b[^>]*>.*?</(?:nav|footer)\s*>"
HOLDERS = [r"(?is)<article\b[^>]*>(.*?)</article\s*>", r"(?is)<main\b[^>]*>(.*?)</main\s*>", r'(?is)<div\b[^>]*class="[^"]*\barticle-content\b[^"]*"[^>]*>(.*)</div\s*>']
#: Every saved page with its parts, for pages as regular as those of the tables.
PAGES = f"""
pg as (select file_id as docid, d.url, {without_code("body")} as s from page_files left join doc_map d on d.docid = file_id),
pb as (select *, case when regexp_matches(s, '(?is)<body') then regexp_extract(s, {quoted(r"(?is)<body[^>]*>(.*?)</body")}, 1) else s end as b from pg),
pp as (select docid, url, {clean(pieces(f"regexp_extract(s, {quoted(r'(?is)<title[^>]*>(.*?)</title')}, 1)", " "))} as title, b,
  list_transform(regexp_extract_all(b, {quoted(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>")}, 1), lambda x: {clean(pieces("x", " "))}) as heads,
  list_transform({paragraphs("b", " ")}, lambda x: {clean("x")}) as paras from pb),
pm as (select docid, coalesce(nullif(title, ''), url) as title, heads, case when len(paras) > 0 then array_to_string(paras, ' ') else {clean(pieces("b", " "))} end as text, url from pp),
px as (select docid, url, title, case when text <> '' then substr(text, 1, 200) else coalesce(heads[1], '') end as abstract, '' as published_date, sha256({clean("concat_ws(' ', title, array_to_string(heads, ' '), text)")}) as content_hash from pm)
"""
#: The latest record of each page as document with title and body, the headings from its file.
DOCS = f"""
m as (select docid, title, abstract, url, published_date, content_hash from page_metadata where docid is not null qualify row_number() over (partition by docid order by record_no desc) = 1),
h as (select file_id as docid, list_transform(regexp_extract_all({without_code("body")}, '(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]\\s*>', 1), lambda x: {inner_text("x", "")}) as headings from page_files),
docs as (select d.docid, m.title, coalesce(h.headings, []) as headings, m.abstract as body, m.published_date, m.content_hash, d.url from doc_map d left join m using (docid) left join h using (docid))
"""
INDEX = f"""{DOCS},
ft as (select docid, 'title' as field, 3 as w, unnest({terms("title")}) as term from docs union all select docid, 'heading', 2, unnest({terms("array_to_string(headings, ' ')")}) from docs union all select docid, 'body', 1, unnest({terms("body")}) from docs),
p as (select docid, term, count(*) as tf, sum(w)::bigint as weighted_tf from ft group by docid, term),
n as (select count(*) as n from docs),
t as (select term, count(*) as df, log10((select n from n) * 1.0e0 / count(*)) as idf from p group by term),
w as (select docid, term, tf, weighted_tf, (1 + log10(weighted_tf)) * idf as weight from p join t using (term)),
l as (select d.docid, coalesce(sqrt(sum(weight * weight)), 0) as length from docs d left join w using (docid) group by d.docid)
"""
VECTORS = f"""{INDEX},
qt as (select query_id, term, count(*) as qtf, min(pos) as first_pos from (select query_id, unnest({terms("text")}) as term, unnest(range(0, len({terms("text")}))) as pos from queries) group by query_id, term),
v as (select query_id, term, first_pos, idf, (1 + log10(qtf)) * idf as qweight from qt join t using (term) where idf <> 0)
"""
SCORES = f"""{VECTORS},
dp as (select query_id, docid, sum(qweight * weight) as dot, min(first_pos) as first_pos from v join w using (term) group by query_id, docid),
qn as (select query_id, sqrt(sum(qweight * qweight)) as qlength from v group by query_id),
s as (select query_id, docid, round(dot / length / qlength, 9) as score, first_pos from dp join qn using (query_id) join l using (docid) where length > 0),
c as (select *, row_number() over (partition by query_id order by score desc, first_pos, docid) as rank_no from s)
"""
RERANKED = f"""{SCORES},
cand as (select * from c where rank_no <= 500),
rt as (select query_id, term, {compact("term")} as ct, idf from v where length({compact("term")}) >= 2),
tx as (select docid, {compact("concat(coalesce(title, ''), coalesce(published_date, ''))")} as tt, {compact("body")} as ta from docs),
cov as (select cand.query_id, cand.docid, coalesce(sum(case when contains(tt, ct) then rt.idf else 0 end) / nullif(sum(rt.idf), 0), 0) as title_share, coalesce(sum(case when contains(ta, ct) then rt.idf else 0 end) / nullif(sum(rt.idf), 0), 0) as abstract_share, coalesce(sum(case when p.term is not null then rt.idf else 0 end) / nullif(sum(rt.idf), 0), 0) as document_share
  from cand join rt using (query_id) join tx using (docid) left join p on p.docid = cand.docid and p.term = rt.term group by cand.query_id, cand.docid),
rr as (select cand.query_id, cand.docid, cand.rank_no, coalesce(title_share, 0) as title_share, coalesce(abstract_share, 0) as abstract_share, coalesce(document_share, 0) as document_share,
  round(1 / log2(rank_no + 1) + 1.25 * coalesce(title_share, 0) + 0.5 * coalesce(abstract_share, 0) + coalesce(document_share, 0), 9) as new_score from cand left join cov using (query_id, docid)),
ranked as (select *, row_number() over (partition by query_id order by new_score desc, rank_no) as new_rank from rr)
"""
