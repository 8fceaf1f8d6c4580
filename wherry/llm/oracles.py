"""DuckDB SQL for the queries of this package that SQL can express over whole tables."""

_P4 = r"""
with pages as (
  select url, min(content) as content, regexp_extract(lower(regexp_replace(url, '[\s\x{00a0}\x{3000}]+', '', 'g')), '^[^a-z]*[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) as host
  from search_results where content is not null and url is not null group by url),
sizes as (select host, count(*) as n from pages group by host),
keys as (
  select distinct host, url, regexp_replace(regexp_replace(lower(line), '[\s\p{Z}\x{0085}\x{200b}\x{feff}\x{000b}\x{001c}-\x{001f}]+', '', 'g'), '[0-9]+', '0', 'g') as line_key
  from (select host, url, unnest(string_split(content, chr(10))) as line from pages))
select k.host, k.line_key from keys k join sizes s using (host) where k.line_key <> ''
group by k.host, k.line_key, s.n having count(*) >= 5 and count(*) >= 0.05 * s.n
"""

_P6 = """
with p as (select docid, term, max(coalesce(weighted_tf, tf)) as w from postings where docid is not null and term is not null group by docid, term),
n as (select count(distinct docid) as n from p),
d as (select term, count(*) as df from p group by term),
s as (select docid, term, round((1 + log10(w)) * log10(n.n * 1.0e0 / df), 6) as score from p join d using (term), n where w > 0),
r as (select docid, term, row_number() over (partition by docid order by score desc, term) as k from s where score > 0)
select docid, term from r where k <= 3
"""

ORACLES = {
    "p4_found": _P4,
    "p6_found": _P6,
    "p8_found": "select doc_id, kind from documents, containers where octet_length(encode(text)) > capacity",
}
