"""DuckDB SQL for the queries of this folder that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, strlen(html)::bigint payload_bytes, unhex(sha1(html))::bit::varchar bits, max(page_id) over (partition by html) best from p)
select page_id, payload_bytes, array_to_string(list_transform(range(32),
    lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j: (bits[5 * i + j + 1])::int * (16 >> j::int)))::int]), '') payload_digest,
  case when page_id = best then 'response' else 'revisit' end record_type, case when page_id = best then null else best end refers_to
from d
"""

_OP3 = f"""
with items as (select item_id, coalesce({_PLAIN.format(_LOWER)}, []) w from benchmark where item_id is not null),
windows as (
  select distinct item_id, least(13, len(w)) m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') k
  from (select *, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from items where len(w) > 0)),
docs as (select doc_id, coalesce({_PLAIN.format(_LOWER)}, []) w from documents),
places as (
  select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') k
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from docs, (select distinct m from windows) where len(w) >= m)),
found as (select doc_id, item_id, p.m, i from places p join windows using (m, k)),
hit as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + m)) j from found) group by doc_id),
item as (select doc_id, count(*) n, string_agg(s, ',' order by s) ids from (select distinct doc_id, item_id::varchar s from found) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(hit.n, 0)::bigint n_hit, coalesce(item.n, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) contaminated,
from docs d left join hit using (doc_id) left join item using (doc_id)
"""

_OP5 = f"""
with recursive words as (select doc_id, coalesce({_SPACED.format(_LOWER)}, []) w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) s from words),
each as (select doc_id, len(s) n, unnest(s) k from sets),
links as (
  select a.doc_id x, b.doc_id y from each a join each b on a.k = b.k and a.doc_id != b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by all having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(x, y) as (select doc_id, doc_id from sets union select reach.x, links.y from reach join links on reach.y = links.x)
select doc_id, len(s)::bigint n_shingles, component_id from sets join (select x doc_id, min(y) component_id from reach group by x) using (doc_id)
"""

_OP8 = r"""
with docs as (select doc_id, string_split(text, chr(10)) ls from documents where doc_id is not null and text is not null),
raw as (select doc_id, unnest(ls) x, unnest(range(len(ls))) line from docs),
full_lines as (select doc_id, x, line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) n, row_number() over (partition by doc_id order by line) pos
  from raw where regexp_matches(x, '[^\x20\x09-\x0D]')),
sums as (select *, sum(n) over (partition by doc_id order by pos) e, sum(n) over (partition by doc_id order by pos) - n b from full_lines),
spans as (
  select doc_id, pos p, (select min(s.pos) from sums s where s.doc_id = t.doc_id and s.pos >= t.pos and s.e - t.b >= 50) q from sums t
  union select doc_id, (select max(s.pos) from sums s where s.doc_id = t.doc_id and s.pos <= t.pos and t.e - s.b >= 50) p, pos q from sums t),
runs as (select s.doc_id, p, q, string_agg(x, chr(10) order by pos) txt, min(line) top, max(line) bottom
  from spans s join full_lines f on f.doc_id = s.doc_id and pos between p and q where p is not null and q is not null group by all),
firsts as (select txt, min((doc_id, p, bottom)) f from runs group by txt),
later as (
  select doc_id, p, q, top, bottom, struct_extract(f, 1) fdoc, p - struct_extract(f, 2) away, struct_extract(f, 3) fbottom
  from runs join firsts using (txt) where (doc_id, p) > (struct_extract(f, 1), struct_extract(f, 2))),
marked as (select *, coalesce(p > 1 + max(q) over (partition by doc_id, fdoc, away order by p, q rows between unbounded preceding and 1 preceding), true) new from later),
numbered as (select *, sum(new::int) over (partition by doc_id, fdoc, away order by p, q rows unbounded preceding) k from marked),
maximal as (select doc_id, fdoc, min(top) top, max(bottom) bottom, max(fbottom) fbottom from numbered group by doc_id, fdoc, away, k),
gone as (
  select distinct doc_id, line from (select *, unnest(range(top, bottom + 1)) line from maximal)
  where fdoc != doc_id or line > fbottom),
kept as (select doc_id, string_agg(x, chr(10) order by line) txt from raw where (doc_id, line) not in (select (doc_id, line) from gone) group by doc_id),
count_gone as (select doc_id, count(*) n from gone group by doc_id)
select d.doc_id, case when g.n is null then d.text else coalesce(k.txt, '') end as text,
  coalesce(len(string_split(d.text, chr(10))), 0)::bigint n_lines, coalesce(g.n, 0)::bigint n_removed
from documents d left join kept k using (doc_id) left join count_gone g using (doc_id)
"""

ORACLES = {"op1_warc": _OP1, "op8_line_dedup": _OP8, "op3_decontamination": _OP3, "op5_jaccard_join": _OP5}
