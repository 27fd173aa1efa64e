"""DuckDB's SQL for the queries of corpus operators that it can express, each by a plain definition of its result."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Digits of base32; five hexadecimal digits of a digest make four of them.
BASE32 = UPPER + "234567"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


#: Every node that a chain of links leads to, from links (a, b) in both directions.
REACHED = "reached(a, b) as (select distinct a, b from links union select r.a, l.b from reached r join links l on r.b = l.a)"

OP2_SQL = f"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex,
    regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(:[0-9]+)?([^?#]*)\\??([^#]*)', ['host', 'port', 'path', 'query']) as u from pages),
d as (select *, max(page_id) over (partition by payload) as keeper from p)
select page_id, cast(strlen(payload) as bigint) as payload_bytes,
  array_to_string([substr('{BASE32}', 1 + cast((cast('0x' || substr(hex, 1 + 5 * (k // 4), 5) as bigint) >> (15 - 5 * (k % 4))) & 31 as int), 1) for k in range(32)], '') as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type, case when page_id <> keeper then keeper end as refers_to, url,
  case when url = '' then '' else array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || case when u.port in ('', ':80', ':443') then '' else u.port end || ')' || case when u.path = '' then '/' else u.path end || case when u.query = '' then '' else '?' || u.query end end as url_key,
  1577836800 + page_id as captured_at
from d
"""
OP2_SQL = f"""
select *, row_number() over (order by url_key, captured_at, page_id) as position, row_number() over w as nth, lag(captured_at) over w as previous_at
from ({OP2_SQL}) window w as (partition by url_key order by captured_at, page_id)
"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP3_SQL = f"""
with docs as (select doc_id, {_words("text", WORD)} as w from documents),
items as (select item_id, {_words("text", WORD)} as w from benchmark),
windows as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as g
  from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(s) where len(w) > 0),
lengths as (select distinct n from windows),
places as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g from docs, lengths, unnest(range(1, len(w) - n + 2)) r(s)),
found as (select doc_id, item_id, s, n from places join windows using (n, g)),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(s, s + n)) as place from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from found) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)
"""

OP4_SQL = f"""
with recursive docs as materialized (select doc_id, {_words("text", "[^\\x20\\x09-\\x0D]+")} as w from documents),
shingles as materialized (select distinct doc_id, array_to_string(w[s:s + 4], ' ') as g from docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) r(s) where len(w) > 0),
sizes as materialized (select doc_id, count(*) as n from shingles group by 1),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as common from shingles x join shingles y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as materialized (select a, b from shared join sizes sa on sa.doc_id = a join sizes sb on sb.doc_id = b where 100 * common >= 75 * (sa.n + sb.n - common)),
{REACHED},
roots as (select a, min(b) as root from reached group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) as component_id, d.doc_id <= coalesce(root, d.doc_id) as kept
from docs d left join sizes s on s.doc_id = d.doc_id left join roots r on r.a = d.doc_id
"""

OP10_SQL = f"""
with recursive sound as materialized (select vec_id, cast(embedding as double[]) as v from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select x.vec_id as a, y.vec_id as b from sound x join sound y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.95),
counts as (select a, count(*) as n from links group by 1),
{REACHED},
roots as (select a, min(b) as root from reached group by 1)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(root, vec_id)) as component_id, vec_id <= coalesce(root, vec_id) as kept
from embeddings e left join counts c on c.a = e.vec_id left join roots r on r.a = e.vec_id
"""


def _op11_sql() -> str:
    """Four rounds, one common table expression each: nearest entries by exact integer distances, then floors of means."""
    steps = [
        "kept as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings"
        " where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "size as (select 4 * cast(ceil(coalesce(max(len(v)), 0) / 4) as bigint) as width from kept)",
        "padded as materialized (select row_number() over (order by vec_id nulls last, v) - 1 as r, vec_id, label, list_concat(v, list_transform(range(width - len(v)), lambda k: cast(0 as bigint))) as v, width // 4 as step from kept, size)",
        "parts as materialized (select r, p, cast(v[1 + p * step : (p + 1) * step] as double[]) as x, step from padded, range(4) t(p))",
        "book0 as materialized (select p, r as e, x as c from parts where r < 256)",
    ]

    def nearest(k: int) -> str:
        square = "case when step = 0 then 0 else list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) end"
        return f"near{k} as materialized (select r, p, first(x) as x, arg_min(e, (d, e)) as e, min(d) as d from (select r, p, x, e, {square} as d from parts join book{k} using (p)) group by r, p)"

    for k in range(4):
        steps.append(nearest(k))
        steps.append(f"mean{k} as (select p, e, list(m order by j) as c from (select p, e, j, floor(sum(x[j]) / count(*)) as m from near{k}, unnest(range(1, len(x) + 1)) t(j) group by p, e, j) group by p, e)")
        steps.append(f"book{k + 1} as materialized (select p, e, coalesce(m.c, b.c) as c from book{k} b left join mean{k} m using (p, e))")
    steps.append(nearest(4))
    steps.append("coded as (select r, string_agg(format('{:02x}', e), '' order by p) as code, cast(sum(d) as bigint) as error from near4 group by r)")
    steps.append("digest as (select sha256(coalesce(string_agg(cast(cast(v as bigint) as varchar), ',' order by p, e, j), '')) as h from (select p, e, j, c[j] as v from book4, unnest(range(1, len(c) + 1)) t(j)))")
    return f"""
with {", ".join(steps)}
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from padded join coded using (r), digest
"""


OP11_SQL = _op11_sql()


def _field(column: str) -> str:
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || cast({column} as varchar), '-')"


#: CRC-32 of a text's bytes (ASCII), bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}, ''), lambda c: ascii(c)::bigint)), lambda a, b: {steps}), 4294967295::bigint)"
_STEPS = "xor(a, b)"
for _ in range(8):
    _STEPS = f"list_transform([{_STEPS}], lambda z: case when z & 1 = 1 then xor(z >> 1, 3988292384::bigint) else z >> 1 end)[1]"
CRC32 = _CRC.replace("{steps}", _STEPS)


def _levels(name: str, start: str, depth: int) -> list[str]:
    """Tables of a forest's levels from ``start`` (tree, i, h), and one of all nodes with their level."""
    out = [f"{name}0 as materialized (select tree, 0 as lvl, i, h, count(*) over (partition by tree) as n from {start})"]
    for k in range(depth):
        runs = f"select tree, {k + 1} as lvl, i // 8 as i, sha256(string_agg(h, '' order by i)) as h from {name}{k} where n > 1 group by tree, i // 8"
        out.append(f"{name}{k + 1} as materialized (select *, count(*) over (partition by tree) as n from ({runs}))")
    every = " union all ".join(f"select * from {name}{k}" for k in range(depth + 1))
    return [*out, f"{name} as materialized ({every})"]


def _folded(name: str, depth: int, claims: str) -> list[str]:
    """From ``claims`` (d, tree, i, h): for each level the folded digest and the siblings so far."""
    out = [f"{name}_fold0 as materialized ({claims})"]
    for k in range(depth):
        own = f"select c.d, c.tree, c.i // 8 as i, sha256(string_agg(case when n.i = c.i then c.h else n.h end, '' order by n.i)) as h, first(c.said) || coalesce(string_agg(n.h, '' order by n.i) filter (where n.i <> c.i), '') as said"
        up = f"{own} from {name}_fold{k} c join {name}{k} n on n.tree = c.tree and n.i // 8 = c.i // 8 and n.n > 1 group by c.d, c.tree, c.i"
        stay = f"select c.* from {name}_fold{k} c join {name}{k} n on n.tree = c.tree and n.i = c.i and n.n = 1"
        done = f"select c.* from {name}_fold{k} c where c.tree not in (select tree from {name}{k})"
        out.append(f"{name}_fold{k + 1} as materialized ({up} union all {stay} union all {done})")
    return out


#: Levels that the SQL unrolls: 8 ** 6 rows a language, 8 ** 3 languages.
_DEEP, _TOP = 6, 3
_LOWER = f"case when crc % 3 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end"
OP12_SQL = f"""
with docs as materialized (select *, case when doc_id is null then 1 else {CRC32.replace("{x}", "cast(doc_id as varchar)")} end as crc from documents),
rows_ as materialized (select doc_id, lang, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) as leaf,
  sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", f"({_LOWER})")))}) as claim from docs),
leaves as materialized (select *, dense_rank() over (order by encode(lang) nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, row_number() over () as d from rows_),
{", ".join(_levels("part", "(select tree, i, leaf as h from leaves)", _DEEP))},
subroots as materialized (select tree as i, h from part where n = 1),
{", ".join(_levels("top", "(select 0 as tree, i, h from subroots)", _TOP))},
root as (select h as root from top where n = 1),
{", ".join(_folded("part", _DEEP, "select d, tree, i, claim as h, '' as said from leaves"))},
{", ".join(_folded("top", _TOP, f"select d, 0 as tree, tree as i, h, said from part_fold{_DEEP}"))}
select l.doc_id, l.leaf, s.h as subroot, root, sha256(f.said) as proof_sha256, f.h as folded_root, f.h = root as verified
from leaves l join subroots s on s.i = l.tree join top_fold{_TOP} f on f.d = l.d, root
"""

_ESCAPED = r"regexp_replace({x}, '<(\\*)\|', '<\1\\|', 'g')"
_ROLE = _ESCAPED.replace("{x}", "replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
_SAID = "<|im_end|><|im_start|>assistant ok"
OP13_SQL = f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')) t(conv_id, turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, md5(text))) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, md5(text)) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + length({_ROLE}) + 1 + length({_ESCAPED.replace("{x}", "text")}) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from turns group by conv_id
"""
