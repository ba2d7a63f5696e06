"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP4_DECONTAMINATE = r"""
with docs as (
  select row_number() over () as row, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from documents),
items as (
  select item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) as n,
    array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i
        from items where len(w) > 0)),
lengths as (select distinct n from windows),
spans as (
  select row, n, i, array_to_string(w[i:i + n - 1], ' ') as t
  from (select row, w, n, unnest(range(1, len(w) - n + 2)) as i
        from docs, lengths where len(w) >= n)),
hits as (select distinct row, n, i, item_id from spans join windows using (n, t)),
covered as (
  select row, count(distinct p) as n_hit
  from (select distinct row, unnest(range(i, i + n)) as p from hits) group by row),
named as (
  select row, count(*) as n_items, string_agg(s, ',' order by s) as s
  from (select distinct row, cast(item_id as varchar) as s from hits) group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
  n_hit is not null as contaminated
from docs left join covered using (row) left join named using (row)
"""


def _floor_mean(total: str) -> str:
    """The whole quotient of a sum and the count n, rounded down; SQL's own rounds to zero."""
    return f"cast(({total} - ((({total}) % n) + n) % n) // n as bigint)"


def _op12_rounds(rounds: int, width: int) -> str:
    """The assignments a0, a1, ... and the codebooks b1, b2, ... made from them."""
    distance = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, width + 1))
    sums = ", ".join(f"sum(x[{i}]) as s{i}" for i in range(1, width + 1))
    means = ", ".join(_floor_mean(f"s{i}") for i in range(1, width + 1))
    text = ""
    for k in range(rounds + 1):
        text += f"""a{k} as (select r, p, min(({distance}) * 64 + e) as m from parts join b{k} using (p) group by r, p),
"""
        if k < rounds:
            text += f"""s{k} as (select p, m % 64 as e, count(*) as n, {sums} from a{k} join parts using (r, p) group by 1, 2),
b{k + 1} as (select p, e, case when n is null then c else [{means}] end as c from b{k} left join s{k} using (p, e)),
"""
    return text


OP12_VECTOR_CODES = f"""
with kept as (
  select row_number() over () as r, vec_id, label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as (select r, p, v[p * 4 + 1:p * 4 + 4] as x from kept, range(16) as t(p)),
picked as (
  select r, row_number() over (order by vec_id, v) - 1 as e from kept where vec_id is not null
  qualify e < 64),
b0 as (select p, e, x as c from parts join picked using (r)),
{_op12_rounds(2, 4)}
coded as (
  select r, string_agg(printf('%02x', m % 64), '' order by p) as code,
    cast(sum(m // 64) as bigint) as error
  from a2 group by r),
rows as (select vec_id, label, code, error from kept join coded using (r)),
digest as (
  select sha256(string_agg(cast(v as varchar), ',' order by p, e, i)) as codebooks_sha256
  from (select p, e, unnest(c) as v, unnest(range(1, 5)) as i from b2))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  codebooks_sha256
from rows, digest
"""

# CRC-32 by its definition: eight steps a byte with the reversed polynomial.
_CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(cast({} as varchar), ''),
  lambda ch: cast(ascii(ch) as bigint)),
  lambda a, b: list_reduce([xor(a, b)] || cast(range(8) as bigint[]),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP13_PREFIX_TRIE = f"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first,
      md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) - 1 as k
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 5 as base, {_CRC32.format('conv_id')} % 9 as h
  from (select distinct conv_id from own)),
turns as (
  select convs.conv_id, 0 as part, k, role, text from convs join own on own.conv_id = base and k < h
  union all
  select conv_id, 1, k, role, text from convs join own using (conv_id) where k >= h),
paths as (
  select conv_id, coalesce(list(len(role) || ':' || role || text order by part, k)
      filter (part is not null), []) as path,
    coalesce(list(strlen(text) order by part, k) filter (part is not null), []) as bytes
  from convs left join turns using (conv_id) group by conv_id),
prefixes as (
  select conv_id, d as depth, path[1:d] as path, coalesce(bytes[d], 0) as bytes, d = len(path) as ends
  from (select *, unnest(range(0, len(path) + 1)) as d from paths)),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '') as members
  from prefixes group by path, depth),
kids as (
  select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n_children
  from nodes where depth > 0 group by 1, 2),
counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (path, depth)),
sums as (
  select up.path, up.depth, count(*) filter (low.n_children = 0) as n_leaves,
    cast(sum((low.n_convs - 1) * low.bytes) as bigint) as saved_tokens
  from counted as low, unnest(range(0, low.depth + 1)) as t(d)
  join counted as up on up.depth = d and up.path = low.path[1:d]
  group by 1, 2)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children,
  n_leaves, saved_tokens, sha256(n.members) as ends_sha256
from counted as n join sums using (path, depth)
left join counted as p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]
"""


def _shingle_components(percent: int) -> str:
    """doc_id, n_shingles, component_id: links of different shingle sets, followed to their ends."""
    return f"""
with recursive docs as (
  select row_number() over () as r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
  from documents),
sets as (
  select r, doc_id, list_sort(list_distinct(case
    when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s
  from docs),
classes as (
  select min(r) as c, min(doc_id) as least, len(s) as n, s from sets
  where len(s) > 0 and doc_id is not null group by s),
members as (select c, n, unnest(s) as x from classes),
links as (
  select a.c as u, b.c as v from members as a join members as b on a.x = b.x and a.c < b.c
    and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent}
  group by a.c, b.c, a.n, b.n
  having count(*) * 100 >= (a.n + b.n - count(*)) * {percent}),
same_id as (
  select c, doc_id from sets join classes using (s) where doc_id is not null),
tied as (
  select u, v from links union select a.c, b.c from same_id as a join same_id as b using (doc_id) where a.c <> b.c),
edges as (select u, v from tied union select v, u from tied),
reach as (select c, c as root from classes union select edges.v, root from reach join edges on edges.u = c),
parts as (select reach.c, min(least) as component_id from reach join classes on classes.c = root group by reach.c),
answer as (
  select doc_id, cast(len(sets.s) as bigint) as n_shingles,
    case when doc_id is not null then coalesce(component_id, doc_id) end as component_id
  from sets left join classes on classes.s = sets.s and doc_id is not null left join parts using (c))
"""


OP8_MINHASH_DEDUP = _shingle_components(85) + """
select *, coalesce(doc_id = component_id, true) as kept from answer
"""

OP11_SET_JOIN = _shingle_components(90) + """
select * from answer
"""
