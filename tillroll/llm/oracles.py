"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

_TURNS = """
with rows as (
  select conv_id, turn, coalesce(role,'') r, coalesce(text,'') x from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
"""
# Fixed value: the polynomial of CRC-32, which DuckDB has no function for.
_MANIFEST = """
with recursive
table_(t) as (
  select list_transform(range(256), lambda i: list_reduce([i::bigint] || [0,0,0,0,0,0,0,0],
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))),
rows as (
  select row_number() over () k, doc_id, lang, n_chars,
    list_transform([doc_id::varchar, source, lang, n_chars::varchar, text],
      lambda v: coalesce(strlen(v)::varchar || ':' || v, '-')) parts,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint),
      lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]))) % 7 = 0 and n_chars is not null as changed
  from documents, table_),
leaves as (
  select k, doc_id, case when lang is null then '' else '=' || lang end tree,
    sha256(array_to_string(parts, '')) leaf,
    case when changed then sha256(array_to_string(parts[1:3] || [strlen((n_chars + 1)::varchar)::varchar || ':' || (n_chars + 1)::varchar] || parts[5:5], ''))
    else sha256(array_to_string(parts, '')) end start
  from rows),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf, k) - 1 p, count(*) over (partition by tree) n
  from leaves),
own(tree, l, p, h, n) as (
  select tree, 0, p, leaf, n from placed
  union all
  select tree, l + 1, p // 2, sha256(string_agg(h, '' order by p)), (min(n) + 1) // 2 from own where n > 1 group by tree, l, p // 2),
roots as (
  select tree, l height, h subroot, row_number() over (order by tree) - 1 p, count(*) over () n from own where n = 1),
upper_(l, p, h, n) as (
  select 0, p, subroot, n from roots
  union all
  select l + 1, p // 2, sha256(string_agg(h, '' order by p)), (min(n) + 1) // 2 from upper_ where n > 1 group by l, p // 2),
nodes as (
  select tree, l, p, h from own where n > 1
  union all
  select r.tree, r.height + u.l, u.p, u.h from upper_ u, roots r where u.n > 1 and u.p = xor(r.p >> u.l, 1::bigint)),
-- Where each leaf stands on every level: in its tree, then among the roots.
stands as (
  select a.k, o.l, a.p >> o.l i from placed a join (select distinct tree, l from own where n > 1) o using (tree)
  union all
  select a.k, r.height + u.l, r.p >> u.l from placed a join roots r using (tree), (select distinct l from upper_ where n > 1) u),
beside as (
  select s.k, s.l, s.i % 2 = 1 as is_right, coalesce(x.h, '') h
  from stands s join placed a using (k) left join nodes x on x.tree = a.tree and x.l = s.l and x.p = xor(s.i, 1::bigint)),
folded(k, l, h) as (
  select k, 0, start from placed
  union all
  select f.k, f.l + 1, sha256(case when b.is_right then b.h || f.h else f.h || b.h end)
  from folded f join beside b on b.k = f.k and b.l = f.l),
proofs as (select k, string_agg(h, '' order by l) proof from beside group by k),
ends as (select k, arg_max(h, l) folded_root from folded group by k)
select a.doc_id, a.leaf, r.subroot, u.h root, sha256(coalesce(q.proof, '')) proof_sha256,
  e.folded_root, e.folded_root = u.h verified
from placed a join roots r using (tree) join ends e using (k) left join proofs q using (k),
  (select h from upper_ where n = 1) u
"""
_NEGATIVES = """
with numbered as (
  select row_number() over () r, vec_id, label, embedding from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
rows as (
  select r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
    list_transform(embedding, lambda x: floor(256 * x::double)) v
  from numbered),
scores as (
  select a.r, a.vec_id anchor_id, x.r xr, x.vec_id, a.label = x.label same, list_inner_product(a.v, x.v)::bigint score
  from rows a, rows x where a.vec_id % 50 = 0 and a.r <> x.r),
positives as (
  select *, row_number() over (partition by r order by score desc, vec_id, xr) n from scores where same
  qualify n <= 5),
fitting as (
  select p.anchor_id, p.vec_id positive_id, p.score positive_score, x.vec_id negative_id, x.score negative_score,
    (row_number() over (partition by p.r, p.n order by x.score desc, x.vec_id, x.xr))::int rank
  from positives p join scores x on x.r = p.r and not x.same
    and 50 * p.score <= 100 * x.score and 100 * x.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from fitting where rank <= 3
"""
ORACLES = {
    "op12_negatives": _NEGATIVES,
    "op11_merkle": _MANIFEST,
    "op4_chat_format": _TURNS
    + """, folded as (
  select conv_id, count(*) n_turns,
    string_agg(concat(r, chr(10), x, chr(10)), '' order by turn, r, x) turns,
    coalesce(string_agg(x, '' order by turn, r, x) filter (r = 'assistant'), '') loss,
    string_agg(concat('<s>[', r, '] ', replace(replace(replace(replace(x, '%', '%25'), '<', '%3C'), '[', '%5B'), ']', '%5D'), '</s>', chr(10)), '' order by turn, r, x) formatted,
    string_agg(substr(r, 1, 1), '' order by turn, r, x) as roles
  from rows group by conv_id)
select conv_id, n_turns, sha256(turns) turns_sha256, length(loss) loss_chars,
  sha256(loss) loss_sha256, length(formatted) formatted_chars,
  regexp_full_match(roles, 's?ut*a((u|t)t*a)*') as valid
from folded
""",
}
