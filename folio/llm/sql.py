"""DuckDB SQL of those training-data queries that SQL can express, for the driver's comparison."""

from __future__ import annotations

from folio.llm.shard import Tree


def _draw(node: str, weight: float) -> str:
    return f"-ln((cast(concat('0x', substr(md5(concat(k, '|{node}')), 1, 13)) as bigint) + 0.5) / 4503599627370496.0) / {weight}"


def _least(draws: list[tuple[str, int]]) -> str:
    return "list_min([" + ", ".join(f"{{'d': {d}, 'to': {i}}}" for d, i in draws) + "]).\"to\""


def _placed(tree: Tree, out: str, source: str) -> str:
    """The shard of key ``k``: by region and rack, or by an addition's ticket."""
    top = [(_draw(f"r{r}", sum(map(sum, racks))), r) for r, racks in enumerate(tree.base)]
    top += [(_draw(f"a{i}", w), len(tree.base) + i) for i, (_, _, w) in enumerate(tree.added)]
    racks = " ".join(f"when {r} then {_least([(_draw(f'r{r}k{k}', sum(s)), k) for k, s in enumerate(rs)])}" for r, rs in enumerate(tree.base))
    at, shards = 0, []
    for r, rs in enumerate(tree.base):
        for k, s in enumerate(rs):
            shards.append(f"when {out}_r = {r} and {out}_k = {k} then {_least([(_draw(f'r{r}k{k}s{i}', w), at + i) for i, w in enumerate(s)])}")
            at += len(s)
    return f"""{out}_1 as (select *, {_least(top)} as {out}_r from {source}), {out}_2 as (select *, case {out}_r {racks} end as {out}_k from {out}_1),
    {out}_3 as (select *, case {' '.join(shards)} else {out}_r - {len(tree.base)} + {tree.n_base} end as {out} from {out}_2)"""


#: A byte enters the checksum, then eight marks of -1 each take a step of the reflected polynomial.
_CRC = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(regexp_extract_all(hex(t), '..'), lambda b: [cast(concat('0x', b) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end))"""

SHARD = f"""with d as (select doc_id, coalesce(text, '') as t, coalesce(cast(doc_id as varchar), '') as k from documents),
c as (select doc_id, k, strlen(t) + 1 as size, {_CRC} as text_crc32 from d),
{_placed(Tree.regular(), 'shard', 'c')}, {_placed(Tree.regular().grow(), 'grown_shard', 'shard_3')}
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by substr(md5(concat(k, '|slot')), 1, 13), doc_id, text_crc32, size) - 1 as slot, grown_shard from grown_shard_3"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

MINHASH = f"""with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
x as (select doc_id, unnest(s) as s from s), n as (select doc_id, len(s) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from n union select e.b, r.root from r join e on e.a = r.doc_id)
select n.doc_id, n.n as n_shingles, min(root) as component_id, n.doc_id = min(root) as kept from n join r on r.doc_id = n.doc_id group by n.doc_id, n.n"""

#: Windows of 100 bytes by their hexadecimal digits; a byte goes if a window over it starts earlier too.
SUFFIX = """with d as (select doc_id, hex(coalesce(text, '')) as h from documents),
b as (select doc_id, h, regexp_extract_all(h, '..') as bytes from d),
p as (select doc_id, unnest(range(0, len(bytes) - 99)) as p from b),
w as (select p.doc_id, p.p, md5(substr(d.h, p.p * 2 + 1, 200)) as m from p join d on d.doc_id = p.doc_id),
f as (select doc_id, p from (select doc_id, p, row_number() over (partition by m order by doc_id, p) as k from w) where k > 1),
g as (select doc_id, p, p - coalesce(max(p) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), -1000) as gap from f),
i as (select doc_id, p, sum(case when gap > 100 then 1 else 0 end) over (partition by doc_id order by p) as i from g),
c as (select doc_id, min(p) as a, max(p) + 100 as z from i group by doc_id, i),
k as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from c),
t as (select k.doc_id, string_agg(substr(d.h, before * 2 + 1, (a - before) * 2), '' order by a) as h, max(z) as z, sum(z - a) as n_removed, count(*) as n_spans from k join d on d.doc_id = k.doc_id group by k.doc_id)
select d.doc_id, length(d.h) // 2 as n_bytes, coalesce(t.n_removed, 0) as n_removed, coalesce(t.n_spans, 0) as n_spans,
  sha256(unhex(case when t.doc_id is null then d.h else concat(t.h, substr(d.h, t.z * 2 + 1)) end)) as kept_sha256 from d left join t on t.doc_id = d.doc_id"""
