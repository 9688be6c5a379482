"""Query of the Merkle manifest, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import merkle
from schemaloom.llm.tables import read


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=third)


#: Levels that the SQL writes out: enough for 8^12 documents of a language.
_LEVELS = 12


def _value(x: str) -> str:
    return f"case when {x} is null then '-' else strlen({x}::varchar) || ':' || {x}::varchar end"


def _tree(name: str, group: str) -> str:
    """Tables {name}0 to {name}12 (grp, idx, digest, total) from {name}0, and {name}_nodes, {name}_roots."""
    levels = ", ".join(
        f"""{name}{k} as (select grp, idx // 8 as idx, sha256(string_agg(digest, '' order by idx)) as digest,
          (any_value(total) + 7) // 8 as total from {name}{k - 1} where total > 1 group by grp, idx // 8)"""
        for k in range(1, _LEVELS + 1)
    )
    nodes = " union all ".join(f"select {k} as level, * from {name}{k}" for k in range(_LEVELS + 1))
    return f"""{levels}, {name}_nodes as ({nodes}),
      {name}_roots as (select grp, digest from {name}_nodes where total = 1),
      {name}_paths as (select l.grp, l.idx, n.level,
          coalesce(string_agg(n.digest, '' order by n.idx) filter (n.idx < (l.idx // pow(8, n.level)::bigint)), '') as before,
          coalesce(string_agg(n.digest, '' order by n.idx) filter (n.idx > (l.idx // pow(8, n.level)::bigint)), '') as after
        from {name}0 l join {name}_nodes n on l.grp is not distinct from n.grp and n.total > 1
          and n.idx // 8 = l.idx // pow(8, n.level + 1)::bigint
        group by l.grp, l.idx, n.level)"""


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {
    "op13_merkle_manifest": rf"""
with recursive steps(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8),
docs as (
  select doc_id, lang, sha256({" || ".join(_value(c) for c in merkle.VALUES)}) as leaf,
    case when xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0
      then sha256({" || ".join(_value(c) for c in merkle.VALUES[:-1])} || {_value(
        "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) end as tampered
  from documents, crc),
leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx from docs),
low0 as (select lang as grp, idx, leaf as digest, count(*) over (partition by lang) as total from leaves),
{_tree("low", "lang")},
top0 as (select 0 as grp, row_number() over (order by grp nulls first) - 1 as idx, digest, count(*) over () as total from low_roots),
{_tree("top", "grp")},
langs as (select grp, digest as subroot, row_number() over (order by grp nulls first) - 1 as n from low_roots),
path as (
  select l.doc_id, l.leaf, l.tampered, g.subroot, r.digest as root,
    coalesce((select list(before || '|' || after order by level) from low_paths p where p.grp is not distinct from l.lang and p.idx = l.idx), [])
    || coalesce((select list(before || '|' || after order by level) from top_paths p where p.idx = g.n), []) as way
  from leaves l join langs g on l.lang is not distinct from g.grp, top_roots r),
ends as (
  select *, sha256(replace(array_to_string(way, ''), '|', '')) as proof_sha256,
    list_reduce([coalesce(tampered, leaf)] || way,
      lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) as folded_root
  from path)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from ends"""
}
