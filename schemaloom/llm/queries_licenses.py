"""Query of the licence scan, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import license_scan
from schemaloom.llm.license_scan import K, SHARE, SHIFT
from schemaloom.llm.license_templates import NOTICES, PHRASES
from schemaloom.llm.tables import read


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(read(spark, sf_dir, "documents"))


def _values() -> str:
    rows = license_scan.runs(PHRASES, NOTICES)
    return ", ".join(f"('{a}', {b}, {n}, {size}, {i}, '{' '.join(run)}')" for a, b, n, size, i, run in rows)


QUERIES = {"op12_license_scan": op12_license_scan}
ORACLES = {
    "op12_license_scan": rf"""
with templates(label, phrase, template, size, place, run) as (values {_values()}),
texts as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
places as (select rid, w, unnest(range(len(w) - {K - 1})) as pos from texts where len(w) >= {K}),
hits as (
  select rid, pos, t.* from places join templates t on run = array_to_string(w[pos + 1:pos + {K}], ' ')),
banded as (
  select *, unnest(case when phrase then [pos - place]
    else [floor((pos - place) / {SHIFT})::bigint, floor((pos - place) / {SHIFT})::bigint - 1] end) as band
  from hits),
covering as (
  select *, unnest(range(place, place + {K})) as covers from banded),
voted as (
  select rid, label, phrase, template, size, band, min(pos) as first, max(pos) + {K - 1} as last,
    count(distinct covers) as covered
  from covering group by all),
judged as (
  select *, case when phrase then 1.0::double else 2.0::double * covered / (size + last - first + 1) end as score from voted),
whole as (
  select * from judged
  where case when phrase then covered = size else covered >= {SHARE}::double * size and score >= {SHARE}::double end),
best as (
  select * from whole window near as (partition by rid, template order by band)
  qualify phrase
    or not (coalesce(lag(band) over near = band - 1 and lag(score) over near >= score, false)
      or coalesce(lead(band) over near = band + 1 and lead(score) over near > score, false))),
found as (
  select rid, count(*) filter (phrase) as n_base, min(first) filter (phrase) as first_word,
    max(first) filter (phrase) as last_word,
    string_agg(distinct label, ',' order by label) filter (phrase) as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(score) as score
  from best group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
from texts left join found using (rid)"""
}
