"""Query of the quality rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import quality
from schemaloom.llm.tables import read

COLUMNS = ("doc_id", *quality.NUMBERS, "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    numbered = quality.with_numbers(docs).drop("text")
    return quality.judge(numbered).select(*COLUMNS)


_RULES = {
    "base": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}


def _each(form: str) -> str:
    return ", ".join(form.format(r=r) for r in _RULES)


#: The verdict from a table `rows` with host, the numbers and doc_id: shared with the pipeline.
JUDGED = f"""
ruled as (select *, {", ".join(f"({rule}) as {r}_failed" for r, rule in _RULES.items())} from numbered),
hosts as (select source as host, count(*) as n, {_each("sum({r}_failed::bigint) as k_{r}")} from ruled group by 1),
means as (select sum(n) as docs, count(*) as hosts, {_each("sum(k_{r}) / sum(n) as m_{r}")} from hosts),
spread as (select docs, hosts, {_each("m_{r}")}, {_each("sum(n * pow(k_{r} / n - m_{r}, 2)) / sum(n) as v_{r}")}
  from hosts h, means group by all),
betas as (select docs, hosts, {_each("m_{r}")}, {_each(
    "case when v_{r} - m_{r} * (1 - m_{r}) * hosts / docs > 1e-12 "
    "then greatest(m_{r} * (1 - m_{r}) / (v_{r} - m_{r} * (1 - m_{r}) * hosts / docs) - 1, 0.001) else 1e12 end as w_{r}")}
  from spread),
verdicts as (select host, {_each("(k_{r} + m_{r} * w_{r}) / (n + w_{r}) > 0.5 as bad_{r}")} from hosts, betas),
judged as (select r.*, not base_failed and not ({" or ".join(f"({r}_failed and bad_{r})" for r in _RULES)}) as kept
  from ruled r join verdicts v on r.source is not distinct from v.host)
"""

#: The numbers of the texts of table {{docs}}.
NUMBERED = r"""
split as (select *, row_number() over () as rid,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from {docs}),
windows as (select rid, i, array_to_string(w[i:i + 7], ' ') as k
  from (select rid, w, unnest(range(1, len(w) - 6)) as i from split)),
again as (select rid, i from windows qualify count(*) over (partition by rid, k) > 1),
gaps as (select rid, least(8, coalesce(lead(i) over (partition by rid order by i) - i, 8)) as g from again),
covered as (select rid, sum(g)::bigint as n_repeat_words from gaps group by 1),
numbered as (select s.* exclude (w, l), len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from split s left join covered using (rid))
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {
    "op2_quality_rules": "with " + NUMBERED.format(docs="documents") + ", " + JUDGED + "select " + ", ".join(COLUMNS) + " from judged"
}
