"""Query of the hard negatives, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import hard_negatives
from schemaloom.llm.tables import read


def labelled(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector of whole numbers; every seventh id carries a wrong label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector")
    return rows.where(hard_negatives.finite(F.col("embedding"))).select("vec_id", label, whole)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(labelled(read(spark, sf_dir, "embeddings")), anchors=F.col("id") % 50 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": """
with vectors as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
pairs as (
  select a.rid, a.vec_id as anchor_id, o.rid as other, o.vec_id, o.label = a.label as same,
    list_inner_product(a.v, o.v)::bigint as score
  from vectors a join vectors o on a.rid <> o.rid where a.vec_id % 50 = 0),
positives as (
  select * from pairs where same qualify row_number() over (partition by rid order by score desc, vec_id) <= 5),
found as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score,
    n.score as negative_score,
    row_number() over (partition by p.rid, p.other order by n.score desc, n.vec_id)::integer as rank
  from positives p join pairs n on p.rid = n.rid and not n.same
    and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from found where rank <= 3"""
}
