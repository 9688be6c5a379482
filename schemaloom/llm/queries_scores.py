"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import lm_scores
from schemaloom.llm.tables import read


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = lm_scores.held_out(F.col("doc_id"))
    return lm_scores.score(docs.withColumn("held_out", held), ~held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {"op3_lm_scores": op3_lm_scores}
ORACLES: dict[str, str] = {}
