"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import secret_scan
from schemaloom.llm.tables import read


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(read(spark, sf_dir, "documents"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLES: dict[str, str] = {}
