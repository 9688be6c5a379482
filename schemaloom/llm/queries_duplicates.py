"""Query of the near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm.near_duplicates import near_duplicates
from schemaloom.llm.tables import read


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
ORACLES: dict[str, str] = {}
