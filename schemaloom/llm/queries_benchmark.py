"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import decontaminate
from schemaloom.llm.tables import read


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES: dict[str, str] = {}
