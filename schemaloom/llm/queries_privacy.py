"""Query of the surrogates for personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import pii
from schemaloom.llm.tables import read

#: A real corpus has a secret key of its own.
KEY = "surrogates of the test corpus"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str, key: str = KEY) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, key).select("doc_id", "n_entities", "text")


QUERIES = {"op7_pii_surrogates": op7_pii_surrogates}
ORACLES: dict[str, str] = {}
