"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

Rows of the result are documents with their token ids. A stage that filters drops whole rows and leaves the others as
they are; the stage for personal data changes texts (and with them n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import byte_bpe, decontaminate, pii, quality
from schemaloom.llm.near_duplicates import first_of_each
from schemaloom.llm.queries_privacy import KEY
from schemaloom.llm.queries_tokens import RANKS
from schemaloom.llm.tables import read
from schemaloom.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or a rule that their host is bad at, go."""
    return quality.judge(quality.with_numbers(docs.select(*COLUMNS))).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    return first_of_each(docs.select(*COLUMNS), size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.with_matches(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return found.where(decontaminate.clean()).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows the text."""
    replaced = pii.replace(docs.select(*COLUMNS), KEY)
    changed = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", changed).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit), and whether decoding them gives the text's bytes."""
    model = byte_bpe.encoder(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    encoded = byte_bpe.round_trip(docs.select(*COLUMNS), model)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return encoded.select("doc_id", "lang", "source", "n_chars", n_tokens, "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_level_bpe),
]

#: Near-duplicates, alignments, surrogates and merges have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is stored in the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
