"""Verdicts for document pairs, and audits of a subject's history.

Pairs are made distinct before they are judged: however often two documents meet, they are compared
once, and the verdict is joined back.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import avro
from ..session import cut_plain
from .elements import Rules, pair_verdicts
from .ordered import SPAN
from .registration import predecessors


def avro_type_issues(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields whose writer type the reader cannot read; pairs (reader_id, writer_id)."""
    r = fields.select(F.col("schema_id").alias("reader_id"), "name", F.col("type").alias("reader_type"))
    w = fields.select(F.col("schema_id").alias("writer_id"), "name", F.col("type").alias("writer_type"))
    return (
        pairs.select("reader_id", "writer_id").distinct().join(r, "reader_id").join(w, ["writer_id", "name"])
        .where(~avro.readable(F.col("reader_type"), F.col("writer_type")))
        .select("reader_id", "writer_id", "name", "reader_type", "writer_type")
    )


def avro_missing_defaults(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Reader fields without a default that the writer does not have."""
    needed = fields.where(~F.col("has_default")).select(F.col("schema_id").alias("reader_id"), "name")
    written = fields.select(F.col("schema_id").alias("writer_id"), "name")
    return (
        pairs.select("reader_id", "writer_id").distinct().join(needed, "reader_id")
        .join(written, ["writer_id", "name"], "left_anti")
        .select("reader_id", "writer_id", "name")
    )


def audit_latest(live_versions: DataFrame, rules: Rules, span: int = SPAN) -> DataFrame:
    """Each live version against its live predecessor: backward, forward, full; true for the first."""
    # used for the pairs and for their answers
    steps = cut_plain(predecessors(live_versions, span))
    pairs = steps.where("prev_schema_id is not null").select(
        F.col("prev_schema_id").alias("existing_id"), F.col("schema_id").alias("proposed_id")
    )
    judged = pair_verdicts(pairs, rules).select(
        F.col("existing_id").alias("prev_schema_id"), F.col("proposed_id").alias("schema_id"), "backward", "forward", "full"
    )
    verdicts = [F.coalesce(c, F.lit(True)).alias(c) for c in ("backward", "forward", "full")]
    return steps.join(judged, ["prev_schema_id", "schema_id"], "left").select(
        "subject", "version", "schema_id", "prev_version", "prev_schema_id", *verdicts
    )
