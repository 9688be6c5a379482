"""From registration logs to numbered versions and numbered schemas."""

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .ordered import SPAN, last_before, number_rows


def first_seen(ops: DataFrame, keys: list[str], out: str = "first_seq") -> DataFrame:
    """First sequence number per key; combines before the shuffle, so repeated keys cost little."""
    return ops.groupBy(*keys).agg(F.min("seq").alias(out))


def number_versions(first: DataFrame, span: int = SPAN) -> DataFrame:
    """Version = position of the first registration within the subject."""
    return number_rows(first, ["subject"], "first_seq", "version", span)


def dedup_schemas(documents: DataFrame) -> DataFrame:
    """One row per distinct content over all subjects; ``documents`` has seq, hash, content.

    The content is grouped by as well: it is a function of the hash, and as a key it stays in the
    hash aggregate, which a text-valued aggregate would not.
    """
    return documents.groupBy("hash", "content").agg(F.min("seq").alias("first_seq"))


def assign_schema_ids(distinct: DataFrame, span: int = SPAN) -> DataFrame:
    """Dense ids by first sequence number, without a global window over the rows.

    The distinct documents are stored first: numbering passes over them twice, and making them again
    would mean to read every text again.
    """
    return number_rows(cut(distinct), [], "first_seq", "schema_id", span)


def new_subjects(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested subjects that do not exist yet."""
    return requested.select("subject").distinct().join(known.select("subject"), "subject", "left_anti")


def live(versions: DataFrame) -> DataFrame:
    return versions.where(~F.col("deleted"))


def subject_deleted(versions: DataFrame) -> DataFrame:
    """A subject is deleted when it has versions and all are tombstones."""
    return versions.groupBy("subject").agg(F.bool_and("deleted").alias("deleted"))


def latest_version(versions: DataFrame, *extra: str) -> DataFrame:
    """Latest live version per subject; a top-1 aggregate that combines before the shuffle."""
    picked: list[Column] = [F.max_by(c, "version").alias(c) for c in ("schema_id", *extra)]
    return live(versions).groupBy("subject").agg(F.max("version").alias("version"), *picked)


def predecessors(live_versions: DataFrame, span: int = SPAN) -> DataFrame:
    """Each live version beside the live version right before it (null for the first)."""
    rows = live_versions.select("subject", "version", "schema_id")
    before = F.struct("version", "schema_id")
    beside = last_before(rows, ["subject"], "version", before, F.lit(True), "_prev", span)
    return beside.select(
        *rows.columns, F.col("_prev.version").alias("prev_version"), F.col("_prev.schema_id").alias("prev_schema_id")
    )
