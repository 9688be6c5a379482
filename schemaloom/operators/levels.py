"""Compatibility levels: setting them, and the level in force."""

from pyspark.sql import DataFrame, functions as F

from ..functions.versions import DEFAULT_LEVEL, GLOBAL_SUBJECT, is_settable
from .ordered import SPAN, last_before

UNPROCESSABLE = 422


def check_levels(requests: DataFrame) -> DataFrame:
    """Adds status: 200 for a level that may be set, 422 for any other."""
    return requests.withColumn(
        "status", F.when(is_settable(F.col("level")), F.lit(200)).otherwise(F.lit(UNPROCESSABLE))
    )


def subject_levels(changes: DataFrame) -> DataFrame:
    """Last accepted change per subject; ``changes`` has seq, subject, level."""
    return (
        changes.where(is_settable(F.col("level"))).groupBy("subject").agg(F.max_by("level", "seq").alias("level"))
    )


def global_level(levels: DataFrame) -> DataFrame:
    """Exactly one row, global_level: an ungrouped aggregate."""
    mine = F.when(F.col("subject") == GLOBAL_SUBJECT, F.col("level"))
    return levels.agg(F.coalesce(F.max(mine), F.lit(DEFAULT_LEVEL)).alias("global_level"))


def effective_level(subjects: DataFrame, levels: DataFrame) -> DataFrame:
    """Subject level, else global level (a scalar subquery), else NONE."""
    own = levels.select("subject", F.col("level").alias("_own"))
    return subjects.join(own, "subject", "left").select(
        *subjects.columns, F.coalesce(F.col("_own"), global_level(levels).scalar()).alias("level")
    )


def shown_level(requests: DataFrame, subjects: DataFrame, levels: DataFrame) -> DataFrame:
    """As effective_level, for known subjects that are not deleted; others give 404.

    ``subjects`` has subject, deleted, for subjects with versions. A subject without any is known by
    a level of its own.
    """
    own = levels.select("subject", F.lit(True).alias("_has_level"))
    state = subjects.select("subject", F.col("deleted").alias("_deleted"))
    found = effective_level(requests, levels).join(state, "subject", "left").join(own, "subject", "left")
    shown = F.coalesce(~F.col("_deleted"), F.col("_has_level"), F.lit(False))
    return found.select(
        *requests.columns,
        F.when(shown, F.col("level")).alias("level"),
        F.when(~shown, F.lit(404)).alias("error_code"),
    )


def with_level_in_force(ops: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds own_level (last subject change before the operation) and level (own, else global, else NONE).

    ``ops`` has seq, subject, op, level_set; op is CONFIG for a subject change and GLOBAL for a
    change of the global level. Both as-of lookups run in bounded slots, the global one over ranges
    of the whole log without a broadcast or a one-task window.
    """
    valid = is_settable(F.col("level_set"))
    shared = last_before(ops, [], "seq", F.col("level_set"), (F.col("op") == "GLOBAL") & valid, "_global", span)
    both = last_before(
        shared, ["subject"], "seq", F.col("level_set"), (F.col("op") == "CONFIG") & valid, "own_level", span
    )
    return both.withColumn("level", F.coalesce("own_level", "_global", F.lit(DEFAULT_LEVEL))).drop("_global")


def global_level_history(changes: DataFrame, span: int = SPAN) -> DataFrame:
    """Each accepted global change with the level that was in force before it."""
    accepted = changes.where(is_settable(F.col("level")))
    with_old = last_before(accepted, [], "seq", F.col("level"), F.lit(True), "old_level", span)
    return with_old.withColumn("old_level", F.coalesce("old_level", F.lit(DEFAULT_LEVEL)))
