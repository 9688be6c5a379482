"""Registration, first-seen schemas and compatibility checks over streams.

The order is the sequence number of an operation, not event time.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.versions import GLOBAL_SUBJECT, is_settable
from ..operators import replay
from ..operators.elements import Documents
from ..session import cut
from ..sources.snapshots import CatalogStore


def register_batch(store: CatalogStore, docs: Documents, fold_ops: int = replay.FOLD_OPS) -> Callable:
    """The foreachBatch function that folds a micro-batch of log rows onto the stored catalog.

    It reads the state as of the earlier batches only and replaces the directories of its own batch,
    so a retried batch gives the same state. Operations below the high-water mark of the earlier
    batches came too late: they are written to the rejected table.
    """

    def fold(rows: DataFrame, batch: int) -> None:
        rows = cut(rows)  # the source is read once
        mark = store.high_water(batch)
        late = rows.where(F.col("seq") <= mark)
        store.write("rejected", late.select("subject", "seq", "op", F.lit("late").alias("reason")), batch)
        log = rows.where(F.col("seq") > mark)
        with_past = log.unionByName(_level_rows(store, log, batch, mark))
        touched = log.select("subject").distinct()
        past = store.versions(batch, touched)
        events = replay.replay_events(with_past, docs, past=past, fold_ops=fold_ops)
        store.write("outcomes", events, batch)
        done = store.read_batch("outcomes", batch)
        store.write("version_events", _version_events(done), batch)
        store.write("levels", _level_changes(log), batch)
        store.write("marks", log.agg(F.max("seq").alias("seq")).where("seq is not null"), batch)

    return fold


def _level_rows(store: CatalogStore, log: DataFrame, batch: int, mark: int) -> DataFrame:
    """The levels in force before the batch, as log rows right below its operations."""
    levels = store.levels(batch)
    wanted = levels.join(log.select("subject").distinct(), "subject", "left_semi").unionByName(
        levels.where(F.col("subject") == GLOBAL_SUBJECT)
    )
    # the row of a subject needs no sequence number of its own: it is the first of its subject
    return wanted.select(
        F.lit(mark).cast("bigint").alias("seq"),
        "subject",
        F.when(F.col("subject") == GLOBAL_SUBJECT, "GLOBAL").otherwise("CONFIG").alias("op"),
        F.lit(None).cast("int").alias("schema_id"),
        F.col("level").alias("level_set"),
        F.lit(0).alias("delete_version"),
    )


def _version_events(events: DataFrame) -> DataFrame:
    """Added and deleted versions of an event table, in the shape of the store."""
    return events.where(F.col("status").isin("added", "deleted")).select(
        "subject",
        F.explode("versions").alias("version"),
        "schema_id",
        (F.col("status") == "deleted").alias("deleted"),
        "seq",
    )


def _level_changes(log: DataFrame) -> DataFrame:
    subject = F.when(F.col("op") == "GLOBAL", F.lit(GLOBAL_SUBJECT)).otherwise(F.col("subject"))
    # a refused level changes nothing
    return log.where(F.col("op").isin("CONFIG", "GLOBAL") & is_settable(F.col("level_set"))).select(
        subject.alias("subject"), F.col("level_set").alias("level"), "seq"
    )


def stream_register(log: DataFrame, docs: Documents, store: CatalogStore, checkpoint: str) -> DataStreamWriter:
    """Register, delete and set levels from a stream of log rows; start() runs it."""
    return log.writeStream.foreachBatch(register_batch(store, docs)).option("checkpointLocation", checkpoint)


def first_seen(documents: DataFrame) -> DataFrame:
    """Each hash once, forever: without a watermark, because one would forget old hashes."""
    return documents.dropDuplicates(["hash"])


def check(requests: DataFrame, newest: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Proposed documents of a stream against the latest version of their subject.

    ``newest`` (subject, existing_id, level) and ``verdicts`` (existing_id, proposed_id, backward,
    forward, full) are static tables, joined to each micro-batch.
    """
    joined = requests.join(newest, "subject", "left").join(verdicts, ["existing_id", "proposed_id"], "left")
    level = F.col("level")
    verdict = (
        F.when(F.col("existing_id").isNull() | (level == "NONE"), True)
        .when(level.startswith("BACKWARD"), F.col("backward"))
        .when(level.startswith("FORWARD"), F.col("forward"))
        .otherwise(F.col("full"))
    )
    return joined.select("seq", "subject", "proposed_id", verdict.alias("is_compatible"))
