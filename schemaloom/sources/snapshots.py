"""Catalog state on storage, one directory per batch.

A batch appends what changed: version events, level changes and new schemas. Writing a batch again
replaces its directory, so a retried batch leaves the same state. ``compact`` folds all batches into
one, number -1, so that a stream that starts anew on it (with batch 0) goes on from that state.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION_EVENTS = "subject string, version int, schema_id int, deleted boolean, seq bigint"
LEVELS = "subject string, level string, seq bigint"
OUTCOMES = "subject string, seq bigint, op string, status string, schema_id int, versions array<int>"
REJECTED = "subject string, seq bigint, op string, reason string"
MARKS = "seq bigint"

TABLES = {"version_events": VERSION_EVENTS, "levels": LEVELS, "outcomes": OUTCOMES, "rejected": REJECTED, "marks": MARKS}


class CatalogStore:
    """Append-only batches of a catalog below one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        for table, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(self._batch(table, -1))

    def _batch(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def write(self, table: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self._batch(table, batch))

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """All rows, or those of batches below ``before``."""
        rows = self.spark.read.schema(TABLES[table] + ", batch long").parquet(f"{self.path}/{table}")
        kept = rows if before is None else rows.where(F.col("batch") < before)
        return kept.drop("batch")

    def read_batch(self, table: str, batch: int) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(self._batch(table, batch))

    def versions(self, before: int | None = None, subjects: DataFrame | None = None) -> DataFrame:
        """subject, version, schema_id, deleted; of the given subjects or of all."""
        events = self.read("version_events", before)
        if subjects is not None:
            events = events.join(subjects.select("subject"), "subject", "left_semi")
        return (
            events.groupBy("subject", "version")
            .agg(F.max("schema_id").alias("schema_id"), F.bool_or("deleted").alias("deleted"))
        )

    def levels(self, before: int | None = None) -> DataFrame:
        """subject, level: the last change of each subject."""
        return self.read("levels", before).groupBy("subject").agg(F.max_by("level", "seq").alias("level"))

    def high_water(self, before: int | None = None) -> int:
        """Largest sequence number taken so far, -1 if none; from one row per batch."""
        taken = self.read("marks", before).agg(F.max("seq")).first()[0]
        return -1 if taken is None else taken

    def compact(self, path: str) -> "CatalogStore":
        """Write the current state to another store, below all batches a stream may write there."""
        other = CatalogStore(self.spark, path)
        for table in TABLES:
            rows = self.read(table)
            if table == "version_events":
                rows = rows.groupBy("subject", "version").agg(
                    F.max("schema_id").alias("schema_id"), F.bool_or("deleted").alias("deleted"), F.max("seq").alias("seq")
                )
            elif table == "levels":
                rows = rows.groupBy("subject").agg(F.max_by("level", "seq").alias("level"), F.max("seq").alias("seq"))
            elif table == "marks":
                rows = rows.agg(F.max("seq").alias("seq")).where("seq is not null")
            other.write(table, rows, -1)
        return other
