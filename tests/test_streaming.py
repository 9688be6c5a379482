"""A stream gives what the batch job gives on the same rows."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR, same_rows
from schemaloom.operators import elements, registration, replay
from schemaloom.plans import catalog_queries, compat_queries, document_queries
from schemaloom.sources.snapshots import CatalogStore
from schemaloom.streaming import jobs
from test_replay import shapes


def in_files(df, base, bounds):
    """Write rows as one file per range of seq, and open them as a stream, one file per batch."""
    for low, high in zip(bounds, bounds[1:]):
        part = df.where((F.col("seq") >= low) & (F.col("seq") < high))
        part.coalesce(1).write.mode("append").parquet(f"{base}/src")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture(scope="module")
def log(spark):
    return compat_queries.replay_log(spark, SF_DIR)


def test_register(spark, log, tmp_path):
    docs = catalog_queries.shape_documents(spark, SF_DIR)
    store = CatalogStore(spark, f"{tmp_path}/store")
    stream = in_files(log, tmp_path, [0, 300, 700, 1000])
    run(jobs.stream_register(stream, docs, store, f"{tmp_path}/ck"))
    whole = replay.replay_events(log, docs)
    same_rows(store.versions(), replay.versions_of(whole))
    same_rows(store.read("outcomes"), whole)
    assert store.read("rejected").count() == 0
    # the last batch once more: same state
    jobs.register_batch(store, docs)(log.where("seq >= 700"), 2)
    same_rows(store.versions(), replay.versions_of(whole))
    same_rows(store.compact(f"{tmp_path}/compacted").versions(), replay.versions_of(whole))
    # a row that comes too late is set aside
    jobs.register_batch(store, docs)(log.where("seq = 5"), 3)
    assert [r["seq"] for r in store.read("rejected").collect()] == [5]
    same_rows(store.versions(), replay.versions_of(whole))


def test_first_seen(spark, tmp_path):
    rows = document_queries.raw_documents(spark, SF_DIR).where("hash is not null").select("seq", "hash")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    stream = in_files(rows, tmp_path, [0, 200, 500, 1000])
    run(jobs.first_seen(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck"))
    same_rows(spark.read.parquet(f"{tmp_path}/out").select("hash"), rows.select("hash").distinct())


def test_check(spark, log, tmp_path):
    docs = catalog_queries.shape_documents(spark, SF_DIR)
    newest = registration.latest_version(compat_queries.live_versions(spark, SF_DIR).withColumn("deleted", F.lit(False))).select(
        "subject", F.col("schema_id").alias("existing_id"), F.lit("FULL").alias("level")
    )
    asked = log.where("op = 'REGISTER'").select("seq", "subject", F.col("schema_id").alias("proposed_id"))
    verdicts = elements.pair_verdicts(asked.join(newest, "subject"), docs.rules[0])
    stream = in_files(asked, tmp_path, [0, 500, 1000])
    run(jobs.check(stream, newest, verdicts).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck"))
    same_rows(spark.read.parquet(f"{tmp_path}/out"), jobs.check(asked, newest, verdicts))
    assert spark.read.parquet(f"{tmp_path}/out").select("is_compatible").distinct().count() == 2


def test_refused_level_and_restart_after_compaction(spark, tmp_path):
    docs = shapes(spark, {1: [("a", "int", False)], 2: [("b", "int", False)]})
    rows = [
        (1, "s", "CONFIG", None, "FULL", 0), (2, "s", "REGISTER", 1, None, 0), (3, "s", "CONFIG", None, "WRONG", 0),
        (4, "s", "REGISTER", 2, None, 0), (5, "t", "REGISTER", 2, None, 0),
    ]
    log = spark.createDataFrame(rows, "seq bigint, subject string, op string, schema_id int, level_set string, delete_version int")
    whole = replay.replay_events(log, docs)
    assert {r["seq"]: r["status"] for r in whole.collect()} == {2: "added", 4: "refused", 5: "added"}
    store = CatalogStore(spark, f"{tmp_path}/store")
    jobs.register_batch(store, docs)(log.where("seq < 4"), 0)
    jobs.register_batch(store, docs)(log.where("seq = 4"), 1)
    compacted = store.compact(f"{tmp_path}/compacted")
    assert compacted.high_water() == 4
    # a stream that starts anew writes batch 0 and keeps what was there
    jobs.register_batch(compacted, docs)(log.where("seq = 5"), 0)
    same_rows(compacted.versions(), replay.versions_of(whole))
    assert [tuple(r) for r in compacted.levels().collect()] == [("s", "FULL")]
