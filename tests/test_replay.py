"""Replay against a plain loop, registry scenarios, and rounds."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR, same_rows
from schemaloom.operators import dialect_rules, elements, lookup, replay
from schemaloom.plans import catalog_queries, compat_queries

PROMOTED = {"int": {"long", "float", "double"}, "long": {"float", "double"}, "float": {"double"},
            "string": {"bytes"}, "bytes": {"string"}}


def reads(reader, writer):
    written = {n: t for n, t, _ in writer}
    return all(
        (written[n] == t or t in PROMOTED.get(written[n], ())) if n in written else default for n, t, default in reader
    )


def accepted(level, new, live, docs):
    if not live or level == "NONE":
        return True
    last = docs[live[-1]]
    if level == "BACKWARD":
        return reads(docs[new], last)
    if level == "FORWARD":
        return reads(last, docs[new])
    if level == "FULL":
        return reads(docs[new], last) and reads(last, docs[new])
    return all(reads(docs[new], docs[e]) for e in live)


def loop(log, docs):
    """Outcome per operation, one at a time."""
    ids, own, common, out = {}, {}, None, {}
    for seq, subject, op, schema_id, level, number in log:
        held = ids.setdefault(subject, [])
        live = [i for i in held if i is not None]
        if op == "CONFIG":
            own[subject] = level
        elif op == "GLOBAL":
            common = level
        elif op == "REGISTER":
            if not accepted(own.get(subject) or common or "NONE", schema_id, live, docs):
                out[seq] = ("refused", None, [])
            elif schema_id in held:
                out[seq] = ("present", schema_id, [held.index(schema_id) + 1])
            else:
                held.append(schema_id)
                out[seq] = ("added", schema_id, [len(held)])
        elif op == "DELETE":
            wanted = number or max((i + 1 for i, s in enumerate(held) if s is not None), default=0)
            if 1 <= wanted <= len(held) and held[wanted - 1] is not None:
                held[wanted - 1] = None
                out[seq] = ("deleted", None, [wanted])
            else:
                out[seq] = ("not_found", None, [])
        else:
            gone = [i + 1 for i, s in enumerate(held) if s is not None]
            out[seq] = ("deleted" if held or subject in own else "not_found", None, gone)
            ids[subject] = [None] * len(held)
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(3)
    return {
        i: [(f"f{j}", rng.choice(["int", "long", "double", "string"]), rng.random() < 0.6) for j in range(5) if rng.random() < 0.6]
        for i in range(8)
    }


def frames(spark, log, docs):
    ops = spark.createDataFrame(
        log, "seq bigint, subject string, op string, schema_id int, level_set string, delete_version int"
    )
    return ops, shapes(spark, docs)


def shapes(spark, docs):
    """Flat records (id: fields) as the replay takes them."""
    fields = spark.createDataFrame(
        [(i, *f) for i, fields in docs.items() for f in fields], "schema_id int, name string, type string, has_default boolean"
    )
    kinds = spark.createDataFrame([(i, "AVRO") for i in docs], "schema_id int, dialect string")
    return elements.Documents(kinds, (dialect_rules.flat_avro(fields),))


@pytest.mark.parametrize("fold_ops,span", [(4096, 1 << 20), (25, 64)])
def test_against_loop(spark, documents, fold_ops, span):
    rng = random.Random(11)
    levels = ["NONE", "BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD", "FULL"]
    log = []
    for seq in range(600):
        subject = "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        op = rng.choices(["REGISTER", "DELETE", "CONFIG", "DELETE_SUBJECT", "GLOBAL"], [12, 3, 2, 0.4, 0.4])[0]
        same = seq and rng.random() < 0.3
        schema = log[-1][3] if same else rng.randrange(8)
        log.append((seq, log[-1][1] if same else subject, op, schema, rng.choice(levels), rng.choice([0, 0, 1, 2, 3])))
    ops, docs = frames(spark, log, documents)
    events = replay.replay_events(ops, docs, fold_ops=fold_ops, span=span)
    got = {r["seq"]: (r["status"], r["schema_id"], r["versions"]) for r in events.collect()}
    assert got == loop(log, documents)


def test_rounds_on_events(spark):
    log, docs = compat_queries.replay_log(spark, SF_DIR), catalog_queries.shape_documents(spark, SF_DIR)
    same_rows(replay.replay_events(log, docs), replay.replay_events(log, docs, fold_ops=20, span=200))


def test_delete_and_register_again(spark, documents):
    """A deleted version keeps its number; the same schema gets a new one; a second delete finds nothing."""
    reg, dele, drop = "REGISTER", "DELETE", "DELETE_SUBJECT"
    steps = [("a", reg, 1, 0), ("a", reg, 2, 0), ("a", reg, 3, 0), ("a", dele, 0, 2), ("a", drop, 0, 0),
             ("b", reg, 1, 0), ("b", dele, 0, 0), ("b", dele, 0, 0), ("b", reg, 1, 0), ("b", drop, 0, 0), ("b", drop, 0, 0),
             ("c", drop, 0, 0)]
    log = [(i, s, op, schema, None, number) for i, (s, op, schema, number) in enumerate(steps)]
    ops, docs = frames(spark, log, documents)
    got = {r["seq"]: (r["status"], r["versions"]) for r in replay.replay_events(ops, docs).collect()}
    assert [got[i] for i in range(12)] == [
        ("added", [1]), ("added", [2]), ("added", [3]), ("deleted", [2]), ("deleted", [1, 3]),
        ("added", [1]), ("deleted", [1]), ("not_found", []), ("added", [2]), ("deleted", [2]), ("deleted", []),
        ("not_found", []),
    ]


def test_levels(spark):
    """BACKWARD refuses a new field without default and accepts one with; NONE accepts any change."""
    docs = {1: [("a", "int", False)], 2: [("a", "int", False), ("b", "int", True)],
            3: [("a", "int", False), ("b", "int", False)], 4: [("a", "string", False)]}
    log = [(0, "x", "CONFIG", None, "BACKWARD", 0), (1, "x", "REGISTER", 1, None, 0), (2, "x", "REGISTER", 3, None, 0),
           (3, "x", "REGISTER", 2, None, 0), (4, "y", "REGISTER", 1, None, 0), (5, "y", "REGISTER", 4, None, 0),
           (6, "y", "CONFIG", None, "SIDEWAYS", 0), (7, "y", "REGISTER", 3, None, 0)]
    got = {r["seq"]: r["status"] for r in replay.replay_events(*frames(spark, log, docs)).collect()}
    assert got == {1: "added", 2: "refused", 3: "added", 4: "added", 5: "added", 7: "added"}


def test_version_tokens(spark):
    versions = spark.createDataFrame(
        [("a", 1, 7, False), ("a", 2, 8, False), ("a", 3, 9, True), ("b", 1, 7, True)],
        "subject string, version int, schema_id int, deleted boolean",
    )
    tokens = ["latest", "LATEST", "1", "3", "100", "0", "-1", "one"]
    asked = spark.createDataFrame([(i, s, t) for s in "abc" for i, t in enumerate(tokens)], "seq int, subject string, token string")
    got = {(r["subject"], r["token"]): r["version"] for r in lookup.resolve_versions(asked, versions).collect()}
    assert [got["a", t] for t in tokens] == [2, 2, 1, None, None, None, None, None]
    assert all(got[s, t] is None for s in "bc" for t in tokens)
    listed = lookup.list_versions(asked.select("subject").distinct(), versions).collect()
    assert sorted((r["subject"], r["version"], r["error_code"]) for r in listed if r["version"]) == [("a", 1, None), ("a", 2, None)]
    assert sorted(r["subject"] for r in listed if r["error_code"] == 404) == ["b", "c"]


def test_versions_table(spark, documents):
    log = [(0, "a", "REGISTER", 1, None, 0), (1, "a", "DELETE", 0, None, 0), (2, "a", "REGISTER", 2, None, 0)]
    table = replay.versions_of(replay.replay_events(*frames(spark, log, documents)))
    assert sorted(tuple(r) for r in table.select("version", "schema_id", "deleted").collect()) == [(1, 1, True), (2, 2, False)]
    assert table.where(F.col("deleted")).count() == 1


def test_facts_that_compress_well_are_not_broadcast(spark, monkeypatch):
    """Files of keys are far smaller than their rows: the plan must go by the rows, which a driver could not hold."""
    rows = 200_000
    log = spark.range(rows).select(
        F.col("id").alias("seq"), F.format_string("subj-%d", "id").alias("subject"), F.lit("REGISTER").alias("op"), F.lit(1).alias("schema_id"),
        F.lit(None).cast("string").alias("level_set"), F.lit(0).alias("delete_version"),
    )
    kinds = spark.createDataFrame([(1, "AVRO")], "schema_id int, dialect string")
    seen = {}
    monkeypatch.setattr(replay, "_fold_rounds", lambda heads, *rest: seen.setdefault("heads", heads))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 16 * rows)
    try:
        replay.replay_events(log, elements.Documents(kinds, ()), repeats=False)
        plan = seen["heads"]._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
