"""Documents, envelopes, column metadata, types, responses and registering."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from schemaloom.functions.types import document_to_struct, struct_to_document
from schemaloom.operators import levels, registration, replay
from schemaloom.plans import documents as texts, protobuf_documents, registering
from schemaloom.sources import columns, documents, responses


def test_documents_and_envelopes(spark, tmp_path):
    (tmp_path / "a.avsc").write_text('{\n "type":"int"}')
    (tmp_path / "b.proto").write_text("message A {\n}\n")
    got = {r["path"].rpartition("/")[2]: r["raw"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.avsc": '{\n "type":"int"}', "b.proto": "message A {\n}\n"}
    bodies = spark.createDataFrame([(1, '{"schema":"\\"int\\""}'), (2, '{"compatibility":"FULL"}'), (3, "oops")], "n int, body string")
    assert [tuple(r) for r in documents.read_envelopes(bodies).orderBy("n").collect()] == [
        (1, '"int"', None), (2, None, "FULL"), (3, None, None)
    ]


def test_responses(spark):
    lit = F.lit
    row = spark.range(1).select(
        responses.terse(lit('"int"')), responses.verbose(lit("x"), lit(4), lit("s"), lit(1)), responses.registered(lit(4)),
        responses.report(lit(True)), responses.level_shown(lit("NONE")), responses.level_set(lit("FULL")),
        responses.or_not_found(lit(False), lit("x")),
    ).first()
    assert list(row) == [
        '{"schema":"\\"int\\""}', '{"schema":"x","id":4,"subject":"s","version":1}', '{"id":4}', '{"is_compatible":true}',
        '{"compatibilityLevel":"NONE"}', '{"compatibility":"FULL"}', '{"error_code":404,"message":"Not Found"}',
    ]


STRUCT = T.StructType([T.StructField("stringCol", T.StringType(), False), T.StructField("intCol", T.IntegerType(), False)])

NESTED = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tags", T.ArrayType(T.StringType(), True), True),
    T.StructField("at", T.StructType([T.StructField("x", T.DoubleType(), False)]), False),
    T.StructField("counts", T.MapType(T.StringType(), T.IntegerType(), False), False),
    T.StructField("raw", T.BinaryType(), True),
])


@pytest.mark.parametrize("struct", [STRUCT, NESTED])
def test_struct_round_trip(struct):
    assert document_to_struct(struct_to_document("testKey", struct)) == struct


def test_unmapped_types_are_strings():
    struct = T.StructType([T.StructField("d", T.DecimalType(10, 2), False), T.StructField("t", T.TimestampType(), False)])
    back = document_to_struct(struct_to_document("k", struct))
    assert [f.dataType for f in back.fields] == [T.StringType(), T.StringType()]


def test_register_and_resolve(spark):
    made = columns.struct_documents(spark, {"testKey": STRUCT}).withColumn("seq", F.lit(1).cast("bigint"))
    catalog = registering.register(made)
    assert registering.resolve(catalog, "testKey") == STRUCT
    with pytest.raises(LookupError):
        registering.resolve(catalog, "other")


def test_table_document(spark):
    cols = spark.createDataFrame(
        [("T", 2, "COL_B", 8), ("T", 1, "COL_A", 4), ("T", 3, "COL_C", 12)], "tbl string, ordinal int, col string, jdbc_type int"
    )
    (row,) = columns.columns_to_avro(cols).collect()
    assert json.loads(row["content"]) == {
        "type": "record", "name": "T",
        "fields": [{"name": "COL_A", "type": "int"}, {"name": "COL_B", "type": "double"}, {"name": "COL_C", "type": "string"}],
    }
    names = spark.createDataFrame([("integer",), ("DOUBLE PRECISION",), ("CHARACTER VARYING",)], "t string")
    assert [r[0] for r in names.select(columns.code_of(F.col("t"))).collect()] == [4, 8, 12]


def test_one_id_per_content(spark):
    """Texts that differ in blanks are one schema, in all subjects."""
    texts = [(3, "a", '{"type":"int"}'), (1, "b", '"int"'), (2, "a", '"long"'), (4, "c", "not a schema")]
    catalog = registering.register(spark.createDataFrame(texts, "seq bigint, subject string, raw string"))
    assert sorted((r["schema_id"], r["content"]) for r in catalog.schemas.collect()) == [(1, '"int"'), (2, '"long"')]
    got = sorted((r["subject"], r["version"], r["schema_id"]) for r in catalog.versions.collect())
    assert got == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1)]


def test_levels_shown(spark):
    changes = spark.createDataFrame(
        [(1, "a", "FULL"), (2, "a", "BACKWARD"), (3, "_GLOBALCONFIG", "FORWARD"), (4, "_GLOBALCONFIG", "WRONG")],
        "seq bigint, subject string, level string",
    )
    set_levels = levels.subject_levels(changes)
    asked = spark.createDataFrame([("a",), ("b",), ("gone",), ("unknown",)], "subject string")
    subjects = spark.createDataFrame([("a", False), ("b", False), ("gone", True)], "subject string, deleted boolean")
    shown = {r["subject"]: (r["level"], r["error_code"]) for r in levels.shown_level(asked, subjects, set_levels).collect()}
    assert shown == {"a": ("BACKWARD", None), "b": ("FORWARD", None), "gone": (None, 404), "unknown": (None, 404)}
    empty = set_levels.where("false")
    assert {r["level"] for r in levels.effective_level(asked, empty).collect()} == {"NONE"}


def test_new_subjects(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "subject string")
    known = spark.createDataFrame([("a",)], "subject string")
    assert [r["subject"] for r in registration.new_subjects(asked, known).collect()] == ["b"]


def test_register_all_dialects(spark):
    """Levels per dialect: Avro and Protobuf by their rules, JSON Schema by its oldest text."""
    old, grown = "message A { int32 i = 1; }", "message A { int32 i = 1; string s = 2; }"
    rec = '{"type":"record","name":"r","fields":[%s]}'
    a, b, c = '{"name":"a","type":"int"}', '{"name":"b","type":"int"}', '{"name":"b","type":"int","default":0}'
    texts = [
        (10, "p", old), (11, "p", "message A { int64 i = 1; }"), (12, "p", grown), (13, "p", rec % a),
        (20, "a", rec % a), (21, "a", rec % f"{a},{b}"), (22, "a", rec % f"{a},{c}"), (23, "a", old),
        (30, "j", '{ "properties": {} }'), (31, "j", '{ "properties": {} }'), (32, "j", '{"properties":{}}'), (33, "j", '{"properties":{"x":{}}}'),
        (40, "n", old), (41, "n", "message A { int64 i = 1; }"), (42, "n", rec % a),
        (50, "t", old), (51, "t", grown), (52, "t", "message A { int32 i = 1; string s = 3; }"),
        (60, "f", old), (61, "f", grown),
    ]
    levels_set = [("p", "BACKWARD"), ("a", "BACKWARD"), ("t", "BACKWARD_TRANSITIVE"), ("f", "FORWARD")]
    settings = spark.createDataFrame(
        [(i, s, "CONFIG", None, lvl, 0) for i, (s, lvl) in enumerate(levels_set)],
        "seq bigint, subject string, op string, schema_id int, level_set string, delete_version int",
    )
    numbered = registering.number_documents(spark.createDataFrame(texts, "seq bigint, subject string, raw string"))
    events = replay.replay_events(registering.with_settings(numbered, settings), numbered.docs)
    got = {r["seq"]: r["status"] for r in events.collect()}
    # 31 has blanks that the oldest canonical text does not have; 32 is that text
    assert {n for n, s in got.items() if s == "refused"} == {11, 13, 21, 23, 31, 33, 52, 61}
    assert got[32] == "present"
    assert all(got[n] == "added" for n in (10, 12, 20, 22, 30, 40, 41, 42, 50, 51, 60))


def test_columns_of_spark_tables(spark):
    spark.sql("select 1 as a, 2L as b, 'x' as c, current_date() as d").createOrReplaceTempView("some_view")
    got = [tuple(r) for r in columns.read_table_columns(spark, ["some_view"]).orderBy("ordinal").collect()]
    assert got == [("some_view", 1, "a", 4), ("some_view", 2, "b", -5), ("some_view", 3, "c", 12), ("some_view", 4, "d", 12)]


def test_texts_out_of_range_are_set_aside(spark):
    texts = [
        (1, "a", "message A { int32 a = 99999999999; }"), (2, "a", "message A { reserved 5 to 99999999999; }"),
        (3, "a", "enum E { X = 99999999999; }"), (4, "a", "message A { int32 a = 1 [default = 99999999999]; reserved 2147483647; }"),
        (5, "b", '{"type":"fixed","name":"F","size":99999999999}'), (6, "b", '{"type":"record","name":"R","aliases":[1],"fields":[]}'),
        (7, "c", '{"a":1,"b":2,"a":3}'), (8, "c", '{"a":3,"b":2}'), (9, "d", "no schema"),
    ]
    catalog = registering.register(spark.createDataFrame(texts, "seq bigint, subject string, raw string"))
    assert sorted(r["seq"] for r in catalog.rejected.collect()) == [1, 2, 3, 9]
    found = {r["content"]: r["dialect"] for r in catalog.schemas.collect()}
    assert found['{"a":3,"b":2}'] == "JSON_SCHEMA" and len(found) == 4
    assert sorted(found.values()) == ["JSON_SCHEMA"] * 3 + ["PROTOBUF"]


def test_texts_are_dealt_out_and_not_broadcast(spark):
    """Short texts are few bytes, but much work each: all partitions read them, and none goes through the driver."""
    rows = spark.createDataFrame([(i, f"words {i}") for i in range(400)], "seq int, raw string")
    for read in (texts.dialects(rows), texts.canonicalise(rows)):
        assert read.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        joined = texts.with_documents(rows, read, ("dialect",))._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in joined and "BroadcastHashJoin" not in joined
    assert registering.rejected(rows.withColumn("subject", F.lit("s"))).count() == 400


def test_a_document_is_walked_once_for_its_text(spark):
    rows = spark.createDataFrame([("message A { int32 a = 1; }",)], "raw string")
    text = protobuf_documents.canonical(rows, "raw", "text")
    walks = text._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert walks == 1 and text.first()["text"] == "//\n\nmessage A {\n  int32 a = 1;\n}\n"
