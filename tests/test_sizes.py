"""What may grow with the log is neither broadcast nor stored with texts."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from schemaloom.functions import avro_text
from schemaloom.operators import checks, dialect_rules, elements
from schemaloom.plans import compat_queries, dialect_queries, fixtures

from conftest import SF_DIR


def fields(spark):
    rows = [(1, 0, "a", "int", False), (2, 0, "a", "string", False), (3, 0, "a", "long", True)]
    return spark.createDataFrame(rows, "schema_id int, pos int, name string, type string, has_default boolean")


def versions(spark):
    rows = [("s", 1, 1, False), ("s", 2, 2, False), ("t", 1, 1, False), ("t", 2, 3, False)]
    return spark.createDataFrame(rows, "subject string, version int, schema_id int, deleted boolean")


def test_audit_broadcasts_no_versions(spark, capsys):
    """The table of versions went to the driver five times to be broadcast."""
    found = versions(spark)
    audit = elements.audit(elements.as_candidates(found), found, dialect_rules.flat_avro(fields(spark)))
    audit.explain()
    joins = [x for x in capsys.readouterr().out.splitlines() if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "schema_id#" in x.split("]")[0]]
    got = {(r.subject, r.at, r.earlier, r.backward_issues) for r in audit.collect()}
    assert got == {("s", 1, 0, 0), ("s", 2, 1, 1), ("t", 1, 0, 0), ("t", 2, 1, 0)}


def test_cases_of_checks_are_stored_without_texts(spark, monkeypatch):
    """Each distinct case was stored with two texts, in files whose size told nothing of the rows."""
    stored, plain = [], checks.cut_plain
    monkeypatch.setattr(checks, "cut_plain", lambda df: stored.append(df.columns) or plain(df))
    schemas = spark.createDataFrame(
        [(1, "JSON_SCHEMA", '{"a":  1}', '{"a":1}'), (2, "JSON_SCHEMA", '{"a":1}', '{"a":1}')],
        "schema_id int, dialect string, raw string, content string",
    )
    held = spark.createDataFrame([("s", 1, 1, False)], "subject string, version int, schema_id int, deleted boolean")
    levels = spark.createDataFrame([("s", "FULL")], "subject string, level string")
    asked = spark.createDataFrame([(1, "s", "Latest", 1), (2, "s", "1", 2), (3, "s", "4", 2)], "seq long, subject string, token string, proposed_id int")
    docs = elements.Documents(schemas.select("schema_id", "dialect"), (dialect_rules.flat_avro(fields(spark)),))
    got = checks.check_version(asked, held, levels, schemas, docs).select("seq", "is_compatible", "error_code").orderBy(F.col("seq")).collect()
    assert [tuple(r) for r in got] == [(1, False, None), (2, True, None), (3, None, 404)]
    assert stored and not [c for columns in stored for c in columns if c in ("_content", "_raw")]


def test_a_wide_document_is_read_in_little_memory():
    """Each node was a dictionary, and those of all texts of a batch were held and copied at once."""
    fields = ",".join(f'{{"name":"c{i}","type":"int"}}' for i in range(5000))
    texts = pa.array([f'{{"type":"record","name":"r{k}","fields":[{fields}]}}' for k in range(4)] + [None, "{}"])
    tracemalloc.start()
    got = avro_text._parse_batch(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x and len(x) for x in got.field("nodes").to_pylist()] == [5001] * 4 + [None, None]
    assert got.field("nodes")[3].as_py()[5000]["name"] == "c4999"
    assert most < 6_000_000


def test_validate_stores_facts_as_large_as_their_rows(spark, monkeypatch):
    """Facts were stored compressed, so millions of rows passed for a few MB and were broadcast, and views were made twice."""
    made, stored, view, plain = [], [], fixtures.view, compat_queries.cut_plain
    monkeypatch.setattr(fixtures, "view", lambda spark, sf, name: made.append(name) or view(spark, sf, name))
    monkeypatch.setattr(compat_queries, "cut_plain", lambda df: stored.append(df.columns) or plain(df))
    compat_queries.q_proto_validate(spark, SF_DIR)
    assert sorted(made) == ["fx_penum", "fx_pf", "fx_pres_name", "fx_pres_tag", "fx_prpc"]
    assert len(stored) == 5


def test_json_requests_carry_no_texts(spark, monkeypatch):
    """Each version and each request carried a document's text through the shuffles."""
    stored, plain = [], dialect_queries.cut_plain
    monkeypatch.setattr(dialect_queries, "cut_plain", lambda df: stored.append(df.columns) or plain(df))
    monkeypatch.setattr(dialect_queries, "derived_versions", lambda spark, sf: versions(spark))
    assert dialect_queries.q_json_schema_compat(spark, SF_DIR).columns == ["seq", "is_compatible"]
    assert ["seq", "proposed_id", "_first"] in stored
