"""Avro text, and Avro verdicts against the library on Spark's class path."""

import itertools
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from schemaloom.functions import avro_text
from schemaloom.functions.dialects import verdict
from schemaloom.operators import avro_nested, dialect_rules, elements, levels, checks
from schemaloom.plans import documents, registering

TEXTS = {
    # text: canonical form, None if it is no Avro schema
    '"int"': '"int"',
    '{"type": "string"}': '"string"',
    '{"type":"int","logicalType":"date"}': '{"type":"int","logicalType":"date"}',
    '["null", "int"]': '["null","int"]',
    '{"type":"array","items":{"type":"int"}}': '{"type":"array","items":"int"}',
    '{"fields":[{"type":{"type":"int"},"name":"a","default":0,"doc":"x  y"}],"name":"n.r","type":"record"}':
        '{"type":"record","name":"r","namespace":"n","fields":[{"name":"a","type":"int","doc":"x  y","default":0}]}',
    '{"type":"enum","name":"E","symbols":["A","B"]}': '{"type":"enum","name":"E","symbols":["A","B"]}',
    '{"type":"fixed","name":"F","size":4}': '{"type":"fixed","name":"F","size":4}',
    '{"type":"record","name":"l","fields":[{"name":"next","type":["null","l"]}]}':
        '{"type":"record","name":"l","fields":[{"name":"next","type":["null","l"]}]}',
    "int": None,
    '{"type":"nope"}': None,
    '{"properties":{"a":{"type":"string"}}}': None,
    '{"type":"record","name":"r"}': None,
    '{"type":"record","name":"a b","fields":[]}': None,
    '{"type":"enum","name":"E","symbols":["A","A"]}': None,
    "5": None,
    "": None,
}


def test_canonical(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"]: r["c"] for r in rows.select("t", avro_text.parse(F.col("t"))["canonical"].alias("c")).collect()}
    assert got == TEXTS


def test_dialect_order(spark):
    kinds = {
        '{"type": "string"}': "AVRO",
        '{"properties": {}}': "JSON_SCHEMA",
        "message A {}": "PROTOBUF",
        "": "PROTOBUF",
        "no schema at all": None,
        "[1, 2]": "JSON_SCHEMA",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(kinds)], "seq int, raw string")
    read = documents.with_documents(rows, documents.canonicalise(rows))
    assert {r["raw"]: r["dialect"] for r in read.collect()} == kinds
    assert [r["raw"] for r in documents.quarantine(read).collect()] == ["no schema at all"]


@pytest.fixture(scope="module")
def shapes():
    types = ["int", "long", "float", "double", "string", "bytes", "boolean"]
    made = []
    for i, t in enumerate(types):
        made.append([("a", t, False)])
        made.append([("a", t, True), ("b", types[i - 1], i % 2 == 0)])
    return made + [[], [("b", "int", False)]]


DEFAULTS = {"int": 0, "long": 0, "float": 0.0, "double": 0.0, "string": "", "bytes": "", "boolean": False}


def record(fields):
    listed = [{"name": n, "type": t} | ({"default": DEFAULTS[t]} if d else {}) for n, t, d in fields]
    return json.dumps({"type": "record", "name": "rec", "fields": listed})


def flat(spark, shapes):
    rows = [(i, *f) for i, s in enumerate(shapes) for f in s]
    return dialect_rules.flat_avro(spark.createDataFrame(rows, "schema_id int, name string, type string, has_default boolean"))


def library(spark, texts):
    """(reader, writer) to whether the library on Spark's class path lets the one read the other; an error is a no."""
    avro = spark._jvm.org.apache.avro
    parsed = [avro.Schema.Parser().parse(t) for t in texts]

    def can_read(reader, writer):
        try:
            result = avro.SchemaCompatibility.checkReaderWriterCompatibility(parsed[reader], parsed[writer])
        except Py4JJavaError:  # a reader field that several writer fields answer to
            return False
        return result.getType().toString() == "COMPATIBLE"

    ids = range(len(texts))
    return {(r, w): can_read(r, w) for r in ids for w in ids}


def judged(spark, rules, n):
    asked = spark.createDataFrame(list(itertools.product(range(n), range(n))), "existing_id int, proposed_id int")
    found = elements.pair_verdicts(asked, rules).collect()
    assert all(r["full"] == (r["backward"] and r["forward"]) for r in found)
    return {(r["existing_id"], r["proposed_id"]): (r["backward"], r["forward"]) for r in found}


def test_pairs_agree_with_library(spark, shapes):
    got = judged(spark, flat(spark, shapes), len(shapes))
    reads = library(spark, [record(s) for s in shapes])
    assert got == {(e, p): (reads[p, e], reads[e, p]) for p, e in reads}
    assert 0 < sum(b for b, _ in got.values()) < len(got)


def audited(spark, rules, history, span=1 << 20):
    table = spark.createDataFrame(history, "subject string, version int, schema_id int")
    found = elements.audit(elements.as_candidates(table), table, rules, span).collect()
    return {(r["subject"], r["at"]): (r["earlier"], r["backward_issues"] == 0, r["forward_issues"] == 0) for r in found}


def against_all(history, reads):
    want = {}
    for subject, version, doc in history:
        earlier = [d for s, v, d in history if s == subject and v < version]
        want[subject, version] = (len(earlier), all(reads[doc, d] for d in earlier), all(reads[d, doc] for d in earlier))
    return want


@pytest.mark.parametrize("span", [1 << 20, 3])
def test_transitive_equals_pairs(spark, shapes, span):
    history = [("x", i + 1, i) for i in range(len(shapes))] + [("y", 10 - i, 2 * i + 1) for i in range(7)]
    reads = library(spark, [record(s) for s in shapes])
    assert audited(spark, flat(spark, shapes), history, span) == against_all(history, reads)


def test_levels(spark):
    """The verdict of a fold: document 1 is latest, the new one breaks with 0 when it reads and with 1 when it is read."""
    names = ("NONE", "BACKWARD", "FORWARD", "FULL", "BACKWARD_TRANSITIVE", "FORWARD_TRANSITIVE", "ODD")
    entry = "struct<version:int,schema_id:int,n:bigint,dialect:string>"
    live = [(1, 7, 0, "AVRO"), (2, 8, 1, "AVRO")]
    rows = [(name, live, (9, True, "AVRO", [1], [2])) for name in names]
    df = spark.createDataFrame(
        rows, f"level string, live array<{entry}>, op struct<schema_id:int,exact:boolean,dialect:string,backward:array<bigint>,forward:array<bigint>>"
    )
    ok = verdict(F.col("level"), F.col("live"), F.col("op"))
    assert [r["ok"] for r in df.select(ok.alias("ok")).collect()] == [True, True, False, False, False, False, True]


def _rec(*fields, name="r", **more):
    return {"type": "record", "name": name, "fields": [dict(zip(("name", "type", "default"), f)) for f in fields], **more}


NESTED = [
    _rec(("a", "int")),
    _rec(("a", "long")),
    _rec(("a", ["null", "int"])),
    _rec(("a", ["null", "long", "string"])),
    _rec(("a", {"type": "array", "items": "int"})),
    _rec(("a", {"type": "array", "items": ["null", "double"]})),
    _rec(("a", {"type": "map", "values": "int"})),
    _rec(("a", _rec(("x", "int"), name="in"))),
    _rec(("a", _rec(("x", "long"), ("y", "string", ""), name="in"))),
    _rec(("a", _rec(("x", "long"), ("y", "string"), name="in"))),
    _rec(("a", _rec(("x", "int"), name="other"))),
    _rec(("a", {"type": "enum", "name": "e", "symbols": ["A", "B"]})),
    _rec(("a", {"type": "enum", "name": "e", "symbols": ["A"]})),
    _rec(("a", {"type": "enum", "name": "e", "symbols": ["A"], "default": "A"})),
    _rec(("a", {"type": "enum", "name": "f", "symbols": ["A", "B"]})),
    _rec(("a", {"type": "fixed", "name": "q", "size": 4})),
    _rec(("a", {"type": "fixed", "name": "q", "size": 8})),
    _rec(("a", {"type": "fixed", "name": "n.q", "size": 4})),
    _rec(("v", "int"), ("next", ["null", "r"])),
    _rec(("v", "long"), ("next", ["null", "r"])),
    _rec(("v", "long"), ("w", "int", 0), ("next", ["null", "r"])),
    _rec(("v", "int"), ("next", ["null", "string"])),
    _rec(("a", "int"), name="s"),
    _rec(("a", "int"), name="n.r"),
    _rec(),
    "int",
    "double",
    ["null", "int"],
    ["int"],
    [],
    {"type": "record", "name": "r", "fields": [{"name": "b", "type": "long", "aliases": ["a"]}]},
    {"type": "record", "name": "r", "fields": [{"name": "b", "type": ["null", "r"], "aliases": ["next"], "default": None}]},
]


def test_nested_pairs_agree_with_library(spark):
    """All rules on nested types, unions, recursion and field aliases."""
    texts = [json.dumps(s) for s in NESTED]
    table = spark.createDataFrame(list(enumerate(texts)), "schema_id int, raw string")
    nodes = table.join(documents.canonicalise(table.select("raw")), "raw")
    ids = range(len(texts))
    asked = spark.createDataFrame(list(itertools.product(ids, ids)), "reader_id int, writer_id int")
    got = {
        (r["reader_id"], r["writer_id"]): r["compatible"]
        for r in avro_nested.nested_pairs(asked, documents.avro_nodes(nodes, "schema_id")).collect()
    }
    avro = spark._jvm.org.apache.avro
    parsed = [avro.Schema.Parser().parse(t) for t in texts]

    def can_read(reader, writer):
        result = avro.SchemaCompatibility.checkReaderWriterCompatibility(parsed[reader], parsed[writer])
        return result.getType().toString() == "COMPATIBLE"

    want = {(r, w): can_read(r, w) for r in ids for w in ids}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert len(ids) < sum(want.values()) < len(want) / 2


def test_type_aliases_count_as_names(spark):
    texts = [json.dumps(_rec(("a", "int"), name="new", aliases=["old"])), json.dumps(_rec(("a", "int"), name="old"))]
    table = spark.createDataFrame(list(enumerate(texts)), "schema_id int, raw string")
    nodes = documents.avro_nodes(table.join(documents.canonicalise(table.select("raw")), "raw"), "schema_id")
    asked = spark.createDataFrame([(0, 1), (1, 0)], "reader_id int, writer_id int")
    got = {r["reader_id"]: r["compatible"] for r in avro_nested.nested_pairs(asked, nodes).collect()}
    assert got == {0: True, 1: False}


MORE = [
    *NESTED,
    _rec(("a", ["null", _rec(("x", "int"), name="p"), _rec(("x", "string"), name="q")])),
    _rec(("a", ["null", _rec(("x", "long"), name="p"), _rec(("x", "string"), ("y", "int"), name="q")])),
    _rec(("a", _rec(("x", "int"), name="p"))),
    _rec(("a", {"type": "map", "values": _rec(("x", "int"), ("z", "int", 1), name="p")})),
    _rec(("a", {"type": "map", "values": _rec(("x", "int"), name="p")})),
    _rec(("a", "int"), name="new", aliases=["r"]),
    # a definition that stands in one field and is referred to in another
    _rec(("a", _rec(("f", "int"), name="X")), ("b", "X")),
    _rec(("b", _rec(("f", "string"), name="X"))),
    _rec(("b", _rec(("f", "long"), name="X"))),
    # what lies below a field that is found by its alias
    {"type": "record", "name": "r", "fields": [{"name": "new", "aliases": ["old"], "type": _rec(("f", "int"), name="X")}]},
    _rec(("old", _rec(("f", "string"), name="X"))),
    _rec(("old", _rec(("f", "int"), name="X"))),
    {"type": "record", "name": "r", "fields": [{"name": "new", "aliases": ["old"], "type": {"type": "array", "items": "int"}}]},
    _rec(("old", {"type": "array", "items": "string"})),
    {"type": "record", "name": "r", "fields": [{"name": "new", "aliases": ["older", "old"], "type": "long", "default": 0}]},
    _rec(("older", "int"), ("z", "int", 0)),
    # namespaces, also of what is referred to
    _rec(("a", _rec(("f", {"type": "enum", "name": "E", "symbols": ["A"]}), name="n.X")), ("b", "n.E")),
    _rec(("b", {"type": "enum", "name": "m.E", "symbols": ["A", "B"]})),
]


def rules_of(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "schema_id int, raw string")
    nodes = table.join(documents.canonicalise(table.select("raw")), "raw")
    return dialect_rules.avro(documents.avro_nodes(nodes, "schema_id"))


@pytest.fixture(scope="module")
def more(spark):
    texts = [json.dumps(s) for s in MORE]
    return texts, library(spark, texts)


def test_documents_agree_with_library(spark, more):
    """Every pair of all these documents, by their elements."""
    texts, reads = more
    got = judged(spark, rules_of(spark, texts), len(texts))
    wrong = {(texts[e], texts[p]): (got[e, p], (reads[p, e], reads[e, p])) for p, e in reads if got[e, p] != (reads[p, e], reads[e, p])}
    assert wrong == {}


def test_transitive_audits_of_any_types(spark, more, span=5):
    """Histories of records only, of roots of all kinds, and with a type that never changes."""
    texts, reads = more
    records = [i for i, s in enumerate(MORE) if isinstance(s, dict) and s["type"] == "record"]
    history = [("records", n, i) for n, i in enumerate(records, 1)] + [("all", n, i) for n, i in enumerate(reversed(range(len(MORE))), 1)]
    history += [("same", 1, 2), ("same", 2, 2), ("same", 4, 3), ("aliases", 1, 44), ("aliases", 2, 45), ("aliases", 3, 43)]
    got, want = audited(spark, rules_of(spark, texts), history, span), against_all(history, reads)
    assert {k: (texts[i], got[s, v], want[s, v]) for s, v, i in history for k in [(s, v)] if got[k] != want[k]} == {}


def test_sets_in_a_fold_equal_pairs(spark, more):
    """The sets that registering carries hold exactly the documents of the subject that break each other."""
    texts, reads = more
    docs = elements.Documents(
        spark.createDataFrame([(i, "AVRO") for i in range(len(texts))], "schema_id int, dialect string"), (rules_of(spark, texts),)
    )
    held = {"all": list(range(len(texts))), "few": [0, 1, 2, 36, 37], "aliases": [39, 40, 41, 42, 43, 44, 45]}
    members = spark.createDataFrame([(s, i) for s, ids in held.items() for i in ids], "subject string, schema_id int")
    rows = elements.numbered_sets(members, docs).collect()
    for subject, ids in held.items():
        mine = {r["schema_id"]: r for r in rows if r["subject"] == subject}
        has = lambda words, n: words is not None and n // 64 < len(words) and words[n // 64] >> (n % 64) & 1 == 1
        for a, b in itertools.product(ids, ids):
            found = has(mine[a]["backward"], mine[b]["n"]), has(mine[a]["forward"], mine[b]["n"])
            assert found == (not reads[a, b], not reads[b, a]), (subject, texts[a], texts[b])


BREAKING = {
    "definition moved": (_rec(("a", _rec(("f", "int"), name="X")), ("b", "X")), _rec(("b", _rec(("f", "string"), name="X")))),
    "below an alias": (
        _rec(("old", _rec(("f", "string"), name="X"))),
        {"type": "record", "name": "r", "fields": [{"name": "new", "aliases": ["old"], "type": _rec(("f", "int"), name="X")}]},
    ),
    "items below an alias": (
        _rec(("old", {"type": "array", "items": "string"})),
        {"type": "record", "name": "r", "fields": [{"name": "new", "aliases": ["old"], "type": {"type": "array", "items": "int"}}]},
    ),
}


@pytest.mark.parametrize("level", ["BACKWARD", "BACKWARD_TRANSITIVE"])
def test_register_and_checks_refuse_what_the_library_refuses(spark, level):
    rows = [(10 * k + i + 1, s, json.dumps(d)) for k, (s, docs) in enumerate(BREAKING.items()) for i, d in enumerate(docs)]
    rows += [(101 + i, "same", json.dumps(_rec(("a", ["null", "int"]), *[("b", "int", 0)] * i))) for i in range(2)]
    requests = spark.createDataFrame(rows, "seq bigint, subject string, raw string")
    setting = spark.createDataFrame([(0, "any", "GLOBAL", None, level, 0)], "seq bigint, subject string, op string, schema_id int, level_set string, delete_version int")
    catalog = registering.register(requests, setting)
    assert {r["subject"]: r["count"] for r in catalog.versions.groupBy("subject").count().collect()} == dict.fromkeys(BREAKING, 1) | {"same": 2}
    numbered = registering.number_documents(requests)
    known = numbered.log.select("seq", "subject", F.col("schema_id").alias("proposed_id"))
    asked = known.join(requests.groupBy("subject").agg(F.max("seq").alias("seq")), ["subject", "seq"])
    first = known.join(requests.groupBy("subject").agg(F.min("seq").alias("seq")), ["subject", "seq"])
    versions = first.select("subject", F.lit(1).alias("version"), F.col("proposed_id").alias("schema_id"), F.lit(False).alias("deleted"))
    texts = numbered.schemas.withColumn("raw", F.col("content"))
    in_force = levels.subject_levels(spark.createDataFrame([(1, s, level) for s in (*BREAKING, "same")], "seq bigint, subject string, level string"))
    before = checks.check_before_registering(asked, versions, in_force, texts, numbered.docs).collect()
    one = checks.check_version(asked.withColumn("token", F.lit("1")), versions, in_force, texts, numbered.docs).collect()
    want = dict.fromkeys(BREAKING, False) | {"same": True}
    assert {r["subject"]: r["is_compatible"] for r in before} == {r["subject"]: r["is_compatible"] for r in one} == want


def test_register_applies_all_rules(spark):
    """Documents that differ in nested types, names or kind are judged when they are registered."""
    steps = {
        "root": ('"string"', '"int"', 1),
        "nullable": (_rec(("a", "string")), _rec(("a", ["null", "string"])), 2),
        "name": (_rec(("a", "int")), _rec(("a", "int"), name="other"), 1),
        "inner": (_rec(("a", _rec(("x", "int"), name="i"))), _rec(("a", _rec(("x", "int"), ("y", "int", 0), name="i"))), 2),
        "lost": (_rec(("a", _rec(("x", "int"), name="i"))), _rec(("a", _rec(("x", "int"), ("y", "int"), name="i"))), 1),
        "enum": (_rec(("a", {"type": "enum", "name": "e", "symbols": ["A", "B"]})), _rec(("a", {"type": "enum", "name": "e", "symbols": ["A"]})), 1),
        "list": (_rec(("a", {"type": "array", "items": "int"})), _rec(("a", {"type": "array", "items": "long"})), 2),
    }
    text = lambda s: s if isinstance(s, str) else json.dumps(s)
    rows = [(10 * k + i, subject, text(doc)) for k, (subject, docs) in enumerate(steps.items()) for i, doc in enumerate(docs[:2])]
    requests = spark.createDataFrame([(seq + 1, s, t) for seq, s, t in rows], "seq bigint, subject string, raw string")
    level = spark.createDataFrame([(0, "any", "GLOBAL", None, "BACKWARD", 0)], "seq bigint, subject string, op string, schema_id int, level_set string, delete_version int")
    versions = registering.register(requests, level).versions.groupBy("subject").count().collect()
    assert {r["subject"]: r["count"] for r in versions} == {s: n for s, (_, _, n) in steps.items()}
