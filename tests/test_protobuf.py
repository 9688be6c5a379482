"""Protobuf text jobs and the eight rules on small documents."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import checks, dialect_rules, elements, protobuf_rules as pr
from schemaloom.plans import protobuf_documents as pd

HEAD = 'syntax = "proto3";\npackage shop;\n'

DOCS = {
    "keeps": HEAD + """
        message Order { reserved 6, 12 to 15; reserved "note", "gift"; int64 id = 1; string buyer = 2; }
        message Line { oneof amount { int32 pieces = 1; float weight = 2; } }
        enum State { reserved "GONE"; reserved 9; OPEN = 0; }""",
    # uses two reserved names and three reserved numbers of Order; enum reservations do not count
    "uses": HEAD + """
        message Order { int64 id = 1; string buyer = 2; string note = 6; bool gift = 13; bytes seal = 15; }
        message Line { oneof amount { int32 pieces = 1; float weight = 2; } }
        enum State { OPEN = 0; GONE = 9; }""",
    "nested": "message A { message In { int32 i = 1; } In x = 1; } message B { message In { reserved 2; int32 i = 1; } In x = 1; }",
    "nested2": "message A { message In { int32 i = 1; } In x = 1; } message B { message In { int32 i = 1; string n = 2; } In x = 1; }",
    "wide": "message W { reserved 5, 100 to max; reserved 'old'; }",
    "narrow": "message W { reserved 5, 200 to max; }",
    "full": """message M { repeated string a = 1; map<string,int32> b = 2; K k = 3; enum K { option allow_alias = true; X = 0; Y = 1; Z = 1; } }
        service S { rpc Get(stream M) returns (M); rpc Put(M) returns (stream M) {} rpc Del(M) returns (M); } service Empty {}""",
    "moved": """message M { string a = 1; map<string, int64> b = 4; K k = 3; enum K { option allow_alias = true; X = 0; Y = 1; Q = 1; } }
        service S { rpc Get(M) returns (M); rpc Put(M) returns (stream M); }""",
}

EXPECTED = [
    # rule, before, after, issues
    ("r1", "keeps", "uses", 5),
    ("r1", "uses", "keeps", 0),
    ("r1", "nested", "nested", 0),
    ("r1", "nested", "nested2", 1),
    ("r2", "keeps", "uses", 7),
    ("r2", "uses", "keeps", 0),
    ("r2", "wide", "narrow", 101),
    ("r2", "narrow", "wide", 0),
    # note, gift and seal are gone from Order: seal is not reserved by name, and all numbers are
    ("r3", "uses", "keeps", 1),
    ("r3", "full", "full", 0),
    ("r3", "keeps", "nested", 8),
    ("r4", "full", "moved", 1),
    ("r4", "full", "full", 0),
    # a loses its label, b has another value type
    ("r5", "full", "moved", 2),
    # b left its number; Z was the last name of 1 and is Q now
    ("r6", "full", "moved", 2),
    ("r7", "full", "moved", 1),
    ("r7", "full", "nested", 3),
    # Get changed, Del is gone
    ("r8", "full", "moved", 2),
    ("r8", "full", "nested", 0),
    ("r8", "full", "full", 0),
]


@pytest.fixture(scope="module")
def facts(spark):
    return pd.flatten(spark.createDataFrame(list(DOCS.items()), "schema_id string, content string"))


def test_rules(spark, facts):
    ask = sorted({(b, a) for _, b, a, _ in EXPECTED})
    pairs = spark.createDataFrame([(f"{b}>{a}", b, a) for b, a in ask], "pair string, before string, after string")
    before, after = facts.of_pairs(pairs, "before"), facts.of_pairs(pairs, "after")
    found = {r: {x["pair"]: x["issues"] for x in pr.RULES[r](before, after).collect()} for r in pr.RULES}
    for rule, b, a, issues in EXPECTED:
        assert (rule, b, a, found[rule].get(f"{b}>{a}", 0)) == (rule, b, a, issues)
    verdicts = {r["pair"]: (r["issues"], r["compatible"]) for r in pr.validate(pairs, before, after).collect()}
    for b, a in ask:
        total = sum(found[r].get(f"{b}>{a}", 0) for r in found)
        assert verdicts[f"{b}>{a}"] == (total, total == 0)


def test_facts(facts):
    fields = {(r["schema_id"], r["scope"], r["name"]): r for r in facts.fields.collect()}
    assert fields["full", "M", "b"]["type"] == "map<string, int32>"
    assert fields["full", "M", "a"]["label"] == "repeated"
    assert fields["keeps", "Line", "weight"]["oneof"] == "amount"
    assert ("nested", "B.In", "i") in fields
    assert {r["name"] for r in pr.map_fields(facts.fields).collect()} == {"b"}
    signatures = {(r["schema_id"], r["rpc"]): r["signature"] for r in facts.rpcs.collect()}
    assert signatures["full", "Get"] == "M:true->M:false"
    assert {(r["lo"], r["hi"]) for r in facts.reserved_tags.where("schema_id = 'wide'").collect()} == {(5, 5), (100, 536870911)}


CASES = {
    # text: is it Protobuf
    "": True,
    "// only a note": True,
    "/* a { ; */ message A { }": True,
    'message A { option (x) = "; } {"; string s = 1 [(y) = "}", deprecated = true]; }': True,
    "message A { option (x) = { a: 1 b: { c: 2 } }; int32 i = 1; }": True,
    "message A { int32 i = 0; optional .a.B b = 0x10; extensions 100 to max; }": True,
    "message A { oneof o { int32 i = 1; } reserved 2, 4 to 6; extend B { int32 z = 9; } }": True,
    "enum E { A = 0; B = -1 [deprecated = true]; }": True,
    'import public "a.proto"; import "b.proto"; option java_package = "p";': True,
    "message A { int32 i = 1; ": False,
    "message A { int32 i = 1; } }": False,
    "message A { int32 i; }": False,
    "int32 i = 1;": False,
    "just words 3": False,
    "enum E { int32 i = 1; }": False,
    "service S { int32 i = 1; }": False,
    '{ "type" : "int" }': False,
    "message A { } trailing": False,
}


def test_accepted_texts(spark):
    texts = spark.createDataFrame(list(enumerate(CASES)), "schema_id int, content string")
    got = {r["content"]: r["proto_ok"] for r in pd.parse(texts, "content").collect()}
    assert got == CASES


def test_canonical(spark):
    text = """// a note
    package p; syntax = 'proto3';
    service S { rpc  Get( stream .a.M )returns(M) { option deprecated = true; } option x = 1; }
    message M { enum K { X = 0; } repeated  string a = 1[deprecated=true]; reserved 4,  6 to 8 ; oneof o { int32 i = 2; } map<string,M> m = 3; }
    import "x.proto"; option java_package = "a;b";
    message E { option (v) = { a: 1 b { c: [2] }  d: "}" }; }"""
    want = """//
syntax = "proto3";
package p;

import "x.proto";

option java_package = "a;b";

message M {
  reserved 4, 6 to 8;

  repeated string a = 1 [deprecated=true];
  map<string, M> m = 3;

  oneof o {
    int32 i = 2;
  }

  enum K {
    X = 0;
  }
}
message E {
  option (v) = { a: 1 b { c: [2] } d: "}" };
}

service S {
  option x = 1;

  rpc Get (stream .a.M) returns (M) {
    option deprecated = true;
  };
}
"""
    df = spark.createDataFrame([(text,), (want,)], "raw string")
    assert [r["c"] for r in pd.canonical(df, "raw", "c").collect()] == [want, want]


def _random_doc(rng):
    parts = []
    for scope in ("A", "B"):
        if rng.random() < 0.8:
            names = rng.sample("pqr", rng.randrange(4))
            tags = rng.sample(range(1, 6), len(names))
            body = "".join(f"{rng.choice(['int32', 'string'])} {n} = {t}; " for n, t in zip(names, tags))
            for _ in range(rng.randrange(2)):
                low = rng.randrange(1, 6)
                body += f"reserved {low} to {low + rng.randrange(3)}; "
            if rng.random() < 0.4:
                body += f'reserved "{rng.choice("pqr")}"; '
            parts.append(f"message {scope} {{ {body}}}")
    if rng.random() < 0.7:
        parts.append("enum E { " + "".join(f"{n} = {rng.randrange(2)}; " for n in rng.sample("XYZ", rng.randrange(1, 3))) + "}")
    if rng.random() < 0.7:
        parts.append("service S { " + "".join(f"rpc {n}({rng.choice('AB')}) returns (A); " for n in rng.sample("GH", rng.randrange(3))) + "}")
    return " ".join(parts)


def _grown_doc(rng, step):
    """Mostly compatible documents, so that both verdicts occur."""
    body = "".join(f"int32 f{i} = {i + 1}; " for i in range(step))
    twist = rng.choice(["", "", "", "reserved 40; ", "string g = 50; ", 'reserved "f9"; '])
    return f"message A {{ {body}{twist}}} service S {{ {''.join(f'rpc R{i}(A) returns (A); ' for i in range(step % 4))}}}"


@pytest.mark.parametrize("span", [2])
def test_transitive_equals_pairs(spark, span):
    """Verdicts without pairs equal the eight rules on all pairs of the same history."""
    rng = random.Random(5)
    docs = {i: _random_doc(rng) if i % 2 else _grown_doc(rng, 1 + i // 4) for i in range(24)}
    history = []
    for s in range(8):
        picked = rng.sample(range(0, 24, 2), 6) if s % 2 else rng.sample(range(24), 4)
        history += [(f"s{s}", v + 1, d) for v, d in enumerate(sorted(picked))]
    facts = pd.flatten(spark.createDataFrame(list(docs.items()), "schema_id int, content string"))
    table = spark.createDataFrame(history, "subject string, version int, schema_id int")
    got = {
        (r["subject"], r["at"]): r["backward_issues"] == 0
        for r in elements.audit(elements.as_candidates(table), table, dialect_rules.protobuf(facts), span).collect()
    }
    pairs = spark.createDataFrame(list(itertools.product(docs, docs)), "existing_id int, proposed_id int")
    judged = {(r["existing_id"], r["proposed_id"]): r["compatible"] for r in checks.proto_pairs(pairs, facts).collect()}
    want = {}
    for subject, version, doc in history:
        earlier = [d for s, v, d in history if s == subject and v < version]
        want[subject, version] = all(judged[d, doc] for d in earlier)
    assert got == want
    assert len({v for (s, at), v in got.items() if at > 1}) == 2


def test_enum_alias_last_wins(spark):
    enums = spark.createDataFrame([(1, "E", "A", 0, 0), (1, "E", "B", 1, 1), (1, "E", "C", 1, 2)], "pair int, scope string, name string, tag int, ord int")
    assert sorted((r["tag"], r["name"]) for r in pr.enum_names_by_tag(enums).collect()) == [(0, "A"), (1, "C")]
    assert pr.enum_keys(enums).select(F.count("*")).first()[0] == 5


def test_sets_and_pairs_by_element(spark):
    """Verdicts by messages and services equal the eight rules on all pairs; so do the sets that a fold carries."""
    rng = random.Random(9)
    docs = {i: _random_doc(rng) if i % 2 else _grown_doc(rng, 1 + i // 5) for i in range(30)}
    facts = pd.flatten(spark.createDataFrame(list(docs.items()), "schema_id int, content string"))
    asked = spark.createDataFrame(list(itertools.product(docs, docs)), "existing_id int, proposed_id int")
    want = {(r["existing_id"], r["proposed_id"]): r["compatible"] for r in checks.proto_pairs(asked, facts).collect()}
    rules = dialect_rules.protobuf(facts)
    assert {(r["existing_id"], r["proposed_id"]): r["backward"] for r in elements.pair_verdicts(asked, rules).collect()} == want
    assert 30 < sum(want.values()) < len(want)
    members = spark.createDataFrame([("s", i, 100 - i) for i in docs], "scope string, schema_id int, n bigint")
    sets = {r["schema_id"]: r["backward"] for r in elements.breaking_sets(members, rules).collect()}
    for old, new in itertools.product(docs, docs):
        words, n = sets.get(new) or [], 100 - old
        assert (n // 64 < len(words) and words[n // 64] >> (n % 64) & 1 == 1) != want[old, new]
