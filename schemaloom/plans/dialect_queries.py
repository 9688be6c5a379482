"""Queries on subjects that hold documents of several dialects.

Each shape has a Protobuf document next to its Avro one; for the checks a shape is given one of the
three dialects.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import canonical_json
from ..operators import checks, dialect_rules, elements, levels, protobuf_rules as pr, registration
from . import fixtures as fx, protobuf_documents
from ..session import cut, cut_plain
from .catalog_queries import level_changes, requests, schemas, versions as derived_versions
from .compat_queries import SQL_AVRO, proto_rules_sql, shape_fields

PROTO_TYPES = {"int": "int32", "long": "int64", "string": "string", "double": "double"}


def versions(spark, sf) -> DataFrame:
    return derived_versions(spark, sf)


def live_versions(spark, sf) -> DataFrame:
    return registration.live(versions(spark, sf)).select("subject", "version", "schema_id")


def shape_protos(spark, sf) -> DataFrame:
    """schema_id, content: Protobuf text of each shape."""
    fields = fx.view(spark, sf, "fx_fields")
    place = F.col("pos")
    present = fields.select(
        "shape", place,
        F.concat(
            F.create_map(*[F.lit(x) for p in PROTO_TYPES.items() for x in p])[F.col("type")], F.lit(" "), "name", F.lit(" = "),
            (place + 1 + F.when(F.col("shape") % 5 == 0, 10).otherwise(0)).cast("string"), F.lit(";"),
        ).alias("field"),
    )
    lines = present.groupBy("shape").agg(
        F.sort_array(F.collect_list(F.struct("pos", "field"))).alias("f"), F.collect_set("pos").alias("taken")
    )
    absent = F.filter(
        F.sequence(F.lit(0), F.lit(4)),
        lambda i: ~F.array_contains("taken", i) & ((F.col("shape") + i) % 3 != 1),
    )
    shape = F.col("shape")
    numbers = F.array_join(F.transform(absent, lambda i: (i + 1).cast("string")), ", ")
    names = F.array_join(F.transform(absent, lambda i: F.concat(F.lit('"f'), i.cast("string"), F.lit('"'))), ", ")
    reserved = F.when(F.size(absent) == 0, "").otherwise(
        F.concat(F.lit("reserved "), numbers, F.lit("; reserved "), names, F.lit("; "))
    )
    text = F.concat(
        F.lit('syntax = "proto3"; message Rec { '), reserved, F.array_join(F.col("f")["field"], " "),
        F.lit(" } enum Kind { K0 = 0; V"), (shape % 3).cast("string"), F.lit(" = 1; } service Calls { rpc Get (Rec) returns ("),
        F.when(shape % 4 < 2, "stream ").otherwise(""), F.lit("Rec); rpc P"), (shape % 2).cast("string"),
        F.lit("(Rec) returns (Rec); }"),
    )
    return lines.select(shape.alias("schema_id"), text.alias("content"))


def shape_facts(spark, sf) -> protobuf_documents.DocumentFacts:
    return protobuf_documents.flatten(shape_protos(spark, sf))


def mixed_rules(spark, sf) -> elements.Documents:
    """Rules for all shapes in either dialect; the dialect that a shape has is that of mixed_schemas."""
    kinds = mixed_schemas(spark, sf).select("schema_id", "dialect")
    return elements.Documents(kinds, (dialect_rules.flat_avro(shape_fields(spark, sf)), dialect_rules.protobuf(shape_facts(spark, sf))))


def mixed_schemas(spark, sf) -> DataFrame:
    """schema_id, dialect, raw, content."""
    avro = schemas(spark, sf).select("schema_id", F.col("content").alias("_avro"))
    proto = shape_protos(spark, sf).select("schema_id", F.col("content").alias("_proto"))
    blank = F.when(F.col("schema_id") < 12, "").otherwise(" ")
    json = F.concat(F.lit('{"properties":'), blank, F.lit('{"p'), (F.col("schema_id") % 12).cast("string"), F.lit('":{}}}'))
    dialect = F.when(F.col("schema_id") % 6 == 4, "PROTOBUF").when(F.col("schema_id") % 6 == 5, "JSON_SCHEMA").otherwise("AVRO")
    typed = avro.join(proto, "schema_id").withColumn("dialect", dialect)
    raw = F.when(dialect == "PROTOBUF", F.col("_proto")).when(dialect == "JSON_SCHEMA", json).otherwise(F.col("_avro"))
    content = F.when(dialect == "JSON_SCHEMA", canonical_json(raw)).otherwise(raw)
    return cut(typed.select("schema_id", "dialect", raw.alias("raw"), content.alias("content")))


def _proposals(spark, sf) -> DataFrame:
    log = fx.view(spark, sf, "fx_log").where("op = 'REGISTER'")
    return log.select("seq", "subject", F.col("shape").alias("proposed_id"))


def q_proto_rpcs(spark, sf):
    """One document per service, made from the RPC facts and flattened again."""
    rpcs = fx.view(spark, sf, "fx_prpc")
    stream = lambda c: F.when(F.col(c), "stream ").otherwise("")
    line = F.concat(
        F.lit("rpc "), "rpc", F.lit("("), stream("req_stream"), "req", F.lit(") returns ("), stream("resp_stream"), "resp", F.lit(");")
    )
    texts = rpcs.groupBy("pair", "side", "svc").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    keyed = texts.select(
        F.concat_ws("/", "pair", "side").alias("schema_id"),
        F.concat(F.lit("service "), "svc", F.lit(" {\n"), "lines", F.lit("\n}")).alias("content"),
    )
    return protobuf_documents.flatten(keyed).rpcs.select("schema_id", "service", "rpc", "signature")


def q_proto_message_fields(spark, sf):
    """One document per message, made from the field facts and flattened again."""
    facts = fx.view(spark, sf, "fx_pf")
    label = F.when(F.col("label") == "", "").otherwise(F.concat("label", F.lit(" ")))
    line = F.concat(F.lit("  "), label, "type", F.lit(" "), "name", F.lit(" = "), F.col("tag").cast("string"), F.lit(";"))
    texts = facts.groupBy("pair", "side", "scope").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    keyed = texts.select(
        F.concat_ws("/", "pair", "side").alias("schema_id"),
        F.concat(F.lit("message "), "scope", F.lit(" {\n"), "lines", F.lit("\n}")).alias("content"),
    )
    return protobuf_documents.flatten(keyed).fields.select(
        "schema_id", "scope", "name", "tag", "type", F.coalesce("label", F.lit("")).alias("label")
    )


def q_proto_backward(spark, sf):
    steps = cut_plain(registration.predecessors(registration.live(derived_versions(spark, sf))))
    met = steps.where("prev_schema_id is not null").select(
        F.col("prev_schema_id").alias("existing_id"), F.col("schema_id").alias("proposed_id")
    )
    judged = checks.proto_pairs(met, shape_facts(spark, sf)).select(
        F.col("existing_id").alias("prev_schema_id"), F.col("proposed_id").alias("schema_id"), "issues"
    )
    return steps.join(judged, ["prev_schema_id", "schema_id"], "left").select(
        "subject", "version", "schema_id", F.coalesce("issues", F.lit(0)).alias("issues"),
        (F.coalesce("issues", F.lit(0)) == 0).alias("compatible"),
    )


def q_proto_backward_transitive(spark, sf):
    found = live_versions(spark, sf)
    audit = elements.audit(elements.as_candidates(found), found, dialect_rules.protobuf(shape_facts(spark, sf)))
    compatible = (F.col("backward_issues") == 0).alias("compatible")
    return audit.select("subject", F.col("at").cast("int").alias("version"), "schema_id", compatible)


def q_json_schema_compat(spark, sf):
    """Every proposed raw text against the oldest live canonical text.

    Requests carry numbers; texts are compared once per distinct pair.
    """
    known = mixed_schemas(spark, sf)
    ids = known.select("schema_id")
    held = registration.live(derived_versions(spark, sf)).join(ids, "schema_id", "left_semi")
    oldest = held.groupBy("subject").agg(F.min_by("schema_id", "version").alias("_first"))
    proposed = _proposals(spark, sf).join(ids.withColumnRenamed("schema_id", "proposed_id"), "proposed_id", "left_semi")
    asked = cut_plain(proposed.join(oldest, "subject", "left").select("seq", "proposed_id", "_first"))
    pairs = asked.select("proposed_id", "_first").distinct()
    texts = pairs.join(known.select(F.col("schema_id").alias("proposed_id"), "raw"), "proposed_id").join(
        known.select(F.col("schema_id").alias("_first"), "content"), "_first"
    )
    same = texts.select("proposed_id", "_first", (F.col("content") == F.col("raw")).alias("_same"))
    judged = asked.join(same, ["proposed_id", "_first"], "left")
    return judged.select("seq", F.coalesce("_same", F.lit(True)).alias("is_compatible"))


def q_check_version(spark, sf):
    tokens = requests(spark, sf).select("seq", "token")
    return checks.check_version(
        _proposals(spark, sf).join(tokens, "seq"),
        versions(spark, sf),
        cut(levels.subject_levels(level_changes(spark, sf))),
        mixed_schemas(spark, sf),
        mixed_rules(spark, sf),
    )


def q_verdict(spark, sf):
    return checks.check_before_registering(
        _proposals(spark, sf),
        versions(spark, sf),
        cut(levels.subject_levels(level_changes(spark, sf))),
        mixed_schemas(spark, sf),
        mixed_rules(spark, sf),
    )


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

# ---- SQL -----------------------------------------------------------------------------------------

# facts of the Protobuf documents, written out from the shapes, and the rules over all shape pairs
SQL_MIXED = f"""{SQL_AVRO},
slots as (select shape, i, ((shape + 8) & (1 << i)) <> 0 as present from shapes cross join (select unnest(range(5)) as i)),
pf as (select shape, 'Rec' as scope, name, pos + 1 + case when shape % 5 = 0 then 10 else 0 end as tag,
    case type when 'int' then 'int32' when 'long' then 'int64' else type end as type, '' as label from fx_fields),
pt as (select shape, 'Rec' as scope, i + 1 as tag, concat('f', i) as name from slots where not present and (shape + i) % 3 <> 1),
pe as (select shape, 'Kind' as scope, 'K0' as name, 0 as tag from shapes union all select shape, 'Kind', concat('V', shape % 3), 1 from shapes),
pr as (select shape, 'Calls' as service, 'Get' as rpc, concat('Rec:false->Rec:', cast(shape % 4 < 2 as varchar)) as signature from shapes
  union all select shape, 'Calls', concat('P', shape % 2), 'Rec:false->Rec:false' from shapes),
duo as (select b.shape as b, a.shape as a, b.shape * 100 + a.shape as pair from shapes b cross join shapes a),
fb as (select pair, scope, name, tag, type, label from duo join pf on shape = b), fa as (select pair, scope, name, tag, type, label from duo join pf on shape = a),
tb as (select pair, scope, tag from duo join pt on shape = b), ta as (select pair, scope, tag from duo join pt on shape = a),
nb as (select pair, scope, name from duo join pt on shape = b), na as (select pair, scope, name from duo join pt on shape = a),
eb as (select pair, scope, name, tag from duo join pe on shape = b), ea as (select pair, scope, name, tag from duo join pe on shape = a),
rb as (select pair, service, rpc, signature from duo join pr on shape = b), ra as (select pair, service, rpc, signature from duo join pr on shape = a),
{proto_rules_sql()},
proto_bad as (select d.b, d.a, count(*) as n from duo d join ({" union all ".join(f"select pair from {r}" for r in pr.RULES)}) i using (pair) group by 1, 2),
kinds as (select shape, case shape % 6 when 4 then 'PROTOBUF' when 5 then 'JSON_SCHEMA' else 'AVRO' end as dialect,
    concat('{{"properties":{{"p', shape % 12, '":{{}}}}}}') as json_content,
    concat('{{"properties":', case when shape < 12 then '' else ' ' end, '{{"p', shape % 12, '":{{}}}}}}') as json_raw from shapes),
tried as (select seq, subject, shape, delver from fx_log where op = 'REGISTER'),
in_force as (select t.*, coalesce(l.level, (select level from fx_levels where subject = '_GLOBALCONFIG'), 'NONE') as level
  from tried t left join fx_levels l using (subject)),
ends as (select subject, min(version) as first, max(version) as last from fx_live group by 1),
oldest as (select e.subject, k.* from ends e join fx_live l on l.subject = e.subject and l.version = e.first join kinds k on k.shape = l.schema_id),
duos as (select d.b, d.a, kb.dialect as b_dialect, ka.dialect as a_dialect, back.n is null as back, fwd.n is null as fwd, pb.n is null as proto,
    kb.json_content = ka.json_raw as same
  from duo d join kinds kb on kb.shape = d.b join kinds ka on ka.shape = d.a
  left join bad back on back.reader_id = d.a and back.writer_id = d.b left join bad fwd on fwd.reader_id = d.b and fwd.writer_id = d.a
  left join proto_bad pb on pb.b = d.b and pb.a = d.a)
"""


def _mixed(select):
    return f"with recursive {SQL_MIXED} {select}"


_VERDICT = """case when b_dialect = 'JSON_SCHEMA' then same when level = 'NONE' then true
  when b_dialect = 'PROTOBUF' and level in ('FORWARD', 'FULL') then null when b_dialect <> a_dialect then false
  when b_dialect = 'PROTOBUF' then proto when level like 'BACKWARD%' then back when level = 'FORWARD' then fwd else back and fwd end"""
_REASON = """case when b_dialect = 'JSON_SCHEMA' or level = 'NONE' then null
  when b_dialect = 'PROTOBUF' and level in ('FORWARD', 'FULL') then 'unsupported' when b_dialect <> a_dialect then 'dialect' end"""

ORACLES = {
    "q_proto_rpcs": f"""with {fx.duckdb_views("fx_prpc")} select concat(pair, '/', side) as schema_id, svc as service, rpc,
  concat(req, ':', cast(req_stream as varchar), '->', resp, ':', cast(resp_stream as varchar)) as signature from fx_prpc""",
    "q_proto_message_fields": f"""with {fx.duckdb_views("fx_pf")}
select concat(pair, '/', side) as schema_id, scope, name, tag, type, label from fx_pf""",
    "q_proto_backward": _mixed("""select s.subject, s.version, s.schema_id, coalesce(p.n, 0) as issues, p.n is null as compatible
  from steps s left join proto_bad p on p.b = s.prev_schema_id and p.a = s.schema_id"""),
    "q_proto_backward_transitive": _mixed("""select v.subject, v.version, v.schema_id, count(p.n) = 0 as compatible
  from fx_live v left join fx_live e on e.subject = v.subject and e.version < v.version
  left join proto_bad p on p.b = e.schema_id and p.a = v.schema_id group by 1, 2, 3"""),
    # Avro and Protobuf texts never equal a JSON text; those of shapes are equal for the same shape only
    "q_json_schema_compat": _mixed("""select t.seq, case when o.subject is null then true
      when o.dialect = 'JSON_SCHEMA' then k.dialect = 'JSON_SCHEMA' and o.json_content = k.json_raw else o.shape = t.shape end as is_compatible
  from tried t join kinds k using (shape) left join oldest o using (subject)"""),
    "q_check_version": _mixed(f"""select t.seq, t.subject, case when l.version is not null then {_VERDICT} end as is_compatible,
    case when l.version is not null then {_REASON} end as reason, case when l.version is null then 404 end as error_code
  from in_force t left join ends e using (subject)
  left join fx_live l on l.subject = t.subject and l.version = case when t.delver = 0 then e.last else t.delver end
  left join duos d on d.b = l.schema_id and d.a = t.shape"""),
    "q_verdict": _mixed(f"""select t.seq, t.subject,
    case when l.version is null then true when b_dialect = 'JSON_SCHEMA' then o.json_content = k.json_raw and o.dialect = 'JSON_SCHEMA' and k.dialect = 'JSON_SCHEMA'
        or (o.dialect <> 'JSON_SCHEMA' and o.shape = t.shape)
      when level = 'BACKWARD_TRANSITIVE' then b_dialect = a_dialect and not w.mixed and not w.broken
      else {_VERDICT} end as is_compatible,
    case when l.version is null then null when level = 'BACKWARD_TRANSITIVE' and b_dialect <> 'JSON_SCHEMA'
      then case when w.mixed or b_dialect <> a_dialect then 'dialect' end else {_REASON} end as reason
  from in_force t join kinds k using (shape) left join ends e using (subject) left join oldest o on o.subject = t.subject
  left join fx_live l on l.subject = t.subject and l.version = e.last
  left join duos d on d.b = l.schema_id and d.a = t.shape
  left join (select h.subject, p.a, count(distinct p.b_dialect) > 1 as mixed,
      bool_or(case when p.a_dialect = 'PROTOBUF' then not p.proto else not p.back end) as broken
    from fx_live h join duos p on p.b = h.schema_id group by 1, 2) w on w.subject = t.subject and w.a = t.shape"""),
}
