"""Queries on compatibility: Protobuf rules, Avro verdicts and audits, replay."""

from pyspark.sql import DataFrame, functions as F

from ..operators import avro_nested, dialect_rules, elements, pairs, protobuf_rules as pr, registration, replay
from ..session import cut_plain
from . import documents, fixtures as fx
from .catalog_queries import SQL_VERSIONS, replay_log, schemas, shape_documents, shape_fields, versions

# ---- Protobuf rules on fact tables ---------------------------------------------------------------


def _rpcs(spark, sf) -> DataFrame:
    signature = pr.rpc_signature(F.col("req"), F.col("req_stream"), F.col("resp"), F.col("resp_stream"))
    return fx.view(spark, sf, "fx_prpc").select(
        "pair", "side", F.col("svc").alias("service"), "rpc", signature.alias("signature")
    )


def _facts(spark, sf) -> list[DataFrame]:
    """Fields, reserved tags, reserved names, enums and RPCs of both sides."""
    enums = fx.view(spark, sf, "fx_penum").withColumn("ord", F.col("name"))
    return [fx.view(spark, sf, v) for v in ("fx_pf", "fx_pres_tag", "fx_pres_name")] + [enums, _rpcs(spark, sf)]


def _sides(parts: list[DataFrame]) -> list[pr.ProtoFacts]:
    """Facts before (side 0) and after (side 1)."""
    return [pr.ProtoFacts(*[p.where(F.col("side") == side).drop("side") for p in parts]) for side in (0, 1)]


def _rule(name):
    return lambda spark, sf: pr.RULES[name](*_sides(_facts(spark, sf)))


def q_proto_validate(spark, sf):
    # stored as large as their rows: of compressed facts the optimizer would broadcast millions of rows
    parts = [cut_plain(p) for p in _facts(spark, sf)]
    fields, _, _, enums, rpcs = [p.select("pair").distinct() for p in parts]
    return pr.validate(fields.union(enums).union(rpcs).distinct(), *_sides(parts))


def q_enum_by_tag(spark, sf):
    enums = fx.view(spark, sf, "fx_penum").withColumn("ord", F.col("name"))
    return pr.enum_names_by_tag(enums, "pair", "side", "scope")


def q_proto_enum_keys(spark, sf):
    return pr.enum_keys(fx.view(spark, sf, "fx_penum"), "pair", "side", "scope")


def q_rpc_signature(spark, sf):
    return _rpcs(spark, sf)


def q_proto_map_fields(spark, sf):
    typed = F.when(F.col("tag") >= 100, F.concat(F.lit("map<string, "), "type", F.lit(">"))).otherwise(F.col("type"))
    fields = fx.view(spark, sf, "fx_pf").withColumn("type", typed)
    return pr.map_fields(fields).select("pair", "side", "scope", "name", "type")


# ---- Avro verdicts -------------------------------------------------------------------------------


def live_versions(spark, sf) -> DataFrame:
    return registration.live(versions(spark, sf)).select("subject", "version", "schema_id")


def q_audit_pairs_latest(spark, sf):
    return registration.predecessors(live_versions(spark, sf))


def _reader_pairs(spark, sf):
    steps = registration.predecessors(live_versions(spark, sf)).where("prev_schema_id is not null")
    return steps.select(F.col("schema_id").alias("reader_id"), F.col("prev_schema_id").alias("writer_id"))


def q_avro_type_issues(spark, sf):
    return pairs.avro_type_issues(_reader_pairs(spark, sf), shape_fields(spark, sf))


def q_avro_missing_default(spark, sf):
    return pairs.avro_missing_defaults(_reader_pairs(spark, sf), shape_fields(spark, sf))


def _nested_documents(spark, sf):
    """The record of each shape in a union, and a list: schema_id beside the read document."""
    item = F.element_at(F.array(F.lit("int"), F.lit("long"), F.lit("string")), F.col("schema_id") % 3 + 1)
    text = F.concat(
        F.lit('{"type":"record","name":"outer","fields":[{"name":"body","type":["null",'), "content",
        F.lit(']},{"name":"list","type":{"type":"array","items":"'), item, F.lit('"}}]}'),
    )
    texts = schemas(spark, sf).select("schema_id", text.alias("raw"))
    return texts.join(documents.canonicalise(texts.select("raw")), "raw")


def q_avro_nested_pairs(spark, sf):
    """Neighbouring versions as nested documents, by joins on nodes."""
    nodes = documents.avro_nodes(_nested_documents(spark, sf), "schema_id")
    return avro_nested.nested_pairs(_reader_pairs(spark, sf), nodes)


def _nested_rules(spark, sf) -> elements.Rules:
    return dialect_rules.avro(documents.avro_nodes(_nested_documents(spark, sf), "schema_id"))


def q_avro_document_pairs(spark, sf):
    """The same by the elements that registering compares."""
    asked = _reader_pairs(spark, sf).select(F.col("writer_id").alias("existing_id"), F.col("reader_id").alias("proposed_id"))
    judged = elements.pair_verdicts(asked, _nested_rules(spark, sf))
    return judged.select(F.col("proposed_id").alias("reader_id"), F.col("existing_id").alias("writer_id"), F.col("backward").alias("compatible"))


def _latest(verdict):
    def query(spark, sf):
        audit = pairs.audit_latest(live_versions(spark, sf), dialect_rules.flat_avro(shape_fields(spark, sf)))
        return audit.select("subject", "version", "schema_id", F.col(verdict).alias("compatible"))

    return query


def _transitive(*issues):
    def query(spark, sf):
        found = live_versions(spark, sf)
        rules = dialect_rules.flat_avro(shape_fields(spark, sf))
        audit = elements.audit(elements.as_candidates(found), found, rules)
        total = F.col(issues[0]) if len(issues) == 1 else F.col(issues[0]) + F.col(issues[1])
        return audit.select(
            "subject", F.col("at").cast("int").alias("version"), "schema_id", "earlier",
            total.alias("issues"), (total == 0).alias("compatible"),
        )

    return query


# ---- replay --------------------------------------------------------------------------------------


def _events(spark, sf, repeats):
    return replay.replay_events(replay_log(spark, sf), shape_documents(spark, sf), repeats=repeats)


def q_replay_state(spark, sf):
    return replay.versions_of(_events(spark, sf, False))


def q_delete_subject(spark, sf):
    deleted = _events(spark, sf, False).where("op = 'DELETE_SUBJECT'")
    return deleted.select("subject", "seq", "status", F.explode_outer("versions").alias("version"))


def q_replay_outcomes(spark, sf):
    return _events(spark, sf, True).select(
        "subject", "seq", "op", "status", "schema_id", F.array_join("versions", ",").alias("versions")
    )


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
QUERIES |= {f"q_proto_{r}": _rule(r) for r in pr.RULES}
QUERIES |= {f"q_avro_{v}": _latest(v) for v in ("backward", "forward", "full")}
QUERIES |= {
    "q_avro_backward_transitive": _transitive("backward_issues"),
    "q_avro_forward_transitive": _transitive("forward_issues"),
    "q_avro_full_transitive": _transitive("backward_issues", "forward_issues"),
}

# ---- SQL -----------------------------------------------------------------------------------------

def proto_rules_sql() -> str:
    """Rules r1 to r8 over the facts before (fb, tb, nb, eb, rb) and after (fa, ta, na, ea, ra)."""
    return """ub as (select pair, scope, tag, name from fb union all select pair, scope, tag, max(name) from eb group by 1, 2, 3),
ua as (select pair, scope, tag, name from fa union all select pair, scope, tag, max(name) from ea group by 1, 2, 3),
gone as (select * from fb where not exists (select 1 from fa where fa.pair = fb.pair and fa.scope = fb.scope and fa.name = fb.name)),
r1 as (select pair from fa where exists (select 1 from tb where tb.pair = fa.pair and tb.scope = fa.scope and tb.tag = fa.tag)
  union all select pair from fa where exists (select 1 from nb where nb.pair = fa.pair and nb.scope = fa.scope and nb.name = fa.name)),
r2 as (select pair from (select * from tb except select * from ta)
  union all select pair from (select pair, scope, name from nb except select pair, scope, name from na)),
r3 as (select pair from gone where not exists (select 1 from na where na.pair = gone.pair and na.scope = gone.scope and na.name = gone.name)
  union all select pair from gone where not exists (select 1 from ta where ta.pair = gone.pair and ta.scope = gone.scope and ta.tag = gone.tag)
    and not exists (select 1 from fa where fa.pair = gone.pair and fa.scope = gone.scope and fa.tag = gone.tag)),
r4 as (select pair from fb join fa using (pair, scope, name) where fb.tag <> fa.tag
  union all select pair from eb join ea using (pair, scope, name) where eb.tag <> ea.tag),
r5 as (select pair from fb join fa using (pair, scope, name) where fb.type <> fa.type
  union all select pair from fb join fa using (pair, scope, name) where fb.label is distinct from fa.label),
r6 as (select pair from ub where exists (select 1 from ua where ua.pair = ub.pair and ua.scope = ub.scope)
  and not exists (select 1 from ua where ua.pair = ub.pair and ua.scope = ub.scope and ua.tag = ub.tag and ua.name = ub.name)),
r7 as (select pair from rb where not exists (select 1 from ra where ra.pair = rb.pair and ra.service = rb.service and ra.rpc = rb.rpc)),
r8 as (select pair from rb where exists (select 1 from ra where ra.pair = rb.pair and ra.service = rb.service)
  and not exists (select 1 from ra where ra.pair = rb.pair and ra.service = rb.service and ra.rpc = rb.rpc and ra.signature = rb.signature))"""


SQL_PROTO = f"""{fx.duckdb_views("fx_pf", "fx_pres_tag", "fx_pres_name", "fx_penum", "fx_prpc")},
fb as (select * from fx_pf where side = 0), fa as (select * from fx_pf where side = 1),
tb as (select distinct pair, scope, unnest(range(lo, hi + 1)) as tag from fx_pres_tag where side = 0),
ta as (select distinct pair, scope, unnest(range(lo, hi + 1)) as tag from fx_pres_tag where side = 1),
nb as (select * from fx_pres_name where side = 0), na as (select * from fx_pres_name where side = 1),
eb as (select * from fx_penum where side = 0), ea as (select * from fx_penum where side = 1),
sig as (select pair, side, svc as service, rpc, concat(req, ':', cast(req_stream as varchar), '->', resp, ':', cast(resp_stream as varchar)) as signature from fx_prpc),
rb as (select * from sig where side = 0), ra as (select * from sig where side = 1),
{proto_rules_sql()}"""

SQL_AVRO = f"""{SQL_VERSIONS},
steps as (select subject, version, schema_id, lag(version) over w as prev_version, lag(schema_id) over w as prev_schema_id
  from fx_live window w as (partition by subject order by version)),
reads as (select distinct schema_id as reader_id, prev_schema_id as writer_id from steps where prev_schema_id is not null),
judged as (select s.*, b.n is null as backward, f.n is null as forward from steps s
  left join bad b on b.reader_id = s.schema_id and b.writer_id = s.prev_schema_id
  left join bad f on f.reader_id = s.prev_schema_id and f.writer_id = s.schema_id),
all_pairs as (select v.subject, v.version, v.schema_id, count(e.version) as earlier, coalesce(sum(b.n), 0) as back, coalesce(sum(f.n), 0) as fwd
  from fx_live v left join fx_live e on e.subject = v.subject and e.version < v.version
  left join bad b on b.reader_id = v.schema_id and b.writer_id = e.schema_id
  left join bad f on f.reader_id = e.schema_id and f.writer_id = v.schema_id group by 1, 2, 3)
"""

def _proto(select):
    return f"with {SQL_PROTO} {select}"


def _avro(select):
    return f"with recursive {SQL_AVRO} {select}"


def _replay(select):
    return f"with recursive {SQL_VERSIONS} {select}"


_ALL_RULES = " union all ".join(f"select pair from {r}" for r in pr.RULES)

ORACLES = {f"q_proto_{r}": _proto(f"select pair, count(*) as issues from {r} group by 1") for r in pr.RULES}
ORACLES |= {
    "q_proto_validate": _proto(f"""select p.pair, count(i.pair) as issues, count(i.pair) = 0 as compatible
  from (select pair from fx_pf union select pair from fx_penum union select pair from fx_prpc) p
  left join ({_ALL_RULES}) i using (pair) group by 1"""),
    "q_enum_by_tag": _proto("select pair, side, scope, tag, max(name) as name from fx_penum group by 1, 2, 3, 4"),
    "q_proto_enum_keys": _proto("""select pair, side, scope, cast(tag as varchar) as used from fx_penum
  union select pair, side, scope, name from fx_penum"""),
    "q_rpc_signature": _proto("select pair, side, service, rpc, signature from sig"),
    "q_proto_map_fields": _proto("""select pair, side, scope, name, concat('map<string, ', type, '>') as type
  from fx_pf where tag >= 100"""),
    "q_audit_pairs_latest": _avro("select * from steps"),
    "q_avro_type_issues": _avro("select t.* from typed t join reads using (reader_id, writer_id)"),
    "q_avro_missing_default": _avro("select m.* from missing m join reads using (reader_id, writer_id)"),
    "q_avro_nested_pairs": _avro("""select p.reader_id, p.writer_id,
    b.n is null and (p.reader_id % 3 = p.writer_id % 3 or (p.reader_id % 3 = 1 and p.writer_id % 3 = 0)) as compatible
  from reads p left join bad b using (reader_id, writer_id)"""),
    "q_avro_document_pairs": _avro("""select p.reader_id, p.writer_id,
    b.n is null and (p.reader_id % 3 = p.writer_id % 3 or (p.reader_id % 3 = 1 and p.writer_id % 3 = 0)) as compatible
  from reads p left join bad b using (reader_id, writer_id)"""),
    "q_avro_backward": _avro("select subject, version, schema_id, backward as compatible from judged"),
    "q_avro_forward": _avro("select subject, version, schema_id, forward as compatible from judged"),
    "q_avro_full": _avro("select subject, version, schema_id, backward and forward as compatible from judged"),
    "q_avro_backward_transitive": _avro("select subject, version, schema_id, earlier, cast(back as bigint) as issues, back = 0 as compatible from all_pairs"),
    "q_avro_forward_transitive": _avro("select subject, version, schema_id, earlier, cast(fwd as bigint) as issues, fwd = 0 as compatible from all_pairs"),
    "q_avro_full_transitive": _avro("select subject, version, schema_id, earlier, cast(back + fwd as bigint) as issues, back + fwd = 0 as compatible from all_pairs"),
    "q_replay_state": _replay("""select subject, version, max(schema_id) as schema_id, bool_or(status = 'deleted') as deleted
  from (select subject, status, schema_id, unnest(versions) as version from fold where status in ('added', 'deleted')) group by 1, 2"""),
    "q_delete_subject": _replay("""select subject, seq, status, unnest(case when len(versions) = 0 then [null] else versions end) as version
  from fold where op = 'DELETE_SUBJECT'"""),
    "q_replay_outcomes": _replay("""select subject, seq, op, status, schema_id, array_to_string(versions, ',') as versions from fold where n > 0"""),
}
