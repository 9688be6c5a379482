"""Queries on registration logs and catalog tables, each beside its SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.versions import GLOBAL_SUBJECT
from ..operators import levels, lookup, registration, replay
from ..operators.dialect_rules import flat_avro
from ..operators.elements import Documents
from ..session import cut_plain
from ..sources import documents, responses
from . import fixtures as fx

# ---- shared inputs -------------------------------------------------------------------------------


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.view(spark, sf, "fx_log")
    return log.where("op = 'REGISTER'").select("seq", "subject", F.col("shape").alias("schema_id"))


def shape_fields(spark, sf) -> DataFrame:
    return fx.view(spark, sf, "fx_fields").withColumnRenamed("shape", "schema_id")


def shape_documents(spark, sf) -> Documents:
    """The shapes as flat Avro records; what a fold needs to know of them."""
    fields = shape_fields(spark, sf)
    kinds = fields.select("schema_id").distinct().withColumn("dialect", F.lit("AVRO"))
    return Documents(kinds, (flat_avro(fields),))


def replay_log(spark, sf) -> DataFrame:
    """fx_log with subject deletes and global level changes told apart."""
    return fx.view(spark, sf, "fx_log").select(
        "seq",
        "subject",
        F.expr("""case when op = 'DELETE' and shape = 13 then 'DELETE_SUBJECT'
          when op = 'CONFIG' and seq % 7 = 0 then 'GLOBAL' else op end""").alias("op"),
        F.col("shape").alias("schema_id"),
        F.col("lvl").alias("level_set"),
        F.col("delver").alias("delete_version"),
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """subject, version, schema_id, deleted: what the whole log leaves, refusals, deletes and levels included."""
    events = replay.replay_events(replay_log(spark, sf), shape_documents(spark, sf), repeats=False)
    return cut_plain(replay.versions_of(events))


def schemas(spark: SparkSession, sf: str) -> DataFrame:
    """schema_id, content: the Avro document of each shape."""
    field = F.concat(
        F.lit('{"name":"'), "name", F.lit('","type":"'), "type", F.lit('"'),
        F.when(
            F.col("has_default"),
            F.concat(
                F.lit(',"default":'),
                F.when(F.col("type") == "string", '""').when(F.col("type") == "double", "0.0").otherwise("0"),
            ),
        ).otherwise(""),
        F.lit("}"),
    )
    fields = fx.view(spark, sf, "fx_fields").select(F.col("shape").alias("schema_id"), "pos", field.alias("text"))
    # one group is one document
    listed = fields.groupBy("schema_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("fields"))
    return listed.select(
        "schema_id",
        F.concat(
            F.lit('{"type":"record","name":"rec","fields":['), F.array_join(F.col("fields")["text"], ","), F.lit("]}")
        ).alias("content"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Version requests: seq, subject, token."""
    return fx.view(spark, sf, "fx_log").select(
        "seq", "subject", F.when(F.col("delver") == 0, "Latest").otherwise(F.col("delver").cast("string")).alias("token")
    )


def level_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Level requests: seq, subject, level; some go to the global level."""
    log = fx.view(spark, sf, "fx_log").where("op = 'CONFIG'")
    return log.select(
        "seq",
        F.when(F.col("seq") % 7 == 0, GLOBAL_SUBJECT).otherwise(F.col("subject")).alias("subject"),
        F.col("lvl").alias("level"),
    )


PROMOTED = "('int>long', 'int>float', 'int>double', 'long>float', 'long>double', 'float>double', 'string>bytes', 'bytes>string')"

SQL_VERSIONS = f"""{fx.duckdb_views("fx_log", "fx_fields")},
fx_first as (select subject, shape as schema_id, min(seq) as first_seq from fx_log where op = 'REGISTER' group by 1, 2),
fx_numbered as (select *, cast(row_number() over (partition by subject order by first_seq) as int) as version from fx_first),
fx_schemas as (select shape as schema_id, concat('{{"type":"record","name":"rec","fields":[', string_agg(concat('{{"name":"', name, '","type":"', type, '"',
    case when has_default then concat(',"default":', case type when 'string' then '""' when 'double' then '0.0' else '0' end) else '' end, '}}'), ',' order by pos), ']}}') as content
  from fx_fields group by 1),
fx_requests as (select seq, subject, case when delver = 0 then 'Latest' else cast(delver as varchar) end as token, delver from fx_log),
fx_changes as (select seq, case when seq % 7 = 0 then '_GLOBALCONFIG' else subject end as subject, lvl as level from fx_log where op = 'CONFIG'),
fx_levels as (select subject, arg_max(level, seq) as level from fx_changes group by 1),
fx_subjects as (select distinct subject from fx_log where op = 'REGISTER'),
shapes as (select distinct shape from fx_fields),
typed as (select r.shape as reader_id, w.shape as writer_id, r.name, r.type as reader_type, w.type as writer_type
  from fx_fields r join fx_fields w using (name) where r.type <> w.type and concat(w.type, '>', r.type) not in {PROMOTED}),
missing as (select r.shape as reader_id, s.shape as writer_id, r.name from fx_fields r cross join shapes s
  where not r.has_default and not exists (select 1 from fx_fields w where w.shape = s.shape and w.name = r.name)),
bad as (select reader_id, writer_id, count(*) as n from (select reader_id, writer_id from typed union all select reader_id, writer_id from missing) group by 1, 2),
ops0 as (select seq, subject, case when op = 'DELETE' and shape = 13 then 'DELETE_SUBJECT'
    when op = 'CONFIG' and seq % 7 = 0 then 'GLOBAL' else op end as op, shape + 1 as id, lvl, delver from fx_log),
ops1 as (select *, last_value(case when op = 'CONFIG' then lvl end ignore nulls) over (partition by subject order by seq rows between unbounded preceding and 1 preceding) as own,
    last_value(case when op = 'GLOBAL' then lvl end ignore nulls) over (order by seq rows between unbounded preceding and 1 preceding) as common from ops0),
back as (select s.shape + 1 as id, coalesce(list(b.writer_id + 1) filter (where b.writer_id is not null), []) as back
  from shapes s left join bad b on b.reader_id = s.shape group by 1),
fwd as (select s.shape + 1 as id, coalesce(list(b.reader_id + 1) filter (where b.reader_id is not null), []) as fwd
  from shapes s left join bad b on b.writer_id = s.shape group by 1),
ops as (select o.subject, o.seq, o.op, o.id, o.delver, o.own, coalesce(o.own, o.common, 'NONE') as level, back.back, fwd.fwd,
    row_number() over (partition by o.subject order by o.seq) as n
  from ops1 o join back using (id) join fwd using (id) where o.op in ('REGISTER', 'DELETE', 'DELETE_SUBJECT')),
fold as (select distinct subject, cast(0 as bigint) as n, cast([] as int[]) as ids, cast(null as bigint) as seq, '' as op, '' as status,
    cast(null as int) as schema_id, cast([] as int[]) as versions from ops
  union all
  select subject, n,
    case when status = 'added' then list_append(ids, id)
      when status = 'deleted' then list_transform(ids, lambda x, i: case when list_contains(versions, i) then 0 else x end) else ids end,
    seq, op, status, case when status in ('added', 'present') then id - 1 end, versions
  from (select subject, n, ids, seq, op, id, status,
      case status when 'added' then [cast(len(ids) + 1 as int)] when 'present' then [cast(list_position(ids, id) as int)]
        when 'deleted' then (case when op = 'DELETE' then [cast(target as int)]
          else list_filter(list_transform(ids, lambda x, i: case when x <> 0 then cast(i as int) end), lambda y: y is not null) end)
        else cast([] as int[]) end as versions
    from (select *, case
        when op = 'REGISTER' then (case when len(live) > 0 and not (case level when 'BACKWARD' then not list_contains(back, live[-1])
            when 'FORWARD' then not list_contains(fwd, live[-1])
            when 'FULL' then not list_contains(back, live[-1]) and not list_contains(fwd, live[-1])
            when 'BACKWARD_TRANSITIVE' then not list_has_any(back, live) else true end) then 'refused'
          when list_contains(ids, id) then 'present' else 'added' end)
        when op = 'DELETE' then (case when target between 1 and len(ids) and ids[target] <> 0 then 'deleted' else 'not_found' end)
        else (case when len(ids) > 0 or own is not null then 'deleted' else 'not_found' end) end as status
      from (select o.*, f.ids, list_filter(f.ids, lambda x: x <> 0) as live,
          case when o.delver > 0 then o.delver
            else coalesce(list_max(list_transform(f.ids, lambda x, i: case when x <> 0 then i end)), 0) end as target
        from fold f join ops o on o.subject = f.subject and o.n = f.n + 1)))),
fx_versions as (select subject, version, max(schema_id) as schema_id, bool_or(status = 'deleted') as deleted
  from (select subject, status, schema_id, unnest(versions) as version from fold where status in ('added', 'deleted')) group by 1, 2),
fx_live as (select * from fx_versions where not deleted),
fx_newest as (select subject, max(version) as version, arg_max(schema_id, version) as schema_id from fx_live group by 1)
"""


def sql(select: str) -> str:
    return f"with recursive {SQL_VERSIONS} {select}"


# ---- queries -------------------------------------------------------------------------------------


def q_version_numbers(spark, sf):
    first = registration.first_seen(registrations(spark, sf), ["subject", "schema_id"])
    return registration.number_versions(first).select("subject", "schema_id", "version")


def q_tombstones(spark, sf):
    """Versions that the whole log leaves, each with the operation that added it and whether it was deleted."""
    events = cut_plain(replay.replay_events(replay_log(spark, sf), shape_documents(spark, sf), repeats=False))
    each = events.select("subject", "status", "schema_id", "seq", F.explode("versions").alias("version"))
    gone = each.where("status = 'deleted'").select("subject", "version").distinct().withColumn("deleted", F.lit(True))
    added = each.where("status = 'added'").select("subject", "version", "schema_id", F.col("seq").alias("first_seq"))
    return added.join(gone, ["subject", "version"], "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def q_first_seen(spark, sf):
    return registration.first_seen(registrations(spark, sf), ["subject", "schema_id"])


def q_latest_version(spark, sf):
    return registration.latest_version(versions(spark, sf))


def q_live_versions(spark, sf):
    return registration.live(versions(spark, sf)).select("subject", "version", "schema_id")


def q_subject_deleted(spark, sf):
    return registration.subject_deleted(versions(spark, sf))


def q_list_versions(spark, sf):
    subjects = fx.view(spark, sf, "fx_log").select("subject").distinct()
    return lookup.list_versions(subjects, versions(spark, sf))


def q_list_subjects(spark, sf):
    registered = registrations(spark, sf).select("subject")
    return registered.unionByName(level_changes(spark, sf).select("subject")).distinct()


def q_new_subjects(spark, sf):
    known = registration.live(versions(spark, sf)).where("schema_id = 5").select("subject").distinct()
    return registration.new_subjects(registrations(spark, sf), known)


def q_schema_by_id(spark, sf):
    asked = fx.view(spark, sf, "fx_log").select("seq", (F.col("shape") * 2).alias("schema_id"))
    return lookup.schema_by_id(asked, schemas(spark, sf))


def q_find_in_subject(spark, sf):
    return lookup.find_in_subject(registrations(spark, sf), versions(spark, sf)).select(
        "seq", "subject", "schema_id", "version"
    )


def q_subject_schemas(spark, sf):
    return lookup.subject_schemas(versions(spark, sf), schemas(spark, sf))


def q_resolve_version(spark, sf):
    return lookup.resolve_versions(requests(spark, sf), versions(spark, sf))


def q_schema_at_version(spark, sf):
    return lookup.schema_at_version(requests(spark, sf), versions(spark, sf), schemas(spark, sf))


def q_render_verbose(spark, sf):
    found = lookup.schema_at_version(requests(spark, sf), versions(spark, sf), schemas(spark, sf))
    body = responses.verbose(F.col("content"), F.col("schema_id"), F.col("subject"), F.col("version"))
    return found.select("seq", responses.or_not_found(F.col("content").isNotNull(), body).alias("body"))


def q_valid_level(spark, sf):
    log = fx.view(spark, sf, "fx_log").where("op = 'CONFIG'")
    asked = log.select(
        "seq", F.when(F.col("shape") == 7, F.concat("lvl", F.lit("_TRANSITIVE"))).otherwise(F.col("lvl")).alias("level")
    )
    return levels.check_levels(asked)


def q_subject_levels(spark, sf):
    return levels.subject_levels(level_changes(spark, sf))


def q_effective_level(spark, sf):
    subjects = registrations(spark, sf).select("subject").distinct()
    return levels.effective_level(subjects, levels.subject_levels(level_changes(spark, sf)))


def q_shown_level(spark, sf):
    # subjects that were only ever given a level are asked for, too
    only = level_changes(spark, sf).withColumn("subject", F.concat(F.lit("only-"), "subject"))
    asked = fx.view(spark, sf, "fx_log").select("seq", "subject")
    asked = asked.unionByName(asked.withColumn("subject", F.concat(F.lit("only-"), "subject")))
    return levels.shown_level(
        asked,
        registration.subject_deleted(versions(spark, sf)),
        levels.subject_levels(level_changes(spark, sf).unionByName(only)),
    )


def q_global_level_history(spark, sf):
    changes = level_changes(spark, sf).where(F.col("subject") == GLOBAL_SUBJECT).select("seq", "level")
    return levels.global_level_history(changes)


def q_ingest_envelope(spark, sf):
    posted = fx.view(spark, sf, "fx_raw").select("seq", responses.terse(F.col("raw")).alias("body"))
    put = fx.view(spark, sf, "fx_log").where("op = 'CONFIG'").select("seq", responses.level_set(F.col("lvl")).alias("body"))
    return documents.read_envelopes(posted.unionByName(put))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLES = {
    "q_version_numbers": sql("select subject, schema_id, version from fx_numbered"),
    "q_tombstones": sql("""select a.subject, a.version, a.schema_id, a.seq as first_seq, d.version is not null as deleted
  from (select subject, schema_id, seq, unnest(versions) as version from fold where status = 'added') a
  left join (select distinct subject, unnest(versions) as version from fold where status = 'deleted') d using (subject, version)"""),
    "q_first_seen": sql("select subject, schema_id, first_seq from fx_first"),
    "q_latest_version": sql("select subject, version, schema_id from fx_newest"),
    "q_live_versions": sql("select subject, version, schema_id from fx_live"),
    "q_subject_deleted": sql("select subject, bool_and(deleted) as deleted from fx_versions group by 1"),
    "q_list_versions": sql("""select s.subject, l.version, case when l.version is null then 404 end as error_code
  from (select distinct subject from fx_log) s left join fx_live l using (subject)"""),
    "q_list_subjects": sql("select subject from fx_subjects union select subject from fx_changes"),
    "q_new_subjects": sql("""select subject from fx_subjects
  where subject not in (select subject from fx_live where schema_id = 5)"""),
    "q_schema_by_id": sql("""select r.seq, r.shape * 2 as schema_id, s.content, case when s.content is null then 404 end as error_code
  from fx_log r left join fx_schemas s on s.schema_id = r.shape * 2"""),
    "q_find_in_subject": sql("""select r.seq, r.subject, r.shape as schema_id, l.version
  from fx_log r left join fx_live l on l.subject = r.subject and l.schema_id = r.shape where r.op = 'REGISTER'"""),
    "q_subject_schemas": sql("select subject, version, schema_id, content from fx_live join fx_schemas using (schema_id)"),
    "q_resolve_version": sql("""select r.seq, r.subject, r.token, coalesce(n.version, l.version) as version, coalesce(n.schema_id, l.schema_id) as schema_id
  from fx_requests r left join fx_newest n on r.delver = 0 and n.subject = r.subject
  left join fx_live l on r.delver > 0 and l.subject = r.subject and l.version = r.delver"""),
    "q_schema_at_version": sql("""select r.seq, r.subject, r.token, l.version, l.schema_id, s.content, coalesce(l.schema_id, -1) as client_id
  from fx_requests r left join fx_newest n on n.subject = r.subject
  left join fx_live l on l.subject = r.subject and l.version = case when r.delver = 0 then n.version else r.delver end
  left join fx_schemas s on s.schema_id = l.schema_id"""),
    "q_render_verbose": sql("""select r.seq, case when s.content is null then '{"error_code":404,"message":"Not Found"}'
    else cast(json_object('schema', s.content, 'id', l.schema_id, 'subject', r.subject, 'version', l.version) as varchar) end as body
  from fx_requests r left join fx_newest n on n.subject = r.subject
  left join fx_live l on l.subject = r.subject and l.version = case when r.delver = 0 then n.version else r.delver end
  left join fx_schemas s on s.schema_id = l.schema_id"""),
    "q_valid_level": sql("""select seq, level, case when level in ('NONE', 'BACKWARD', 'BACKWARD_TRANSITIVE', 'FORWARD', 'FULL') then 200 else 422 end as status
  from (select seq, case when shape = 7 then concat(lvl, '_TRANSITIVE') else lvl end as level from fx_log where op = 'CONFIG')"""),
    "q_subject_levels": sql("select subject, level from fx_levels"),
    "q_effective_level": sql("""select s.subject, coalesce(l.level, (select level from fx_levels where subject = '_GLOBALCONFIG'), 'NONE') as level
  from fx_subjects s left join fx_levels l using (subject)"""),
    "q_shown_level": sql("""select r.seq, r.subject, case when shown then coalesce(own, (select level from fx_levels where subject = '_GLOBALCONFIG'), 'NONE') end as level,
    case when not shown then 404 end as error_code
  from (select r.*, l.level as own, coalesce(not d.deleted, l.level is not null) as shown
    from (select seq, subject from fx_log union all select seq, concat('only-', subject) from fx_log) r
    left join (select * from fx_levels union all select concat('only-', subject), level from fx_levels) l using (subject)
    left join (select subject, bool_and(deleted) as deleted from fx_versions group by 1) d using (subject)) r"""),
    "q_global_level_history": sql("""select seq, level, coalesce(lag(level) over (order by seq), 'NONE') as old_level
  from fx_changes where subject = '_GLOBALCONFIG'"""),
    "q_ingest_envelope": f"""with {fx.duckdb_views("fx_log", "fx_raw")}
select seq, raw as schema, cast(null as varchar) as compatibility from fx_raw
union all select seq, null, lvl from fx_log where op = 'CONFIG'""",
}
