"""Queries on raw documents: dialect, canonical text, fingerprints, facts, column metadata."""

from pyspark.sql import functions as F

from ..operators import lookup, registration
from ..session import cut
from . import documents, fixtures as fx, protobuf_documents, registering
from .catalog_queries import schemas

# Canonical texts of fx_raw, written out from k for the SQL side.
SQL_RAW = f"""{fx.duckdb_views("fx_raw")},
fx_documents as (select seq, doc_kind, raw, case doc_kind
   when 'AVRO' then concat('{{"type":"record","name":"r', n, '","fields":[{{"name":"ab","type":"int","doc":"x  y"}}]}}')
   when 'PROTOBUF' then concat(E'//\\nsyntax = "proto3";\\n\\nmessage M', n, E' {{\\n  int32 a = 1;\\n}}\\n')
   when 'JSON_SCHEMA' then cast(json(raw) as varchar) end as content, n
  from (select *, cast(floor(seq / 3) as bigint) as n from fx_raw)),
fx_distinct as (select content, min(seq) as first_seq, min(doc_kind) as doc_kind from fx_documents where content is not null group by 1),
fx_ids as (select *, cast(row_number() over (order by first_seq) as int) as schema_id, sha256(content) as hash from fx_distinct)
"""


def sql(select: str) -> str:
    return f"with {SQL_RAW} {select}"


def raw_documents(spark, sf, keep=lambda df: df):
    """seq, raw, dialect, content, hash of every raw text; ``keep`` may store the distinct texts."""
    rows = fx.view(spark, sf, "fx_raw").select("seq", "raw")
    return documents.with_documents(rows, keep(documents.canonicalise(rows)))


def raw_dialects(spark, sf):
    """seq, raw, dialect of every raw text."""
    rows = fx.view(spark, sf, "fx_raw").select("seq", "raw")
    return documents.with_documents(rows, documents.dialects(rows), ("dialect",))


def distinct_documents(spark, sf):
    """content, hash, first_seq of the accepted texts."""
    return registration.dedup_schemas(raw_documents(spark, sf).where(F.col("hash").isNotNull()))


def shape_documents(spark, sf):
    """The Avro documents of the shapes, read back from their text."""
    texts = schemas(spark, sf)
    read = documents.canonicalise(texts.select(F.col("content").alias("raw")))
    return texts.select("schema_id", F.col("content").alias("raw")).join(read, "raw")


def q_detect_dialect(spark, sf):
    return raw_dialects(spark, sf).select("seq", "dialect")


def q_quarantine(spark, sf):
    return documents.quarantine(raw_dialects(spark, sf)).select("seq", "raw", "reason")


def q_rejected(spark, sf):
    """What registering the raw texts sets aside."""
    asked = fx.view(spark, sf, "fx_raw").select("seq", F.col("doc_kind").alias("subject"), "raw")
    return registering.rejected(asked)


def q_canonical_avro(spark, sf):
    return raw_documents(spark, sf).where("dialect = 'AVRO'").select("seq", "content")


def q_canonical_json(spark, sf):
    return raw_documents(spark, sf).where("dialect = 'JSON_SCHEMA'").select("seq", "content")


def q_canonical_proto(spark, sf):
    return raw_documents(spark, sf).where("dialect = 'PROTOBUF'").select("seq", "content")


def q_fingerprint(spark, sf):
    return raw_documents(spark, sf).where(F.col("hash").isNotNull()).select("seq", "hash")


def q_dedup_schemas(spark, sf):
    return distinct_documents(spark, sf)


def q_schema_ids(spark, sf):
    return registration.assign_schema_ids(distinct_documents(spark, sf)).select("schema_id", "hash", "first_seq")


def q_schema_by_hash(spark, sf):
    """All texts searched in the Avro part of the catalog."""
    rows = raw_documents(spark, sf, cut)
    known = registration.assign_schema_ids(
        registration.dedup_schemas(rows.where("dialect = 'AVRO'").select("seq", "hash", "content"))
    )
    return lookup.schema_by_hash(rows.select("seq", "hash"), known)


def q_avro_fields(spark, sf):
    rows = fx.view(spark, sf, "fx_raw").select("raw")
    nodes = documents.avro_nodes(documents.canonicalise(rows), "hash")
    return documents.avro_fields(nodes, "hash")


def q_avro_shape_fields(spark, sf):
    """Flattening the rendered documents gives the field facts back."""
    return documents.avro_fields(documents.avro_nodes(shape_documents(spark, sf), "schema_id"), "schema_id")


def _proto_facts(spark, sf):
    found = documents.canonicalise(fx.view(spark, sf, "fx_raw").select("raw")).where("dialect = 'PROTOBUF'")
    return protobuf_documents.flatten(found.select(F.col("hash").alias("schema_id"), "content"))


def q_proto_fields(spark, sf):
    return _proto_facts(spark, sf).fields.select(F.col("schema_id").alias("hash"), "scope", "name", "tag", "type", "label")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLES = {
    "q_detect_dialect": sql("select seq, nullif(doc_kind, 'NONE') as dialect from fx_raw"),
    "q_quarantine": sql("""select seq, raw, 'can''t parse provided schema as any known type' as reason
  from fx_raw where doc_kind = 'NONE'"""),
    "q_rejected": sql("""select seq, doc_kind as subject, raw, 'can''t parse provided schema as any known type' as reason
  from fx_raw where doc_kind = 'NONE'"""),
    "q_canonical_avro": sql("select seq, content from fx_documents where doc_kind = 'AVRO'"),
    "q_canonical_json": sql("select seq, cast(json(raw) as varchar) as content from fx_raw where doc_kind = 'JSON_SCHEMA'"),
    "q_canonical_proto": sql("select seq, content from fx_documents where doc_kind = 'PROTOBUF'"),
    "q_fingerprint": sql("select seq, sha256(content) as hash from fx_documents where content is not null"),
    "q_dedup_schemas": sql("select hash, content, first_seq from fx_ids"),
    "q_schema_ids": sql("select schema_id, hash, first_seq from fx_ids"),
    "q_schema_by_hash": sql("""select d.seq, sha256(d.content) as hash, i.schema_id from fx_documents d
  left join (select content, cast(row_number() over (order by first_seq) as int) as schema_id
    from fx_distinct where doc_kind = 'AVRO') i using (content)"""),
    "q_avro_fields": sql("""select hash, 0 as pos, 'ab' as name, 'int' as type, false as has_default
  from fx_ids where doc_kind = 'AVRO'"""),
    "q_avro_shape_fields": f"""with {fx.duckdb_views("fx_fields")}
select shape as schema_id, cast(row_number() over (partition by shape order by pos) - 1 as int) as pos, name, type, has_default from fx_fields""",
    "q_proto_fields": sql("""select i.hash, concat('M', d.n) as scope, 'a' as name, 1 as tag, 'int32' as type, cast(null as varchar) as label
  from fx_ids i join (select distinct content, n from fx_documents where doc_kind = 'PROTOBUF') d using (content)"""),
}
