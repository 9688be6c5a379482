"""Queries on type mapping and schema exchange."""

from pyspark.sql import functions as F, types as T

from ..functions.types import jdbc_to_avro
from ..functions.text import fingerprint
from ..sources import columns
from . import fixtures as fx, registering

PROPS = T.StructType([T.StructField("k", T.IntegerType(), False)])


def q_jdbc_types(spark, sf):
    return fx.view(spark, sf, "fx_cols").select("tbl", "col", "jdbc_type", jdbc_to_avro(F.col("jdbc_type")).alias("avro_type"))


def q_columns_to_avro(spark, sf):
    return columns.columns_to_avro(fx.view(spark, sf, "fx_cols"))


def q_associate(spark, sf):
    """The document of each table registered under the name of the table."""
    cols = fx.view(spark, sf, "fx_cols")
    first = cols.groupBy(F.col("tbl").alias("subject")).agg(F.min("ordinal").alias("seq"))
    texts = columns.columns_to_avro(cols).select(F.col("tbl").alias("subject"), F.col("content").alias("raw"))
    catalog = registering.register(texts.join(first, "subject"))
    return registering.latest_documents(catalog).select(
        "subject", "version", "schema_id", fingerprint(F.col("content")).alias("hash")
    )


def q_apply_schema(spark, sf):
    """events.props read with the schema registered for it."""
    made = columns.struct_documents(spark, {"events_props": PROPS}).withColumn("seq", F.lit(1).cast("bigint"))
    resolved = registering.resolve(registering.register(made), "events_props")
    events = fx.table(spark, sf, "events").select("event_id", registering.read_json(F.col("props"), resolved).alias("p"))
    return events.select("event_id", "p.*")


def q_apply_table_schema(spark, sf):
    """The rows of a table as JSON, read back with the schema registered for the table."""
    part = fx.table(spark, sf, "part")
    made = columns.struct_documents(spark, {"part": part.schema}).withColumn("seq", F.lit(1).cast("bigint"))
    resolved = registering.resolve(registering.register(made), "part")
    text = F.to_json(F.struct(*part.columns))
    return part.select(registering.read_json(text, resolved).alias("p")).select("p.*")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_TYPE = "case jdbc_type when 4 then 'int' when -5 then 'long' when 6 then 'float' when 8 then 'double' when 16 then 'boolean' when -2 then 'bytes' else 'string' end"
_SQL = f"""with {fx.duckdb_views("fx_cols")},
texts as (select tbl, concat('{{"type":"record","name":"', tbl, '","fields":[', string_agg(concat('{{"name":"', col, '","type":"', {_TYPE}, '"}}'), ',' order by ordinal), ']}}') as content,
  min(ordinal) as seq from fx_cols group by 1)"""

ORACLES = {
    "q_jdbc_types": f"{_SQL} select tbl, col, jdbc_type, {_TYPE} as avro_type from fx_cols",
    "q_columns_to_avro": f"{_SQL} select tbl, content from texts",
    "q_associate": f"""{_SQL} select tbl as subject, 1 as version, cast(row_number() over (order by seq) as int) as schema_id, sha256(content) as hash from texts""",
    "q_apply_schema": "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
    "q_apply_table_schema": "select * from part",
}
