"""Registry-shaped views over the driver's tables.

The SQL texts are shared with the oracle; only ``EV`` differs by engine.
"""

from pyspark.sql import DataFrame, SparkSession

EV_SPARK = "select event_id, user_id, event_type, cast(get_json_object(props, '$.k') as int) as k from @src"
EV_DUCKDB = "select event_id, user_id, event_type, cast(json_extract_string(props, '$.k') as int) as k from @src"

VIEWS = {
    "fx_log": """select event_id as seq, concat('subj-', cast(user_id as varchar(20))) as subject,
  case event_type when 'error' then 'DELETE' when 'purchase' then 'CONFIG' else 'REGISTER' end as op,
  k % 24 as shape,
  case k % 5 when 0 then 'NONE' when 1 then 'BACKWARD' when 2 then 'BACKWARD_TRANSITIVE' when 3 then 'FORWARD' else 'FULL' end as lvl,
  case when k % 2 = 0 then 0 else k % 7 + 1 end as delver from @src""",
    "fx_fields": """select shape, i as pos, concat('f', cast(i as varchar(2))) as name,
  case (case when i % 2 = 1 then (shape + i) % 4 else shape % 2 end) when 0 then 'int' when 1 then 'long' when 2 then 'string' else 'double' end as type,
  ((shape + i) % 3 = 0) as has_default
  from (select distinct k % 24 as shape from @src) s cross join (values (0, 1), (1, 2), (2, 4), (3, 8), (4, 16)) as p(i, b)
  where ((shape + 8) & b) <> 0""",
    "fx_pf": """select l_suppkey as pair, case when l_linestatus = 'F' then 0 else 1 end as side,
  concat('M', cast(l_orderkey % 50 as varchar(9))) as scope,
  concat(case when min(l_partkey) % 3 = 0 then 'g' else 'f' end, cast(l_linenumber as varchar(2))) as name,
  l_linenumber + (case when min(l_partkey) % 11 = 0 then 100 else 0 end) as tag, min(l_returnflag) as type,
  case when min(l_orderkey) % 7 = 0 then 'repeated' else '' end as label
  from @src group by l_suppkey, case when l_linestatus = 'F' then 0 else 1 end, concat('M', cast(l_orderkey % 50 as varchar(9))), l_linenumber""",
    "fx_pres_tag": """select distinct cast(floor(o_custkey / 10) as bigint) as pair, cast(o_orderkey % 2 as int) as side,
  concat('M', cast(o_orderkey % 50 as varchar(9))) as scope, cast(o_custkey % 9 + 1 as int) as lo, cast(o_custkey % 9 + 1 + o_orderkey % 3 as int) as hi from @src""",
    "fx_pres_name": """select distinct cast(floor(o_custkey / 10) as bigint) as pair, cast(o_custkey % 2 as int) as side,
  concat('M', cast(o_orderkey % 50 as varchar(9))) as scope, concat(case when o_orderkey % 2 = 0 then 'f' else 'g' end, cast(o_custkey % 7 + 1 as varchar(2))) as name from @src""",
    "fx_penum": """select cast(floor(p_partkey / 10) as bigint) as pair, p_size % 2 as side, p_brand as scope, p_type as name, min(p_size) % 5 as tag
  from @src group by cast(floor(p_partkey / 10) as bigint), p_size % 2, p_brand, p_type""",
    "fx_prpc": """select user_id as pair, cast(event_id % 2 as int) as side, concat('S', cast(user_id as varchar(9))) as svc,
  concat(event_type, cast(k % 10 as varchar(2))) as rpc,
  concat('T', cast(min(k) % 3 as varchar(2))) as req, (min(k) % 2 = 0) as req_stream, 'R' as resp, (max(k) % 4 < 2) as resp_stream
  from @src group by user_id, event_id % 2, concat('S', cast(user_id as varchar(9))), concat(event_type, cast(k % 10 as varchar(2)))""",
    "fx_cols": """select replace(p_brand, '#', '_') as tbl, p_partkey as ordinal, concat('c', cast(p_partkey as varchar(9))) as col,
  case p_size % 8 when 0 then 4 when 1 then -5 when 2 then 6 when 3 then 8 when 4 then 16 when 5 then -2 when 6 then 12 else 3 end as jdbc_type from @src""",
    "fx_raw": """select event_id as seq, case k % 4 when 0 then 'AVRO' when 1 then 'PROTOBUF' when 2 then 'JSON_SCHEMA' else 'NONE' end as doc_kind,
  case k % 4
   when 0 then concat('{ "type" : "record", "name":"r', cast(cast(floor(event_id / 3) as bigint) as varchar(19)), '",  "fields":[ {"name":"ab", "type":"int", "doc":"x  y"} ] }')
   when 1 then concat('syntax = "proto3"; message M', cast(cast(floor(event_id / 3) as bigint) as varchar(19)), ' { int32 a = 1; }')
   when 2 then concat('{ "properties" : {"z', cast(cast(floor(event_id / 3) as bigint) as varchar(19)), '": {"type": "string"}, "a": {"type":"string"}} }')
   else case when k % 8 = 3 then concat('message A', cast(cast(floor(event_id / 3) as bigint) as varchar(19)), ' { int32 a = 99999999999; }') else concat('just words ', cast(cast(floor(event_id / 3) as bigint) as varchar(19))) end end as raw from @src""",
}

BASE = {
    "fx_log": "ev", "fx_fields": "ev", "fx_prpc": "ev", "fx_raw": "ev",
    "fx_pf": "lineitem", "fx_pres_tag": "orders", "fx_pres_name": "orders",
    "fx_penum": "part", "fx_cols": "part",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the same rows as VIEWS["fx_fields"] by a generator, where the shared text joins a list of constants
FX_FIELDS_SPARK = """select shape, i as pos, concat('f', cast(i as varchar(2))) as name,
  case (case when i % 2 = 1 then (shape + i) % 4 else shape % 2 end) when 0 then 'int' when 1 then 'long' when 2 then 'string' else 'double' end as type,
  ((shape + i) % 3 = 0) as has_default
  from (select distinct k % 24 as shape from @src) s lateral view explode(sequence(0, 4)) p as i
  where ((shape + 8) & shiftleft(1, i)) <> 0"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame over the tables in ``sf_dir``."""
    base = BASE[name]
    if base == "ev":
        table(spark, sf_dir, "events").createOrReplaceTempView("fx_source_events")
        spark.sql(EV_SPARK.replace("@src", "fx_source_events")).createOrReplaceTempView("fx_source_ev")
    else:
        table(spark, sf_dir, base).createOrReplaceTempView(f"fx_source_{base}")
    text = FX_FIELDS_SPARK if name == "fx_fields" else VIEWS[name]
    return spark.sql(text.replace("@src", f"fx_source_{base}"))


def duckdb_views(*names: str) -> str:
    """The fixture views as the opening of a WITH list, without the word WITH."""
    parts = []
    if any(BASE[n] == "ev" for n in names):
        parts.append(f"ev as ({EV_DUCKDB.replace('@src', 'events')})")
    parts += [f"{n} as ({VIEWS[n].replace('@src', BASE[n])})" for n in names]
    return ",\n".join(parts)
