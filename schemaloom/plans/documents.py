"""Raw documents to dialect, canonical text and fingerprint."""

from pyspark.sql import DataFrame, functions as F

from ..functions import avro_text
from ..functions.once import with_computed
from ..functions.text import canonical_json, fingerprint
from ..session import spread
from . import protobuf_documents

# The dialects in the order in which they are tried.
DIALECTS = ["AVRO", "PROTOBUF", "JSON_SCHEMA"]


# Fixed value: what a text of no dialect is refused with.
REFUSAL = "can't parse provided schema as any known type"


def _recognise(raws: DataFrame) -> DataFrame:
    """Distinct texts with dialect and what its readers found. Each dialect only sees what the ones before it did not accept."""
    distinct = spread(raws.select("raw").distinct(), "raw")
    # text that is not JSON cannot be Avro, and JSON text cannot be Protobuf: only one reader per text
    typed = with_computed(distinct, "_json", canonical_json(F.col("raw")))
    json_text = F.when(F.col("_json").isNotNull(), F.col("raw"))
    avro = typed.withColumns({"_avro": avro_text.parse(json_text), "_single": avro_text.single_keys(json_text)})
    tried = protobuf_documents.parse(
        avro.withColumn("_maybe_proto", F.when(F.col("_json").isNull(), F.col("raw"))), "_maybe_proto"
    )
    tests = [F.col("_avro.canonical").isNotNull(), F.col("proto_ok"), F.col("_json").isNotNull()]
    return with_computed(tried, "dialect", F.coalesce(*[F.when(t, F.lit(d)) for t, d in zip(tests, DIALECTS)]))


def dialects(raws: DataFrame) -> DataFrame:
    """Distinct texts with dialect, null for a text of none: no canonical text is made."""
    return _recognise(raws).select("raw", "dialect")


def canonicalise(raws: DataFrame) -> DataFrame:
    """Distinct texts with dialect, content (canonical text), hash, the Avro nodes and the Protobuf statements.

    ``raws`` has raw. Work is done once per distinct text; a text of no dialect keeps null in all
    other columns.
    """
    typed = _recognise(raws)
    chosen = protobuf_documents.canonical(
        typed.withColumn("_proto_raw", F.when(F.col("dialect") == "PROTOBUF", F.col("raw"))), "_proto_raw", "_proto"
    )
    content = (
        F.when(F.col("dialect") == "AVRO", F.col("_avro.canonical"))
        .when(F.col("dialect") == "PROTOBUF", F.col("_proto"))
        .when(F.col("dialect") == "JSON_SCHEMA", F.coalesce("_single", "_json"))
    )
    return with_computed(chosen, "content", content).select(
        "raw", "dialect", "content", fingerprint(F.col("content")).alias("hash"),
        F.col("_avro.nodes").alias("avro_nodes"), F.when(F.col("dialect") == "PROTOBUF", F.col("proto_out")).alias("proto_out"),
    )


def with_documents(rows: DataFrame, documents: DataFrame, facts: tuple[str, ...] = ("dialect", "content", "hash")) -> DataFrame:
    """Attach dialect, content and hash, or some of them, to rows that have raw.

    Texts may be as many as rows and far longer than the optimizer takes a string to be, so they are never broadcast.
    """
    return rows.join(documents.select("raw", *facts).hint("merge"), "raw", "left")


def quarantine(rows: DataFrame) -> DataFrame:
    """Rows whose text no dialect accepts, with the reason."""
    return rows.where(F.col("dialect").isNull()).withColumn(
        "reason", F.lit(REFUSAL)
    )


def avro_nodes(documents: DataFrame, key: str) -> DataFrame:
    """One row per node of the Avro documents."""
    return documents.where("dialect = 'AVRO'").select(key, F.inline("avro_nodes"))


def avro_fields(nodes: DataFrame, key: str) -> DataFrame:
    """Fields of the root records: pos, name, type, has_default; a type that is no primitive is its JSON text."""
    typed = F.when(F.col("kind") == "primitive", F.col("type")).otherwise(F.col("text"))
    return nodes.where("role = 'field' and parent_path = ''").select(
        key, "pos", "name", typed.alias("type"), "has_default"
    )
