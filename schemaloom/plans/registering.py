"""Registering documents given as text, and reading data with a registered schema."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.types import document_to_struct
from ..operators import dialect_rules, registration, replay
from ..operators.elements import Documents
from ..session import cut, cut_plain
from . import documents
from .protobuf_documents import facts_of


@dataclass(frozen=True)
class Catalog:
    """schemas: schema_id, hash, dialect, content; versions: subject, version, schema_id, deleted.

    rejected: seq, subject, raw, reason of the requests whose text no dialect accepts.
    """

    schemas: DataFrame
    versions: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class Numbered:
    """log: registrations by schema id; schemas: schema_id, hash, dialect, content; docs: what a fold knows of them; rejected."""

    log: DataFrame
    schemas: DataFrame
    docs: Documents
    rejected: DataFrame


def _refusals(typed: DataFrame) -> DataFrame:
    return documents.quarantine(typed).select("seq", "subject", "raw", "reason")


def rejected(requests: DataFrame) -> DataFrame:
    """The requests that registering sets aside, without numbering the others."""
    return _refusals(documents.with_documents(requests, documents.dialects(requests.select("raw")), ("dialect",)))


def number_documents(requests: DataFrame) -> Numbered:
    """Requests (seq, subject, raw) by schema id; those with a text of no dialect are set aside as rejected."""
    # texts are read once and kept: everything below joins to them
    read = cut(documents.canonicalise(requests.select("raw")))
    typed = documents.with_documents(requests, read)
    known = typed.where(F.col("hash").isNotNull())
    numbered = registration.assign_schema_ids(registration.dedup_schemas(known.select("seq", "hash", "content")))
    facts = read.where(F.col("hash").isNotNull()).groupBy("hash").agg(
        F.any_value(F.struct("dialect", "avro_nodes", "proto_out")).alias("f")
    )
    described = cut(numbered.join(facts.hint("merge"), "hash").select("schema_id", "hash", "content", "f.dialect", "f.avro_nodes", "f.proto_out"))
    exact = (F.col("raw") == F.col("content")).alias("exact")
    log = known.select("seq", "subject", "hash", exact).join(described.select("hash", "schema_id").hint("merge"), "hash").select(
        "seq",
        "subject",
        F.lit("REGISTER").alias("op"),
        "schema_id",
        F.lit(None).cast("string").alias("level_set"),
        F.lit(0).alias("delete_version"),
        "exact",
    )
    schemas = described.select("schema_id", "hash", "dialect", "content")
    return Numbered(log, schemas, rules_of(described), _refusals(typed))


def rules_of(described: DataFrame) -> Documents:
    """Documents (schema_id, dialect, avro_nodes, proto_out) as a fold compares them."""
    avro = dialect_rules.avro(documents.avro_nodes(described, "schema_id"))
    proto = dialect_rules.protobuf(facts_of(described.where("dialect = 'PROTOBUF'")))
    return Documents(described.select("schema_id", "dialect"), (avro, proto))


def with_settings(numbered: Numbered, settings: DataFrame) -> DataFrame:
    """The log with more rows, for levels and deletes."""
    return numbered.log.unionByName(settings.withColumn("exact", F.lit(True)))


def register(requests: DataFrame, settings: DataFrame | None = None) -> Catalog:
    """Register documents (seq, subject, raw) in order and return the catalog.

    ``settings`` may add log rows for levels and deletes.
    """
    numbered = number_documents(requests)
    log = with_settings(numbered, settings) if settings is not None else numbered.log
    events = replay.replay_events(log, numbered.docs, repeats=False)
    return Catalog(numbered.schemas, cut_plain(replay.versions_of(events)), numbered.rejected)


def latest_documents(catalog: Catalog) -> DataFrame:
    """Latest live Avro document per subject: subject, version, schema_id, content."""
    newest = registration.latest_version(catalog.versions)
    return newest.join(catalog.schemas.where("dialect = 'AVRO'").select("schema_id", "content"), "schema_id")


def resolve(catalog: Catalog, key: str) -> T.StructType:
    """Spark schema of the latest document of one subject; one document comes to the driver."""
    found = latest_documents(catalog).where(F.col("subject") == key).select("content").first()
    if found is None:
        raise LookupError(f"no live schema for {key}")
    return document_to_struct(found["content"])


def read_json(text: Column, struct: T.StructType) -> Column:
    """Parse JSON text with a resolved schema."""
    return F.from_json(text, struct)
