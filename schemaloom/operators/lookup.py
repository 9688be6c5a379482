"""Lookups: each takes a DataFrame of requests and keeps every request row, misses included."""

from pyspark.sql import DataFrame, functions as F

from ..functions.versions import is_latest, version_number
from .registration import latest_version, live

NOT_FOUND = 404


def schema_by_id(requests: DataFrame, schemas: DataFrame) -> DataFrame:
    return requests.join(schemas.select("schema_id", "content"), "schema_id", "left").withColumn(
        "error_code", F.when(F.col("content").isNull(), F.lit(NOT_FOUND))
    )


def schema_by_hash(requests: DataFrame, schemas: DataFrame) -> DataFrame:
    """``requests`` carry the hash of their canonical text."""
    return requests.join(schemas.select("hash", "schema_id"), "hash", "left")


def find_in_subject(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """First live position in the subject whose schema matches."""
    places = live(versions).groupBy("subject", "schema_id").agg(F.min("version").alias("version"))
    return requests.join(places, ["subject", "schema_id"], "left")


def subject_schemas(versions: DataFrame, schemas: DataFrame) -> DataFrame:
    return live(versions).join(schemas.select("schema_id", "content"), "schema_id").select(
        "subject", "version", "schema_id", "content"
    )


def resolve_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Turn version tokens into (version, schema_id); both null when there is no such live version.

    ``latest`` is replaced by a number first, so that both kinds of token share one equi-join.
    """
    newest = latest_version(versions).select("subject", F.col("version").alias("_newest"))
    numbered = requests.join(newest, "subject", "left").withColumn(
        "_wanted", F.when(is_latest(F.col("token")), F.col("_newest")).otherwise(version_number(F.col("token")))
    )
    places = live(versions).select("subject", F.col("version").alias("_wanted"), "version", "schema_id")
    return numbered.join(places, ["subject", "_wanted"], "left").select(*requests.columns, "version", "schema_id")


def schema_at_version(requests: DataFrame, versions: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds version, schema_id, content, and client_id: the schema id, -1 for a miss."""
    found = resolve_versions(requests, versions)
    return found.join(schemas.select("schema_id", "content"), "schema_id", "left").withColumn(
        "client_id", F.coalesce("schema_id", F.lit(-1))
    )


def list_versions(subjects: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per live version; a subject without any gives one row with error_code 404."""
    return (
        subjects.select("subject")
        .join(live(versions).select("subject", "version"), "subject", "left")
        .withColumn("error_code", F.when(F.col("version").isNull(), F.lit(NOT_FOUND)))
    )
