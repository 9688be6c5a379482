"""Response bodies as JSON text."""

from pyspark.sql import Column, functions as F


def terse(content: Column) -> Column:
    return F.to_json(F.struct(content.alias("schema")))


def verbose(content: Column, schema_id: Column, subject: Column, version: Column) -> Column:
    return F.to_json(
        F.struct(content.alias("schema"), schema_id.alias("id"), subject.alias("subject"), version.alias("version"))
    )


def registered(schema_id: Column) -> Column:
    return F.to_json(F.struct(schema_id.alias("id")))


def report(is_compatible: Column) -> Column:
    return F.to_json(F.struct(is_compatible.alias("is_compatible")))


def level_shown(level: Column) -> Column:
    return F.to_json(F.struct(level.alias("compatibilityLevel")))


def level_set(level: Column) -> Column:
    return F.to_json(F.struct(level.alias("compatibility")))


def error(code: Column, message: Column) -> Column:
    return F.to_json(F.struct(code.alias("error_code"), message.alias("message")))


def or_not_found(found: Column, body: Column) -> Column:
    """``body`` where found, else the 404 body."""
    return F.when(found, body).otherwise(error(F.lit(404), F.lit("Not Found")))
