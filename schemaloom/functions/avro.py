"""Avro reader/writer rules as column expressions."""

from pyspark.sql import Column, functions as F

# Writer type > reader type promotions of the Avro specification.
PROMOTIONS = [
    "int>long", "int>float", "int>double",
    "long>float", "long>double",
    "float>double",
    "string>bytes", "bytes>string",
]


def readable(reader_type: Column, writer_type: Column) -> Column:
    """Can a value written as ``writer_type`` be read as ``reader_type``."""
    return (reader_type == writer_type) | F.concat(writer_type, F.lit(">"), reader_type).isin(PROMOTIONS)


def full_aliases(name: Column, aliases: Column) -> Column:
    """Aliases of a named type; one without a dot is in the namespace of the type."""
    space = F.regexp_extract(name, r"^(.*\.)[^.]*$", 1)
    given = F.coalesce(aliases, F.array().cast("array<string>"))
    return F.transform(given, lambda a: F.when(a.contains("."), a).otherwise(F.concat(space, a)))
