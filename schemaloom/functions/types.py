"""Type mapping between JDBC codes, Avro types and Spark types."""

import json

from pyspark.sql import Column, functions as F, types as T

# Java.sql.Types codes and the Avro type each becomes; all other codes become string.
JDBC_TO_AVRO = {
    4: "int",  # INTEGER
    -5: "long",  # BIGINT
    6: "float",  # FLOAT
    8: "double",  # DOUBLE
    16: "boolean",  # BOOLEAN
    -2: "bytes",  # BINARY
}
OTHER = "string"

# Spark types with an Avro primitive; types in neither direction's list become string.
SPARK_TO_AVRO = {
    "integer": "int",
    "long": "long",
    "float": "float",
    "double": "double",
    "boolean": "boolean",
    "binary": "bytes",
    "string": "string",
    "byte": "int",
    "short": "int",
    "void": "null",
}
AVRO_TO_SPARK = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "bytes": T.BinaryType(),
    "string": T.StringType(),
    "null": T.NullType(),
}


def jdbc_to_avro(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in JDBC_TO_AVRO.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.lit(OTHER))


def _optional(avro, nullable: bool):
    return ["null", avro] if nullable else avro


def spark_to_avro(data_type: T.DataType, name: str = "record"):
    """Avro schema as JSON value; structs become records named after their place."""
    if isinstance(data_type, T.StructType):
        fields = [
            {"name": f.name, "type": _optional(spark_to_avro(f.dataType, f"{name}_{f.name}"), f.nullable)}
            for f in data_type.fields
        ]
        return {"type": "record", "name": name, "fields": fields}
    if isinstance(data_type, T.ArrayType):
        return {"type": "array", "items": _optional(spark_to_avro(data_type.elementType, name), data_type.containsNull)}
    if isinstance(data_type, T.MapType):
        return {"type": "map", "values": _optional(spark_to_avro(data_type.valueType, name), data_type.valueContainsNull)}
    return SPARK_TO_AVRO.get(data_type.typeName(), OTHER)


def avro_to_spark(avro) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of an Avro JSON value."""
    if isinstance(avro, list):
        rest = [t for t in avro if t != "null"]
        if len(rest) == 1:
            return avro_to_spark(rest[0])[0], len(rest) < len(avro)
        return T.StringType(), "null" in avro
    if isinstance(avro, dict):
        kind = avro["type"]
        if kind == "record":
            return T.StructType([T.StructField(f["name"], *avro_to_spark(f["type"])) for f in avro["fields"]]), False
        if kind == "array":
            return T.ArrayType(*avro_to_spark(avro["items"])), False
        if kind == "map":
            return T.MapType(T.StringType(), *avro_to_spark(avro["values"])), False
        return avro_to_spark(kind)
    return AVRO_TO_SPARK.get(avro, T.StringType()), False


def struct_to_document(key: str, struct: T.StructType) -> str:
    """Avro record text of a Spark schema, named after its key."""
    return json.dumps(spark_to_avro(struct, key), separators=(",", ":"), ensure_ascii=False)


def document_to_struct(content: str) -> T.StructType:
    """Spark schema of an Avro record text."""
    return avro_to_spark(json.loads(content))[0]
