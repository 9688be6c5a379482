"""Column metadata of tables, and the Avro documents made from it."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.types import jdbc_to_avro, struct_to_document

# Standard type names of an information schema and their java.sql.Types codes.
TYPE_NAME_CODES = {
    "INTEGER": 4,
    "BIGINT": -5,
    "FLOAT": 6,
    "DOUBLE": 8,
    "DOUBLE PRECISION": 8,
    "BOOLEAN": 16,
    "BINARY": -2,
}
SPARK_CODES = {"integer": 4, "long": -5, "float": 6, "double": 8, "boolean": 16, "binary": -2}
VARCHAR = 12


def read_jdbc_columns(spark: SparkSession, url: str, catalog: str, tables: list[str], **options: str) -> DataFrame:
    """tbl, ordinal, col, jdbc_type from the information schema of a database, for exactly these tables."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", "information_schema.columns")
    listed = reader.options(**options).load()
    wanted = listed.where((F.col("table_catalog") == catalog) & F.col("table_name").isin(tables))
    return wanted.select(
        F.col("table_name").alias("tbl"),
        F.col("ordinal_position").alias("ordinal"),
        F.col("column_name").alias("col"),
        code_of(F.col("data_type")).alias("jdbc_type"),
    )


def read_table_columns(spark: SparkSession, tables: list[str]) -> DataFrame:
    """tbl, ordinal, col, jdbc_type of tables and views that Spark knows. Schemas are driver metadata."""
    rows = [
        (table, place, field.name, SPARK_CODES.get(field.dataType.typeName(), VARCHAR))
        for table in tables
        for place, field in enumerate(spark.table(table).schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "tbl string, ordinal int, col string, jdbc_type int")


def code_of(type_name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPE_NAME_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(type_name)), F.lit(VARCHAR))


def columns_to_avro(columns: DataFrame) -> DataFrame:
    """One Avro record per table: tbl, content; ``columns`` has tbl, ordinal, col, jdbc_type.

    The text of a column is made before the shuffle; a group holds the columns of one table, and its
    result is one document.
    """
    field = F.concat(
        F.lit('{"name":"'), "col", F.lit('","type":"'), jdbc_to_avro(F.col("jdbc_type")), F.lit('"}')
    )
    listed = columns.select("tbl", F.struct("ordinal", field.alias("text")).alias("f")).groupBy("tbl").agg(
        F.sort_array(F.collect_list("f"))["text"].alias("fields")
    )
    return listed.select(
        "tbl",
        F.concat(
            F.lit('{"type":"record","name":"'), "tbl", F.lit('","fields":['), F.array_join("fields", ","), F.lit("]}")
        ).alias("content"),
    )


def struct_documents(spark: SparkSession, structs: dict) -> DataFrame:
    """Documents of Spark schemas by key: subject, raw. Schemas are driver metadata, not data."""
    rows = [(key, struct_to_document(key, struct)) for key, struct in structs.items()]
    return spark.createDataFrame(rows, "subject string, raw string")
