"""Schema documents and request bodies."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, raw."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))


def read_envelopes(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Replace the JSON body by its parts: schema, compatibility."""
    parsed = F.from_json(F.col(column), "schema STRING, compatibility STRING")
    rest = [c for c in bodies.columns if c != column]
    return bodies.select(*rest, parsed.alias("_e")).select(*rest, "_e.schema", "_e.compatibility")
