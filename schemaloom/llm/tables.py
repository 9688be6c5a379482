"""Reading the input tables, and small column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What splits words, for regular expressions of Spark, Python and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(each, schema)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about `limit` bytes each, so that long texts don't add up in memory."""
    array, start, held = batch.column(column), 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(array), 0).to_pylist()
    for at, length in enumerate(lengths):
        if held and held + length > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)
