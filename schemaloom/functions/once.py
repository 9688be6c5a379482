"""Evaluate a costly expression once per row."""

from pyspark.sql import Column, DataFrame, functions as F


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections reuse instead of evaluating it again.

    The optimizer copies an expression into every place that uses it. A one-element explode keeps
    it in one place.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
