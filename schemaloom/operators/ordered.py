"""Ordered computations whose groups stay bounded however hot a key is.

A plain window over one subject puts all rows of that subject into one task. Here the rows are cut into
slots, so that a window over (keys, slot) is bounded. One aggregate row per (keys, slot) is then enough
to carry the running value from slot to slot, and is joined back on (keys, slot).

With keys, a slot is ``span`` values of the order column (an integer that is unique within the keys).
Without keys the rows are dealt out by ranges of the order column and a slot is one range, so that there
are as many slots as partitions, however sparse the values are. The ranges are stored once: a range
must mean the same rows to all that read it.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_plain

SPAN = 1 << 20

_SLOT = "_slot"


def _slotted(df: DataFrame, keys: list[str], order: str, span: int) -> DataFrame:
    if keys:
        return df.withColumn(_SLOT, F.expr(f"`{order}` div {int(span)}L"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_plain(df.repartitionByRange(n, order).withColumn(_SLOT, F.spark_partition_id().cast("bigint")))


def slot_keys(keys: list[str], order: str, span: int) -> list:
    """Partitioning of a window that never leaves a slot."""
    return [*keys, F.expr(f"`{order}` div {int(span)}L")]


def _earlier_slots(keys):
    # without keys: one row per range
    return W.partitionBy(*(keys or [F.lit(0)])).orderBy(_SLOT).rowsBetween(W.unboundedPreceding, -1)


def _earlier_rows(keys, order):
    return W.partitionBy(*keys, _SLOT).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], span: int = SPAN) -> DataFrame:
    """Add, per name in ``sums``, the sum of the expression over the earlier rows of the same keys."""
    rows = _slotted(df, keys, order, span)
    inside = rows.select(
        "*", *[F.coalesce(F.sum(e).over(_earlier_rows(keys, order)), F.lit(0)).alias(f"_in_{n}") for n, e in sums.items()]
    )
    totals = rows.groupBy(*keys, _SLOT).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    carried = totals.select(
        *keys, _SLOT, *[F.sum(f"_t_{n}").over(_earlier_slots(keys)).alias(f"_c_{n}") for n in sums]
    ).where(F.greatest(*[F.col(f"_c_{n}").isNotNull() for n in sums], F.lit(False)))
    joined = inside.join(carried, [*keys, _SLOT], "left")
    return joined.select(
        *df.columns, *[(F.col(f"_in_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums]
    )


def number_rows(df: DataFrame, keys: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """1-based position of each row within its keys, by ``order``."""
    counted = running_sums(df, keys, order, {out: F.lit(1)}, span)
    return counted.withColumn(out, (F.col(out) + 1).cast("int"))


def last_before(
    df: DataFrame, keys: list[str], order: str, value: Column, when: Column, out: str, span: int = SPAN
) -> DataFrame:
    """Add the value of the latest earlier row of the same keys that satisfies ``when`` (null if none)."""
    found = F.when(when, F.struct(value.alias("v")))
    rows = _slotted(df, keys, order, span)
    inside = rows.select("*", F.last(found, ignorenulls=True).over(_earlier_rows(keys, order)).alias("_in"))
    # a slot without such a row has a null end, which the next slots look past
    ends = rows.groupBy(*keys, _SLOT).agg(
        F.max_by(F.struct(value.alias("v")), F.when(when, F.col(order))).alias("_end")
    )
    carried = ends.select(
        *keys, _SLOT, F.last("_end", ignorenulls=True).over(_earlier_slots(keys)).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    joined = inside.join(carried, [*keys, _SLOT], "left")
    return joined.select(*df.columns, F.coalesce("_in", "_carried")["v"].alias(out))
