"""Slotted computations equal plain ones, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(n * 3, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.choice([None, 1, 2, 5])) for n in range(400)]
    return data, spark.createDataFrame(data, "seq bigint, key string, v int")


@pytest.mark.parametrize("span", [1, 10, 64, 1 << 20])
@pytest.mark.parametrize("keys", [["key"], []])
def test_against_loop(rows, span, keys):
    data, df = rows
    numbered = ordered.number_rows(df, keys, "seq", "n", span)
    summed = ordered.running_sums(numbered, keys, "seq", {"s": F.coalesce("v", F.lit(0))}, span)
    known = ordered.last_before(summed, keys, "seq", F.col("v"), F.col("v") > 1, "last", span)
    got = {r["seq"]: (r["n"], r["s"], r["last"]) for r in known.collect()}
    state, want = {}, {}
    for seq, key, v in data:
        place = key if keys else None
        n, s, last = state.get(place, (0, 0, None))
        want[seq] = (n + 1, s, last)
        state[place] = (n + 1, s + (v or 0), v if v is not None and v > 1 else last)
    assert got == want


@pytest.mark.parametrize("keys", [["key"], []])
def test_sparse_order(spark, keys):
    """64-bit time stamps, far apart."""
    stamps = sorted(random.Random(3).sample(range(1 << 62), 300))
    df = spark.createDataFrame([(s, "a" if i % 3 else "b") for i, s in enumerate(stamps)], "seq bigint, key string")
    got = {r["seq"]: r["n"] for r in ordered.number_rows(df, keys, "seq", "n").collect()}
    count = {}
    for i, s in enumerate(stamps):
        place = ("a" if i % 3 else "b") if keys else None
        count[place] = count.get(place, 0) + 1
        assert got[s] == count[place]


def test_order_without_keys_is_dealt_out(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"))
    slots = ordered._slotted(df, [], "seq", ordered.SPAN).groupBy("_slot").count().collect()
    assert len(slots) > 1 and max(r["count"] for r in slots) < 600
