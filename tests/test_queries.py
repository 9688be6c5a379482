"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR

QUERIES = {n: q for n, q in entry.queries().items() if n.startswith("q_")}
ORACLES = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in found.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in answer.fetchall()), key=repr)
