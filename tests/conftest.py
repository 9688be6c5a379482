import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from schemaloom.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark
labels conversations""".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", partitions=4, app="tests")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def same_rows(a, b):
    """Two DataFrames hold the same rows, however ordered."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left = sorted((repr(tuple(r)) for r in a.select(*columns).collect()))
    right = sorted((repr(tuple(r)) for r in b.select(*columns).collect()))
    assert left == right
