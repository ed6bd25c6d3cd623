"""Every query against its SQL, on whole tables."""

import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


_SPARK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = queries()[name](spark, SF)
    theirs = duck.sql(oracle_sql()[name])
    types = dict(zip(theirs.columns, [str(t) for t in theirs.types]))
    assert {c: _SPARK_TYPES.get(t, t) for c, t in types.items()} == dict(ours.dtypes)
    left, right = _rows(ours.columns, ours.collect()), _rows(theirs.columns, theirs.fetchall())
    assert len(right) > 0
    assert len(left) == len(right)
    assert left == right


def test_each_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
