"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

from spendscope.plans.registry import catalogue

QUERIES = catalogue()
DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ", timespec="microseconds")
    return "null" if value is None else str(value)


def as_set(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.oracle])
def test_same_as_sql(name, spark, folder, duck):
    query = QUERIES[name]
    found = query.build(spark, folder)
    described = {r[0]: r[1] for r in duck.execute("describe " + query.oracle).fetchall()}
    assert dict(found.dtypes) == {c: DUCK_TYPES[t] for c, t in described.items()}
    cursor = duck.execute(query.oracle)
    names = [c[0] for c in cursor.description]
    expected = as_set(cursor.fetchall(), names)
    assert as_set(found.collect(), found.columns) == expected


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.oracle and not n.startswith(("ml_", "cluster", "anomaly", "insight_cluster", "enrich_cluster", "risk_", "suspicious_"))])
def test_gives_rows(name, spark, folder):
    assert QUERIES[name].build(spark, folder).count() > 0


def test_unknown_names_are_not_registered_twice():
    assert len(QUERIES) == len({q.name for q in QUERIES.values()})
