"""Every text query with SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from spendscope.llm import mixing
from spendscope.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(name, spark, folder):
    duck = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    found = QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    cursor = duck.execute(f"select {', '.join(columns)} from ({ORACLES[name]})")
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_all_are_there():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_mix_of_tiny_sources_beside_a_huge_one(spark):
    """Tiny sources get the turns that they lack, and the SQL says the same."""
    rows = [(k, " ".join(f"w{i}" for i in range(40 + k % 7)), "huge") for k in range(3000)]
    rows += [(10_000 + k, " ".join("abc"[i % 3] for i in range(n)), f"tiny{k}") for k, n in enumerate((10, 33, 65, 100, 200, 1, 0))]
    rows += [(20_000, None, None), (20_001, "only this", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs)
    duck = duckdb.connect()
    duck.register("given", docs.toPandas())
    duck.execute("create view documents as select * from given")
    columns = sorted(found.columns)
    wanted = duck.execute(f"select {', '.join(columns)} from ({ORACLES['op2_mixing']})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, wanted))
    taken = {r["source"]: r["n"] for r in found.groupBy("source").agg({"taken": "sum"}).toDF("source", "n").collect()}
    assert taken["tiny0"] == 30 and taken["tiny3"] == 300 and taken["tiny6"] == 0 and taken[None] == 6
