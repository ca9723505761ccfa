import random

import pytest
from pyspark.sql import functions as F

from spendscope.operators.hotkeys import attach_by_key


@pytest.fixture
def tables(spark):
    rng = random.Random(3)
    keys = ["hot"] * 700 + [None] * 300 + [f"k{rng.randrange(400)}" for _ in range(1000)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, key string")
    facts = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(0, 400, 2)], "key string, fact double")
    return rows, facts


def same(left, right):
    def as_rows(df):
        return sorted(map(tuple, df.select("id", "key", "fact").collect()), key=str)

    assert as_rows(left) == as_rows(right)


@pytest.mark.parametrize("share", [2, 100, 100_000])
def test_equals_plain_left_join(tables, share):
    rows, facts = tables
    same(attach_by_key(rows, facts, "key", hot_share=share), rows.join(facts, "key", "left"))


def test_hot_rows_are_spread(spark, tables):
    """No task gets more than a tenth of the rows, though one key has a third of them and a sixth has none."""
    rows, facts = tables
    for name, value in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.enabled", "false"), ("shuffle.partitions", "16")):
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        joined = attach_by_key(rows.repartition(16), facts, "key", hot_share=100)
        load = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for name, value in (("autoBroadcastJoinThreshold", "10MB"), ("adaptive.enabled", "true"), ("shuffle.partitions", "4")):
            spark.conf.set(f"spark.sql.{name}", value)
    assert sum(r["count"] for r in load) == 2000
    assert max(r["count"] for r in load) < 200


def test_a_hot_key_without_facts_keeps_its_rows(tables):
    rows, facts = tables
    rest = facts.where("key != 'hot'")
    same(attach_by_key(rows, rest, "key", hot_share=100), rows.join(rest, "key", "left"))
