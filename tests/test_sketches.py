"""Sketches against exact figures, and merged ones against sketches of the whole."""

import pytest
from pyspark.sql import functions as F

from spendscope.operators import sketches
from spendscope.session import fresh_path
from spendscope.streaming import increments
from test_files import deliver, line


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(60_000, numPartitions=6).select(
        F.concat(F.lit("day"), i % 7).alias("day"),
        F.when(i % 10 == 0, None).otherwise(F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(20_000)))).alias("user"),
        F.exp(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(10_000)) / 1000).alias("amount"),
        F.lit(None).cast("string").alias("void"),
    )


def facts(said):
    return {r["column_name"]: r for r in said.collect()}


def test_days_add_up_to_the_whole(rows):
    per_day = sketches.profile_sketches(rows, ["user", "void"], ["amount"], ["day"])
    twice = sketches.merged(sketches.merged(per_day, ["day"]))
    found = facts(sketches.read_profile(twice))
    exact = rows.agg(
        F.count_distinct("user").alias("users"), F.count("user").alias("n"), F.min("amount").alias("low"),
        F.max("amount").alias("high"), F.avg("amount").alias("mean"), F.count_distinct("amount").alias("amounts"),
    ).first()
    assert abs(found["user"]["distinct_values"] - exact["users"]) <= 0.03 * exact["users"]
    assert abs(found["amount"]["distinct_values"] - exact["amounts"]) <= 0.03 * exact["amounts"]
    assert (found["user"]["count"], found["user"]["n"], found["user"]["q50"]) == (exact["n"], 60_000, None)
    a = found["amount"]
    assert (a["min_value"], a["max_value"]) == (exact["low"], exact["high"])
    assert abs(a["mean_value"] - exact["mean"]) < 1e-9 * exact["mean"]
    for name, p in sketches.QUANTILES.items():
        share = rows.where(F.col("amount") <= a[name]).count() / 60_000
        assert abs(share - p) <= 0.01
    assert (found["void"]["distinct_values"], found["void"]["count"], found["void"]["missing_pct"]) == (0, 0, 100.0)


def test_no_rows(rows):
    found = facts(sketches.read_profile(sketches.merged(sketches.profile_sketches(rows.limit(0), ["user"], ["amount"]))))
    assert found["amount"]["n"] == 0 and found["amount"]["q50"] is None and found["user"]["missing_pct"] is None
    assert sketches.profile_sketches(rows.limit(0), ["user"], ["amount"], ["day"]).count() == 0


def test_distinct_counts_by_group(rows):
    kept = sketches.distinct_over(rows, "user", ["day"])
    (whole,) = sketches.distinct_in(kept).collect()
    exact = rows.select("user").where("user is not null").distinct().count()
    assert abs(whole["distinct_values"] - exact) <= 0.03 * exact
    assert sketches.distinct_in(kept, ["day"]).count() == 7


def test_profiles_of_many_batches(spark, tmp_path):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    for k in range(12):
        deliver(root, k, [line(k, f"{k}.00"), line(100 + k, "no number")])
    stream = increments.incoming(spark, str(root), files_per_batch=1)
    for _ in range(2):
        increments.maintain_profile(stream, out, progress, ["transaction_id"], ["amount"])
        found = facts(sketches.read_profile(increments.latest_profile(spark, out)))
        assert (found["transaction_id"]["n"], found["transaction_id"]["distinct_values"]) == (24, 24)
        assert (found["amount"]["count"], found["amount"]["max_value"], found["amount"]["q50"]) == (12, 11.0, 5.0)
