import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spendscope.operators.quantiles import (
    iqr_fences,
    linear_cells,
    one_row,
    order_statistics,
    quantiles,
    smallest,
)

PROBS = {"a": 0.0, "b": 0.1, "c": 1 / 3, "d": 0.5, "e": 0.95, "f": 1.0}


def check(spark, values, **options):
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    got = quantiles(frame, "v", PROBS, **options).first()
    # By percent, as the operator does; one rounding step of the range is allowed where values cancel.
    expected = np.percentile(np.array(values, dtype=float), [100 * p for p in PROBS.values()])
    spread = 1e-12 * max(map(abs, map(float, values)))
    np.testing.assert_allclose([got[k] for k in PROBS], expected, rtol=1e-12, atol=spread)


@pytest.mark.parametrize(
    "values",
    [
        list(np.random.default_rng(1).lognormal(3, 2, 3000)),
        list(np.random.default_rng(2).normal(0, 50, 3000)),
        [7.0] * 1000 + list(range(2000)),  # a third of the rows share one value
        [5.0],
        [-3.0, -3.0, 0.0, 0.0, 1e-300, 1e300, -1e300],
        list(1_000_000 + np.random.default_rng(3).random(500)),
    ],
)
def test_matches_numpy(spark, values):
    check(spark, values)


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=40))
def test_any_values(spark, values):
    check(spark, values)


def test_linear_cells(spark):
    check(spark, list(np.random.default_rng(4).random(2000) * 100), cells=linear_cells(0.0, 100.0))


def test_nulls_and_nans_are_left_out_and_empty_gives_nulls(spark):
    frame = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert quantiles(frame, "v", {"m": 0.5}).first()["m"] == 2.0
    assert quantiles(frame.where("v > 10 and not isnan(v)"), "v", {"m": 0.5}).collect()[0]["m"] is None


def test_groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", "z"], 3000, p=[0.8, 0.15, 0.05]), "v": rng.normal(0, 9, 3000)})
    frame = spark.createDataFrame(pdf)
    for few in (True, False):
        got = quantiles(frame, "v", {"q": 0.25, "r": 0.9}, ["g"], few_groups=few).toPandas().set_index("g")
        expected = pdf.groupby("g")["v"].quantile([0.25, 0.9]).unstack()
        np.testing.assert_allclose(got.loc[expected.index, ["q", "r"]], expected, rtol=1e-12)


def test_weights_stand_for_repeated_rows(spark):
    frame = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 4)], "v double, w int")
    got = quantiles(frame, "v", {"m": 0.5, "t": 0.95}, weight="w").first()
    np.testing.assert_allclose(list(got), np.quantile([1.0] * 5 + [2.0] + [9.0] * 4, [0.5, 0.95]))


def test_fences(spark):
    frame = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    row = frame.limit(1).select(one_row(iqr_fences(frame, "v")).alias("f")).first()["f"]
    assert (row["q1"], row["q3"], row["low"], row["high"]) == (25.0, 75.0, -50.0, 150.0)


def test_rank_statistics_and_smallest(spark):
    frame = spark.createDataFrame([(v % 10, v) for v in range(1000)], "h int, v int")
    row = order_statistics(frame, "h", ["0", "99", "100", "group_rows - 1"]).first()
    assert [row[f"found_{i}"] for i in range(4)] == [0, 0, 1, 9]
    picked = smallest(frame, "h", 150, "v").collect()
    assert len(picked) == 150
    assert sorted(r["v"] for r in picked) == sorted([v for v in range(0, 1000, 10)] + list(range(1, 500, 10)))
    assert smallest(frame, "h", 5000, "v").count() == 1000


@pytest.mark.parametrize("cells", [None, linear_cells(0.0, 1e10)])
def test_values_that_lie_close_are_split_further(spark, cells, monkeypatch):
    """Epoch-like values share a few cells of the first grid; no task may have to sort them all."""
    rng = np.random.default_rng(9)
    values = 1_700_000_000 + np.sort(rng.random(200_000)) * 40_000
    frame = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(6)
    options = {"cells": cells} if cells else {}
    got = quantiles(frame, "v", PROBS, **options).first()
    expected = np.percentile(values, [100 * p for p in PROBS.values()])
    np.testing.assert_allclose([got[k] for k in PROBS], expected, rtol=0, atol=1e-6)
    found = []
    plain = type(frame).selectExpr

    def watched(self, *exprs):
        if any("as _upto" in e for e in exprs):
            found.append(self.groupBy("_cell").count().agg({"count": "max"}).first()[0])
        return plain(self, *exprs)

    monkeypatch.setattr(type(frame), "selectExpr", watched)
    quantiles(frame, "v", PROBS, **options).collect()
    assert 1 <= max(found) <= 64
