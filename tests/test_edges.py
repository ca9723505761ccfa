"""Boundary cases on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from spendscope.functions import calendar as cal
from spendscope.functions.money import amount_class
from spendscope.functions.text import tidy
from spendscope.operators import aggregates, cleaning, dedup, features, geography, profiling, segments, timeseries
from spendscope.operators.users import activity, behaviour, model_rows, user_features
from spendscope.sources.ingest import pending_dates


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


HOURS = [0, 5, 6, 7, 11, 12, 13, 17, 18, 19, 23, None]


def test_day_period_is_closed_on_the_left(spark):
    got = column(spark, HOURS, "int", cal.day_period(F.col("v")))
    assert got == ["night"] * 2 + ["morning"] * 3 + ["afternoon"] * 3 + ["evening"] * 3 + ["unknown"]


def test_day_part_is_closed_on_the_right(spark):
    got = column(spark, HOURS, "int", cal.day_part(F.col("v")))
    assert got == ["Night"] * 3 + ["Morning"] * 3 + ["Afternoon"] * 3 + ["Evening"] * 2 + [None]


def test_amount_classes_are_closed_on_the_right(spark):
    amounts = [-1.0, 0.0, 10.0, 10.01, 50.0, 100.0, 500.0, 1000.0, 1000.01, None]
    got = column(spark, amounts, "double", amount_class(F.col("v")))
    assert got == ["very_small"] * 3 + ["small"] * 2 + ["medium", "large", "very_large", "huge", "unknown"]


def test_tidy_strips_all_white_space(spark):
    got = column(spark, ["\t A b\n", " X　", "", None], "string", tidy(F.col("v")))
    assert got == ["a b", "x", "", None]


def test_timestamps_that_do_not_parse_become_null(spark, moments):
    got = column(spark, ["2024-01-01 05:06:07", "soon", "", None], "string", cal.parse_timestamp(F.col("v")))
    assert got == [moments("2024-01-01 05:06:07"), None, None, None]


def test_elapsed_days_are_not_calendar_days(spark, moments):
    frame = spark.createDataFrame(
        [(moments("2024-01-01 23:00:00"), moments("2024-01-03 01:00:00"))], "a timestamp_ntz, b timestamp_ntz"
    )
    row = frame.select(cal.whole_days_between(F.col("a"), F.col("b")), F.date_diff("b", "a")).first()
    assert tuple(row) == (1, 2)


def test_most_frequent_tie_is_alphabetical(spark):
    pairs = [("u", "b"), ("u", "a"), ("v", "z"), ("v", "z"), ("v", "a"), ("w", None), (None, "a")]
    frame = spark.createDataFrame(pairs, "user string, country string")
    got = features.most_frequent(frame, "user", "country", "home").collect()
    assert {(r["user"], r["home"]) for r in got} == {("u", "a"), ("v", "z")}


def test_thirds_are_those_of_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    for n in (4, 10, 61, 301):
        values = np.round(rng.lognormal(3, 1, n), 2)
        frame = spark.createDataFrame(pd.DataFrame({"i": range(n), "v": values}))
        edges = segments.one_row(segments.tertile_edges(frame, ["v"]))
        cut = frame.withColumn("e", edges).select("i", segments.third_of("v", "e.v", ("L", "M", "H")).alias("s"))
        got = cut.toPandas().sort_values("i")["s"].tolist()
        assert got == pd.qcut(pd.Series(values), 3, labels=list("LMH")).tolist()


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([1, 2, 3, 4, 5, 6, 7], list("LLMMHHH")),  # the inner edges lie just below 3 and 5
        ([1, 1, 1, 1, 1, 2, 3], list("LLLLLMH")),
        ([4, 4, 4], list("MMM")),
    ],
)
def test_thirds(spark, values, expected):
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    edges = segments.one_row(segments.tertile_edges(frame, ["v"]))
    got = frame.withColumn("e", edges).orderBy("i").select(segments.third_of("v", "e.v", ("L", "M", "H")))
    found = [r[0] for r in got.collect()]
    assert found == expected


def weeks(spark, values):
    rows = [(i, v, float(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, transaction_count int, transaction_value double")
    start = F.lit("2024-01-07").cast("date")
    return frame.withColumn("week_end", F.date_add(start, F.col("i") * 7))


def test_even_window_reaches_further_back(spark):
    frame = weeks(spark, range(8)).withColumn("m", timeseries.centred_mean("transaction_count", F.lit(4), 12))
    got = [r["m"] for r in frame.orderBy("i").collect()]
    assert got == [None, None, 1.5, 2.5, 3.5, 4.5, 5.5, None]


def test_window_is_a_quarter_of_the_weeks(spark):
    got = timeseries.weekly_trend(weeks(spark, range(3))).collect()
    assert all(r["trend_count"] is None for r in got)  # three weeks give a window of 0
    got = timeseries.weekly_trend(weeks(spark, [1, 2, 4, 8])).orderBy("week_end").collect()
    assert [r["trend_count"] for r in got] == [1.0, 2.0, 4.0, 8.0]


def test_decomposition_needs_two_periods_and_adds_up(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    season = np.sin(np.arange(120) % 52 / 52 * 6.28) * 40
    values = [int(v) for v in 500 + np.arange(120) + season + rng.normal(0, 3, 120)]
    assert timeseries.decompose(weeks(spark, values[:103])).count() == 0
    got = timeseries.decompose(weeks(spark, values)).orderBy("week_end").toPandas()
    assert got["trend"].isna().sum() == 52
    inner = got.dropna()
    np.testing.assert_allclose(inner["observed"], inner["trend"] + inner["seasonal"] + inner["residual"])
    np.testing.assert_allclose(got["seasonal"].iloc[:52].sum(), 0, atol=1e-9)
    kernel = np.r_[0.5, np.ones(51), 0.5] / 52
    np.testing.assert_allclose(inner["trend"], np.convolve(values, kernel, "valid"))


def frame_of(spark, rows):
    return spark.createDataFrame(
        rows,
        "transaction_id string, user_id string, amount double, timestamp timestamp_ntz, location_country string",
    )


def test_single_rows_and_null_keys(spark, moments):
    day = moments("2024-01-06 10:00:00")
    rows = frame_of(
        spark,
        [("1", "u", 5.0, day, "a"), ("2", None, 9.0, day, "a"), ("3", "v", None, None, None), (None, "v", 1.0, day, "b")],
    )
    users = {r["user_id"]: r for r in behaviour(rows).collect()}
    assert set(users) == {"u", "v"}
    assert users["u"]["std_amount"] == 0.0
    assert users["v"]["transaction_count"] == 1 and users["v"]["total_amount"] == 1.0
    assert [r["date"].isoformat() for r in aggregates.daily(rows).collect()] == ["2024-01-06"]
    assert {r["user_id"]: r["active_days"] for r in activity(rows).collect()} == {"u": 1, "v": 1}


def test_sums_of_nothing_are_zero(spark, moments):
    rows = frame_of(spark, [("1", "u", None, moments("2024-01-06 10:00:00"), "a")])
    row = aggregates.daily(rows).first()
    assert (row["transaction_count"], row["transaction_value"], row["avg_transaction_value"]) == (1, 0.0, None)


def test_cross_border_with_nulls(spark):
    rows = frame_of(
        spark,
        [("1", "u", 1.0, None, "a"), ("2", "u", 2.0, None, "a"), ("3", "u", 4.0, None, None), ("4", None, 8.0, None, "a")],
    )
    got = {r["is_cross_border"]: r["transaction_value"] for r in geography.cross_border_figures(rows).collect()}
    assert got == {False: 3.0, True: 12.0}
    per_row = features.add_cross_border(rows).groupBy("is_cross_border").agg(F.sum("amount").alias("v"))
    assert {r["is_cross_border"]: r["v"] for r in per_row.collect()} == got


def test_keep_first_is_idempotent_and_treats_nulls_as_one(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 3, "p"), (None, 1, "q")], "k string, o int, v string"
    )
    once = dedup.keep_first(rows, "k", ["o"])
    assert {(r["k"], r["v"]) for r in once.collect()} == {("a", "x"), ("b", "z"), (None, "q")}
    assert dedup.keep_first(once, "k", ["o"]).count() == once.count() == 3
    counts = dedup.repeat_counts(rows, "k").first()
    assert (counts["total_rows"], counts["duplicate_rows"], counts["duplicate_pct"]) == (5, 2, 40.0)


def test_unseen_looks_only_at_keys_that_return(spark):
    new = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    old = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    assert sorted(str(r["k"]) for r in dedup.unseen(new, old, "k").collect()) == ["None", "b", "b"]


def test_capped_amounts_stay_within_bounds(spark):
    rows = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([*range(100), -900, 900])], "transaction_id string, amount double")
    got = cleaning.flag_outer_amounts(rows).toPandas()
    assert got["is_amount_outlier"].sum() == 2
    inside = got[~got["is_amount_outlier"]]
    assert (inside["amount"] == inside["amount_capped"]).all()
    assert got["amount_capped"].max() < 900 and got["amount_capped"].min() > -900


def test_segment_summary_has_all_27_cells(spark, moments):
    rows = frame_of(
        spark,
        [(f"{u}-{i}", f"u{u}", float(u * 10 + i), moments(f"2024-01-{1 + (u * 3) % 28:02d} 10:00:00"), "a")
         for u in range(9) for i in range(u + 1)],
    )
    summary = segments.segment_summary(segments.segmented(rows)).toPandas()
    assert len(summary) == 27
    assert summary["user_count"].sum() == 9
    assert (summary["user_count"] == 0).any()


def test_user_features_keep_null_deviation_for_the_median(spark, moments, folder):
    from spendscope.sources.fixtures import card_month

    one_each = dedup.keep_first(card_month(spark, folder), "user_id", ["transaction_id"])
    rows = model_rows(one_each)
    assert user_features(rows).where("std_transaction_amount = 0").count() == one_each.count()
    assert user_features(rows, "median").where("std_transaction_amount is null").count() == one_each.count()


def test_samples_are_exact(spark):
    rows = spark.range(5000).selectExpr("cast(id as string) as transaction_id", "cast(id % 50 as string) as user_id")
    assert profiling.sample_rows(rows, 123).count() == 123
    assert profiling.sample_rows(rows, 9999).count() == 5000
    some = profiling.sample_entities(rows, 7)
    assert some.count() == 700 and some.select("user_id").distinct().count() == 7
    assert profiling.sample_entities(rows, 50).count() == 5000


def test_pending_dates(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-04')) as date")
    done = days.where("date < '2024-01-04'")
    checked = days.where("date = '2024-01-01'")
    got = {(str(r["date"]), r["step"]) for r in pending_dates(days, done, checked).collect()}
    assert got == {("2024-01-04", "ingest"), ("2024-01-02", "validate"), ("2024-01-03", "validate")}
