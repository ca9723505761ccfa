"""Derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.functions import calendar as cal
from spendscope.functions.money import amount_class
from spendscope.operators.hotkeys import ROWS, attach_by_key
from spendscope.operators.quantiles import one_row, quantiles
from spendscope.session import settle

HIGH_VALUE = 1000.0


def add_calendar(rows: DataFrame, moment: str = "timestamp") -> DataFrame:
    t = F.col(moment)
    return rows.withColumns(
        {
            "date": F.to_date(t),
            "year": F.year(t),
            "month": F.month(t),
            "day": F.dayofmonth(t),
            "hour": F.hour(t),
            "day_of_week": cal.day_of_week(t),
            "is_weekend": cal.is_weekend(t),
        }
    )


def add_calendar_names(rows: DataFrame, moment: str = "timestamp") -> DataFrame:
    t = F.col(moment)
    return rows.withColumns(
        {
            "day_name": cal.day_name(t),
            "month_name": cal.month_name(F.month(t)),
            "quarter": F.quarter(t),
        }
    )


def add_day_period(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time_period", cal.day_period(F.hour("timestamp")))


def add_day_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time_of_day", cal.day_part(F.hour("timestamp")))


def add_age(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Calendar days from the transaction to ``as_of`` (today by default)."""
    today = F.current_date() if as_of is None else as_of
    return rows.withColumn("days_since_transaction", F.date_diff(today, F.to_date("timestamp")))


def add_high_value(rows: DataFrame, threshold: float = HIGH_VALUE) -> DataFrame:
    large = F.col("amount") > threshold
    return rows.withColumns({"high_value": large, "high_value_online": large & F.col("is_online")})


def add_relative_high_value(rows: DataFrame, p: float = 0.95) -> DataFrame:
    """``high_value``: above the exact ``p`` quantile of all amounts; the quantile is settled, so it is found once."""
    threshold = one_row(settle(quantiles(rows, "amount", {"edge": p}), "edge"))["edge"]
    return rows.withColumn("high_value", F.col("amount") > threshold)


def add_amount_class(rows: DataFrame, missing: str | None = "unknown") -> DataFrame:
    return rows.withColumn("amount_category", amount_class(F.col("amount"), missing))


def most_frequent(rows: DataFrame, owner: str, value: str, name: str) -> DataFrame:
    """Most frequent non-null ``value`` per owner, the alphabetically first among equals.

    Counting per pair comes first, so the ranking sees one row per distinct pair.
    """
    pairs = (
        rows.where(F.col(owner).isNotNull() & F.col(value).isNotNull())
        .groupBy(owner, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = Window.partitionBy(owner).orderBy(F.desc("_n"), F.asc(value))
    return (
        pairs.withColumn("_nth", F.row_number().over(best))
        .where(F.col("_nth") == 1)
        .select(owner, F.col(value).alias(name))
    )


def home_countries(rows: DataFrame) -> DataFrame:
    return most_frequent(rows, "user_id", "location_country", "home_country")


def user_cells(rows: DataFrame) -> DataFrame:
    """Per user and country, nulls included: rows and ids, and count, sum, mean and squared deviations of the amounts.

    All of it adds up, so one pass gives what is asked about users, countries and the whole.
    """
    a = F.col("amount")
    return rows.groupBy("user_id", "location_country").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("transaction_id").alias("ids"),
        F.count(a).alias("amounts"),
        F.sum(a).alias("amount"),
        F.avg(a).alias("mean"),
        (F.var_pop(a) * F.count(a)).alias("m2"),
    )


def user_homes(cells: DataFrame) -> DataFrame:
    """Per user: most frequent country, the alphabetically first among equals, number of rows, ids and total."""
    most = "min_by(location_country, struct(-n, location_country)) filter (where location_country is not null)"
    return cells.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.sum("n").alias(ROWS),
        F.expr(most).alias("home_country"),
        F.sum("ids").alias("transaction_count"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"),
    )


def _counted_homes(rows: DataFrame) -> DataFrame:
    cells = rows.groupBy("user_id", "location_country").agg(F.count(F.lit(1)).alias("n"))
    empty = {"ids": F.lit(0), "amount": F.lit(None).cast("double")}
    return user_homes(cells.withColumns(empty)).select("user_id", ROWS, "home_country")


def add_unusual_location(rows: DataFrame) -> DataFrame:
    """Country differs from the user's most frequent one (``unknown`` without a user)."""
    usual = attach_by_key(rows, _counted_homes(rows), "user_id")
    same = F.col("location_country").eqNullSafe(F.coalesce("home_country", F.lit("unknown")))
    return usual.withColumn("unusual_location", ~same).drop("home_country")


def add_cross_border(rows: DataFrame) -> DataFrame:
    """Home country of the user and whether the transaction is outside it."""
    usual = attach_by_key(rows, _counted_homes(rows), "user_id")
    same = F.col("location_country").eqNullSafe(F.col("home_country"))
    return usual.withColumn("is_cross_border", ~same)


def ingest_features(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The derived columns of the processed table."""
    t = F.col("timestamp")
    dated = rows.withColumns(
        {
            "day_of_week": cal.day_of_week(t),
            "is_weekend": cal.is_weekend(t),
            "hour": F.hour(t),
            "time_period": cal.day_period(F.hour(t)),
        }
    )
    flagged = dated.withColumn(
        "high_value_online", (F.col("amount") > HIGH_VALUE) & F.col("is_online")
    )
    return add_age(flagged, as_of)


def analysis_features(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The derived columns of the analysis table."""
    dated = add_age(add_day_period(add_calendar(rows)), as_of)
    flagged = dated.withColumn(
        "high_value_online", (F.col("amount") > HIGH_VALUE) & F.col("is_online")
    )
    return add_unusual_location(add_amount_class(add_relative_high_value(flagged)))
