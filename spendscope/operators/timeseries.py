"""Daily and weekly series, calendar patterns, trend and seasonal decomposition.

Everything below the daily grouping works on one row per day or week, so the
windows without partitions in this module see a few thousand rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spendscope.functions import calendar as cal
from spendscope.operators.aggregates import daily
from spendscope.operators.features import add_calendar_names

MEASURES = ("transaction_count", "transaction_value", "avg_transaction_value")


def date_spine(days: DataFrame, column: str = "date") -> DataFrame:
    """Every day from the first to the last of ``column``, both included."""
    ends = days.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")
    )


def daily_series(rows: DataFrame) -> DataFrame:
    """Daily figures without gaps: days without transactions count 0; with calendar columns."""
    per_day = daily(rows)
    filled = date_spine(per_day).join(per_day, "date", "left").fillna(0, list(MEASURES))
    d = F.col("date")
    dated = filled.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "day_of_week": cal.day_of_week(d),
            "is_weekend": cal.is_weekend(d),
        }
    )
    return add_calendar_names(dated, "date")


def _means() -> list[Column]:
    return [F.avg(m).alias(m) for m in MEASURES]


def week_day_pattern(series: DataFrame) -> DataFrame:
    return series.groupBy("day_of_week", "day_name").agg(*_means()).orderBy("day_of_week")


def monthly_pattern(series: DataFrame) -> DataFrame:
    """Per month of a year: sums, mean of the daily means, days and figures per day."""
    return (
        series.groupBy("year", "month", "month_name")
        .agg(
            F.sum("transaction_count").alias("transaction_count"),
            F.sum("transaction_value").alias("transaction_value"),
            F.avg("avg_transaction_value").alias("avg_transaction_value"),
            F.count(F.lit(1)).alias("days"),
        )
        .withColumns(
            {
                "daily_avg_count": F.col("transaction_count") / F.col("days"),
                "daily_avg_value": F.col("transaction_value") / F.col("days"),
                "month_year": F.concat_ws(" ", "month_name", "year"),
            }
        )
        .orderBy("year", "month")
    )


def month_of_year_pattern(series: DataFrame) -> DataFrame:
    return series.groupBy("month", "month_name").agg(*_means()).orderBy("month")


def weekly(series: DataFrame) -> DataFrame:
    """Weeks ending on Sunday: sums of count and value, mean of the daily means."""
    return series.groupBy(cal.week_ending_sunday(F.col("date")).alias("week_end")).agg(
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("transaction_value").alias("transaction_value"),
        F.avg("avg_transaction_value").alias("avg_transaction_value"),
    )


def _in_order() -> WindowSpec:
    return Window.partitionBy().orderBy("week_end")


def _all_weeks() -> WindowSpec:
    return Window.partitionBy()


def centred_mean(value: str, width: Column, widest: int) -> Column:
    """Mean over a centred window of ``width`` rows (at most ``widest``), null unless complete.

    An even window reaches one row further back than ahead.
    """
    ahead = F.floor((width - 1) / 2)
    behind = width - 1 - ahead
    parts = []
    for step in range(-(widest // 2), (widest - 1) // 2 + 1):
        near = F.lag(value, -step) if step < 0 else F.lead(value, step)
        inside = (F.lit(step) >= -behind) & (F.lit(step) <= ahead)
        parts.append(F.when(inside, near.over(_in_order()).cast("double")).otherwise(F.lit(0.0)))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.when(width > 0, F.try_divide(total, width))


def weekly_trend(weeks: DataFrame, widest: int = 12) -> DataFrame:
    """Smoothed count and value; the window is a quarter of the weeks, ``widest`` at most."""
    width = F.least(F.lit(widest), F.floor(F.col("weeks") / 4).cast("int"))
    sized = weeks.withColumn("weeks", F.count(F.lit(1)).over(_all_weeks())).withColumn("width", width)
    return sized.withColumns(
        {
            "trend_count": centred_mean("transaction_count", F.col("width"), widest),
            "trend_value": centred_mean("transaction_value", F.col("width"), widest),
        }
    ).drop("weeks", "width")


def decompose(weeks: DataFrame, value: str = "transaction_count", period: int = 52) -> DataFrame:
    """Classical additive decomposition by moving averages; empty below two periods.

    The trend of an even period averages ``period + 1`` rows of which the two outer
    ones count half. The seasonal part is the mean detrended value of each phase,
    moved so that the phases average to 0.
    """
    if period % 2:
        raise ValueError("the period must be even")
    half = period // 2
    x = F.col("observed")
    around = _in_order().rowsBetween(-half, half)
    phase = Window.partitionBy("phase")

    indexed = weeks.select(
        "week_end",
        F.col(value).cast("double").alias("observed"),
        (F.row_number().over(_in_order()) - 1).alias("week_index"),
        F.count(F.lit(1)).over(_all_weeks()).alias("weeks"),
    ).where(F.col("weeks") >= 2 * period)
    first, last = F.lag(x, half).over(_in_order()), F.lead(x, half).over(_in_order())
    trended = indexed.withColumn("phase", F.col("week_index") % period).withColumn(
        "trend", (F.sum(x).over(around) - (first + last) / 2) / period
    )
    phased = trended.withColumn("phase_mean", F.avg(x - F.col("trend")).over(phase)).withColumn(
        "phase_rows", F.count(F.lit(1)).over(phase)
    )
    grand = F.sum(F.col("phase_mean") / F.col("phase_rows")).over(_all_weeks()) / period
    return (
        phased.withColumn("seasonal", F.col("phase_mean") - grand)
        .withColumn("residual", x - F.col("trend") - F.col("seasonal"))
        .select("week_end", "observed", "trend", "seasonal", "residual")
    )
