"""Grouped figures: count, sum and mean per key, rankings and frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.functions import calendar as cal
from spendscope.functions.money import total
from spendscope.operators.lookups import top_values
from spendscope.operators.quantiles import quantiles


def figures() -> list[Column]:
    """Count of ids, sum and mean of amounts."""
    return [
        F.count("transaction_id").alias("transaction_count"),
        total(F.col("amount")).alias("transaction_value"),
        F.avg("amount").alias("avg_transaction_value"),
    ]


def keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with all keys present: null keys form no group."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def figures_by(rows: DataFrame, *keys: str) -> DataFrame:
    return keyed(rows, *keys).groupBy(*keys).agg(*figures())


def with_date(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", F.to_date("timestamp"))


def daily(rows: DataFrame) -> DataFrame:
    return figures_by(with_date(rows), "date")


def daily_recent(rows: DataFrame, days: int = 180) -> DataFrame:
    """Row count and sum per day for the most recent ``days`` days that have any."""
    per_day = (
        keyed(with_date(rows), "date")
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("row_count"), total(F.col("amount")).alias("total_amount"))
    )
    return per_day.orderBy(F.desc("date")).limit(days)


def hourly(rows: DataFrame) -> DataFrame:
    return figures_by(rows.withColumn("hour", F.hour("timestamp")), "hour")


def peak_hour(rows: DataFrame) -> DataFrame:
    """The hour with most transactions, the earliest among equals."""
    return (
        hourly(rows)
        .orderBy(F.desc("transaction_count"), "hour")
        .limit(1)
        .select("hour", "transaction_count")
    )


def top_merchants_by_count(rows: DataFrame, k: int = 10) -> DataFrame:
    counted = keyed(rows, "merchant_name").groupBy("merchant_name")
    return (
        counted.agg(F.count(F.lit(1)).alias("transaction_count"))
        .orderBy(F.desc("transaction_count"), "merchant_name")
        .limit(k)
    )


def top_merchants_by_value(rows: DataFrame, k: int = 10) -> DataFrame:
    summed = keyed(rows, "merchant_name").groupBy("merchant_name")
    return (
        summed.agg(total(F.col("amount")).alias("total_value"))
        .orderBy(F.desc("total_value"), "merchant_name")
        .limit(k)
    )


def top_categories(rows: DataFrame, k: int = 10) -> DataFrame:
    per_category = figures_by(rows, "merchant_category")
    return per_category.orderBy(F.desc("transaction_count"), "merchant_category").limit(k)


def with_shares(groups: DataFrame) -> DataFrame:
    """Share of count and value over all groups; for frames of a few groups."""
    everything = Window.partitionBy()
    return groups.withColumns(
        {
            "count_share_pct": F.try_divide(
                F.col("transaction_count") * F.lit(100.0), F.sum("transaction_count").over(everything)
            ),
            "value_share_pct": F.try_divide(
                F.col("transaction_value") * F.lit(100.0), F.sum("transaction_value").over(everything)
            ),
        }
    )


def by_channel(rows: DataFrame) -> DataFrame:
    """Online against offline."""
    label = F.when(F.col("is_online"), "Online").otherwise("Offline")
    return with_shares(figures_by(rows, "is_online").withColumn("transaction_type", label))


def category_frequency(rows: DataFrame) -> DataFrame:
    """Row count and mean amount per category, most frequent first."""
    per_category = (
        keyed(rows, "merchant_category")
        .groupBy("merchant_category")
        .agg(F.count(F.lit(1)).alias("row_count"), F.avg("amount").alias("avg_amount"))
    )
    return per_category.orderBy(F.desc("row_count"), "merchant_category")


def _week_days(rows: DataFrame) -> DataFrame:
    """Seven rows: day number and name."""
    days = F.posexplode(F.array(*map(F.lit, cal.DAY_NAMES))).alias("day_of_week", "day_name")
    return rows.sparkSession.range(1).select(days)


def frequency_by_day_and_hour(rows: DataFrame) -> DataFrame:
    """Row counts per week day (all seven, null when there is none) and per hour, in long form."""
    stamped = keyed(rows, "timestamp").select(
        cal.day_of_week(F.col("timestamp")).alias("day_of_week"), F.hour("timestamp").alias("hour")
    )
    cells = stamped.groupBy("day_of_week", "hour").agg(F.count(F.lit(1)).alias("n"))
    per_day = cells.groupBy("day_of_week").agg(F.sum("n").alias("row_count"))
    days = (
        _week_days(rows)
        .join(F.broadcast(per_day), "day_of_week", "left")
        .select(
            F.lit("day").alias("kind"),
            F.col("day_of_week").alias("position"),
            F.col("day_name").alias("label"),
            "row_count",
        )
    )
    hours = cells.groupBy("hour").agg(F.sum("n").alias("row_count"))
    return days.unionByName(
        hours.select(
            F.lit("hour").alias("kind"),
            F.col("hour").alias("position"),
            F.col("hour").cast("string").alias("label"),
            "row_count",
        )
    )


def day_hour_long(rows: DataFrame) -> DataFrame:
    """Row count per week day and hour that occur together."""
    t = F.col("timestamp")
    stamped = keyed(rows, "timestamp").select(
        cal.day_of_week(t).alias("day_of_week"), cal.day_name(t).alias("day_name"), F.hour(t).alias("hour")
    )
    return stamped.groupBy("day_of_week", "day_name", "hour").agg(F.count(F.lit(1)).alias("row_count"))


def day_hour_crosstab(rows: DataFrame) -> DataFrame:
    """Week days down, hours ``h0`` to ``h23`` across; 0 where a seen day has no such hour."""
    wide = (
        day_hour_long(rows)
        .groupBy("day_of_week")
        .agg(
            *[
                F.sum(F.when(F.col("hour") == h, F.col("row_count")).otherwise(0)).alias(f"h{h}")
                for h in range(24)
            ]
        )
    )
    return _week_days(rows).join(F.broadcast(wide), "day_of_week", "left")


def category_five_numbers(rows: DataFrame, by: str = "merchant_category", value: str = "amount") -> DataFrame:
    """Minimum, quartiles and maximum of the amount per category."""
    present = keyed(rows, by)
    ends = present.groupBy(by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    middle = quantiles(present, value, {"q1": 0.25, "median_value": 0.5, "q3": 0.75}, [by])
    return ends.join(middle, by, "left")


def daily_top_categories(rows: DataFrame, k: int = 5) -> DataFrame:
    """Rows per day and category for the ``k`` most frequent categories."""
    counts = (
        keyed(with_date(rows), "date", "merchant_category")
        .groupBy("date", "merchant_category")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    return counts.join(F.broadcast(top_values(rows, "merchant_category", k)), "merchant_category", "left_semi")


def distinct_count(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count_distinct(column).alias(f"distinct_{column}"))
