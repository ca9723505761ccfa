"""Figures per country and city, and across borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.functions.money import total
from spendscope.operators.aggregates import keyed, with_shares


def _places(rows: DataFrame, *keys: str) -> DataFrame:
    """Row count, value and value per row: one grouping where two results could be joined."""
    return (
        keyed(rows, *keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("transaction_count"), total(F.col("amount")).alias("transaction_value"))
        .withColumn(
            "avg_transaction_value", F.try_divide(F.col("transaction_value"), F.col("transaction_count"))
        )
    )


def country_figures(rows: DataFrame, k: int = 20) -> DataFrame:
    per_country = _places(rows, "location_country")
    return per_country.orderBy(F.desc("transaction_count"), "location_country").limit(k)


def city_figures(rows: DataFrame, k: int = 50) -> DataFrame:
    per_city = _places(rows, "location_country", "location_city")
    return per_city.orderBy(
        F.desc("transaction_count"), "location_country", "location_city"
    ).limit(k)


def top_cities(rows: DataFrame, k: int = 20) -> DataFrame:
    """City names by row count, whatever their country."""
    per_city = keyed(rows, "location_city").groupBy("location_city")
    return (
        per_city.agg(F.count(F.lit(1)).alias("transaction_count"))
        .orderBy(F.desc("transaction_count"), "location_city")
        .limit(k)
    )


def cross_border_figures(rows: DataFrame) -> DataFrame:
    """Count, value and mean of cross-border and domestic transactions.

    Works on one row per user and country instead of joining the home country to
    every transaction: the country rows of a user already carry all that is summed.
    """
    pairs = rows.groupBy("user_id", "location_country").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("transaction_id").alias("ids"),
        F.count("amount").alias("amounts"),
        total(F.col("amount")).alias("value"),
    )
    # Rows without a country never name the home country; rows without a user have none.
    best = Window.partitionBy("user_id").orderBy(
        F.desc(F.when(F.col("location_country").isNotNull(), F.col("rows"))), F.asc("location_country")
    )
    home = F.when(
        F.col("user_id").isNotNull(), F.first("location_country").over(best)
    )
    flagged = pairs.withColumn("is_cross_border", ~F.col("location_country").eqNullSafe(home))
    groups = flagged.groupBy("is_cross_border").agg(
        F.sum("ids").alias("transaction_count"),
        F.sum("value").alias("transaction_value"),
        F.try_divide(F.sum("value"), F.sum("amounts")).alias("avg_transaction_value"),
    )
    label = F.when(F.col("is_cross_border"), "Cross-Border").otherwise("Domestic")
    return with_shares(groups.withColumn("transaction_type", label))
