"""The numbers behind the insight texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.operators import geography, risk, timeseries
from spendscope.session import settle


def _ranked(groups: DataFrame, label: str, measure: Column, order: list, k: int, kind: str) -> DataFrame:
    """First ``k`` groups as ``kind, position, label, measure``; for frames of a few groups."""
    top = groups.orderBy(*order).limit(k)
    return top.select(
        F.lit(kind).alias("kind"),
        F.row_number().over(Window.partitionBy().orderBy(*order)).alias("position"),
        F.col(label).alias("label"),
        measure.cast("double").alias("measure"),
    )


def top_places(rows: DataFrame, k: int = 5) -> DataFrame:
    n = F.col("transaction_count")
    countries = geography.country_figures(rows)
    cities = geography.city_figures(rows)
    return _ranked(
        countries, "location_country", n, [F.desc("transaction_count"), "location_country"], k, "country"
    ).unionByName(
        _ranked(
            cities, "location_city", n,
            [F.desc("transaction_count"), "location_country", "location_city"], k, "city",
        )
    )


def cross_border_percent(rows: DataFrame) -> DataFrame:
    groups = geography.cross_border_figures(rows)
    n = F.col("transaction_count")
    crossing = F.coalesce(F.sum(F.when(F.col("is_cross_border"), n)), F.lit(0))
    return groups.agg(
        crossing.alias("cross_border_count"),
        F.coalesce(F.sum(n), F.lit(0)).alias("transaction_count"),
        F.try_divide(crossing * F.lit(100.0), F.sum(n)).alias("cross_border_pct"),
    )


def peaks(rows: DataFrame, k: int = 2) -> DataFrame:
    """Busiest week days, busiest and quietest months by mean daily count."""
    series = timeseries.daily_series(rows)
    days = timeseries.week_day_pattern(series)
    months = timeseries.month_of_year_pattern(series)
    n = F.col("transaction_count")
    most, least = F.desc("transaction_count"), F.asc("transaction_count")
    return (
        _ranked(days, "day_name", n, [most, "day_of_week"], k, "peak day")
        .unionByName(_ranked(months, "month_name", n, [most, "month"], k, "peak month"))
        .unionByName(_ranked(months, "month_name", n, [least, "month"], k, "low month"))
    )


def risk_summary(rows: DataFrame, k: int = 3, use_cross_border: bool = True) -> DataFrame:
    """High-risk percentage, suspicious rows and the riskiest categories."""
    cells = settle(risk.risk_cells(rows, use_cross_border), "risk-cells")
    share = risk.high_risk_share(cells)

    def single(name: str, kind: str) -> DataFrame:
        return share.select(
            F.lit(kind).alias("kind"), F.lit(1).alias("position"), F.lit("all").alias("label"),
            F.col(name).cast("double").alias("measure"),
        )

    categories = risk.risk_by_category(cells)
    return (
        single("high_risk_pct", "high risk percent")
        .unionByName(single("suspicious_count", "suspicious count"))
        .unionByName(
            _ranked(
                categories, "merchant_category", F.col("high_risk_pct"),
                [F.desc("high_risk_pct"), "merchant_category"], k, "risky category",
            )
        )
    )
