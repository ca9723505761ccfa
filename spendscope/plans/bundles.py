"""Whole analyses: named small tables from one transaction table.

Each bundle reads the transactions as few times as it can: what several results
share is settled first, and the results are taken from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.functions.money import total
from spendscope.operators import clustering, geography, regression, risk, segments, timeseries
from spendscope.operators.aggregates import keyed, with_shares
from spendscope.operators.cleaning import clean_for_analysis
from spendscope.operators.features import analysis_features
from spendscope.operators.users import model_rows, user_features
from spendscope.session import settle

_CUBE_KEYS = ("date", "hour", "merchant_name", "merchant_category", "is_online")


def analysis_table(raw: DataFrame, order: list[str], as_of=None) -> DataFrame:
    """Cleaned, deduplicated rows with all derived columns.

    The deduplicated rows are settled: bounds, thresholds and home countries are
    taken from them in further passes.
    """
    return analysis_features(settle(clean_for_analysis(raw, order), "clean"), as_of)


def activity_cube(rows: DataFrame) -> DataFrame:
    """Counts and sums per day, hour, merchant, category and channel."""
    t = F.col("timestamp")
    stamped = rows.withColumns({"date": F.to_date(t), "hour": F.hour(t)})
    return stamped.groupBy(*_CUBE_KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("transaction_id").alias("ids"),
        F.count("amount").alias("amounts"),
        total(F.col("amount")).alias("value"),
    )


def _rolled(cube: DataFrame, key: str) -> DataFrame:
    return (
        keyed(cube, key)
        .groupBy(key)
        .agg(
            F.sum("ids").alias("transaction_count"),
            F.sum("value").alias("transaction_value"),
            F.try_divide(F.sum("value"), F.sum("amounts")).alias("avg_transaction_value"),
        )
    )


def basic(rows: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Daily, hourly, merchant, category and channel figures from one scan of the transactions."""
    cube = settle(activity_cube(rows), "cube")
    merchants = keyed(cube, "merchant_name").groupBy("merchant_name")
    by_count = merchants.agg(F.sum("rows").alias("transaction_count"))
    by_value = merchants.agg(F.sum("value").alias("total_value"))
    label = F.when(F.col("is_online"), "Online").otherwise("Offline")
    return {
        "daily_metrics": _rolled(cube, "date"),
        "hourly_pattern": _rolled(cube, "hour"),
        "category_metrics": _rolled(cube, "merchant_category")
        .orderBy(F.desc("transaction_count"), "merchant_category")
        .limit(k),
        "online_metrics": with_shares(_rolled(cube, "is_online").withColumn("transaction_type", label)),
        "top_merchants_count": by_count.orderBy(F.desc("transaction_count"), "merchant_name").limit(k),
        "top_merchants_value": by_value.orderBy(F.desc("total_value"), "merchant_name").limit(k),
    }


def geographic(rows: DataFrame) -> dict[str, DataFrame]:
    return {
        "country_metrics": geography.country_figures(rows),
        "city_metrics": geography.city_figures(rows),
        "cross_border_metrics": geography.cross_border_figures(rows),
    }


def seasonal(rows: DataFrame) -> dict[str, DataFrame]:
    """Calendar patterns, trend and decomposition from one daily series."""
    series = settle(timeseries.daily_series(rows), "series")
    weeks = timeseries.weekly(series)
    return {
        "dow_patterns": timeseries.week_day_pattern(series),
        "monthly_patterns": timeseries.monthly_pattern(series),
        "month_avg_patterns": timeseries.month_of_year_pattern(series),
        "weekly_trend": timeseries.weekly_trend(weeks),
        "decomposition": timeseries.decompose(weeks),
    }


def anomalies(rows: DataFrame, use_cross_border: bool = True) -> dict[str, DataFrame]:
    """Risk figures from one table of counts, and the suspicious transactions."""
    cells = settle(risk.risk_cells(rows, use_cross_border), "cells")
    return {
        "risk_score_distribution": risk.risk_distribution(cells),
        "high_risk_categories": risk.risk_by_category(cells),
        "high_risk_share": risk.high_risk_share(cells),
        "suspicious_transactions": risk.suspicious_report(rows, use_cross_border=use_cross_border),
    }


def segmentation(rows: DataFrame) -> dict[str, DataFrame]:
    users = settle(segments.segmented(rows), "segments")
    return {"users": users, "segment_summary": segments.segment_summary(users)}


def modelling(rows: DataFrame, clusters: int | None = None, most: int = 10) -> dict[str, DataFrame]:
    """User clusters and the amount regression; the number of clusters is searched when not given."""
    users = settle(clustering.fill_with_medians(user_features(model_rows(rows), "median")), "features")
    result: dict[str, DataFrame] = {}
    if clusters is None:
        result["elbow"] = clustering.elbow(users, most)
        clusters = result["elbow"].where("is_suggested").first()["k"]
    clustered = settle(clustering.with_clusters(users, clustering.fit_clusters(users, clusters)), "clusters")
    features = settle(regression.prediction_features(rows), "prediction")
    ridge = regression.fit_ridge(features)
    predictions = settle(ridge.predict(features.where(F.col("is_test"))), "predictions")
    profiles = clustering.profile(clustered)
    return {
        **result,
        "clustered_users": clustered,
        "cluster_profile": profiles,
        "cluster_payload": clustering.payload(profiles),
        "projection": clustering.project(users),
        "predictions": predictions,
        "regression_metrics": regression.evaluate(predictions),
        "residual_histogram": regression.residual_histogram(predictions),
        "feature_importance": ridge.importance(rows.sparkSession),
    }
