"""Outlying amounts, unusual users and the additive risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.operators.features import user_cells, user_homes
from spendscope.operators.hotkeys import ROWS, attach_by_key
from spendscope.operators.quantiles import iqr_fences, one_row
from spendscope.operators.users import behaviour
from spendscope.session import settle
from spendscope.sources.schemas import present

HIGH_RISK = 3
SUSPICIOUS = 4

# The columns of the suspicious report; the last four where present.
REPORT_COLUMNS = (
    "transaction_id", "user_id", "timestamp", "amount", "risk_score", "amount_zscore", "is_ml_anomaly",
    "merchant_id", "merchant_category", "location_country", "location_city",
)


def add_zscore(rows: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Absolute distance from the mean in sample deviations, and whether it exceeds 3.

    ``moments`` is one row ``mean, std`` where these are known already.
    """
    a = F.col("amount")
    if moments is None:
        moments = rows.agg(F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"))
    z = F.abs(F.try_divide(a - F.col("_moments.mean"), F.col("_moments.std")))
    return (
        rows.withColumn("_moments", one_row(moments))
        .withColumn("amount_zscore", z)
        .withColumn("is_z_outlier", F.col("amount_zscore") > 3)
        .drop("_moments")
    )


def moments_of(cells: DataFrame) -> DataFrame:
    """Mean and sample deviation of all amounts from the moments of disjoint cells."""
    whole = cells.agg((F.sum("amount") / F.sum("amounts")).alias("mean")).select("mean").scalar()
    off = F.col("mean") - whole
    return cells.agg(
        (F.sum("amount") / F.sum("amounts")).alias("mean"),
        F.when(
            F.sum("amounts") > 1, F.sqrt(F.sum(F.col("m2") + F.col("amounts") * off * off) / (F.sum("amounts") - 1))
        ).alias("std"),
    )


def flag_unusual(users: DataFrame) -> DataFrame:
    """Users whose count or total lies above the upper interquartile-range bound of all users."""
    measures = ["transaction_count", "total_amount"]
    long = users.select([F.col(m).cast("double").alias(m) for m in measures]).unpivot(
        [], measures, "measure", "v"
    )
    fences = iqr_fences(long, "v", ["measure"], few_groups=True).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("high"))).alias(m) for m in measures]
    )
    bounded = users.withColumn("_high", one_row(fences))
    return (
        bounded.withColumn("high_transaction_count", F.col("transaction_count") > F.col("_high.transaction_count"))
        .withColumn("high_total_amount", F.col("total_amount") > F.col("_high.total_amount"))
        .withColumn("is_unusual_user", F.col("high_transaction_count") | F.col("high_total_amount"))
        .drop("_high")
    )


def unusual_users(rows: DataFrame) -> DataFrame:
    """Users with their behaviour and flags; the user table is settled as bounds and flags both need it."""
    return flag_unusual(settle(behaviour(rows), "behaviour"))


def _facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the score needs besides a row: home and flag of its user, and the moments of all amounts; one pass."""
    cells = settle(user_cells(rows), "user-cells")
    users = flag_unusual(settle(user_homes(cells), "users"))
    return users.select("user_id", ROWS, "home_country", "is_unusual_user"), moments_of(cells)


def _point(condition: Column, points: int = 1) -> Column:
    return F.when(condition, points).otherwise(0)


def _own_points(rows: DataFrame) -> Column:
    """Points a transaction earns by itself, without knowing its user."""
    z, hour = F.col("amount_zscore"), F.hour("timestamp")
    points = _point(z > 2) + _point(z > 3) + _point(z > 4, 2) + _point((hour >= 23) | (hour <= 4))
    if "is_ml_anomaly" in rows.columns:
        points = points + _point(F.col("is_ml_anomaly") == 1, 2)
    if "is_online" in rows.columns:
        points = points + _point(F.col("is_online"))
    return points


def _user_points(use_cross_border: bool) -> Column:
    points = _point(F.col("is_unusual_user"))
    if use_cross_border:
        points = points + _point(~F.col("location_country").eqNullSafe(F.col("home_country")))
    return points


def _with_own_points(rows: DataFrame, moments: DataFrame) -> DataFrame:
    scored = add_zscore(rows, moments)
    return scored.withColumn("_points", _own_points(scored))


def add_risk_score(rows: DataFrame, use_cross_border: bool = True) -> DataFrame:
    """Risk score 0 to 10 on every row. ``is_ml_anomaly`` counts when the table has it."""
    facts, moments = _facts(rows)
    scored = attach_by_key(_with_own_points(rows, moments), facts, "user_id")
    score = (F.col("_points") + _user_points(use_cross_border)).cast("int")
    return scored.withColumn("risk_score", score).drop("_points", "is_unusual_user", "home_country")


def risk_cells(rows: DataFrame, use_cross_border: bool = True) -> DataFrame:
    """Row count per category and risk score.

    Rows are counted per user, country, category and own points before the user
    facts are joined: the join meets a few rows per user however many transactions
    the user has, and no transaction is shuffled.
    """
    facts, moments = _facts(rows)
    cells = (
        _with_own_points(rows, moments)
        .groupBy("user_id", "location_country", "merchant_category", "_points")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    joined = cells.join(facts.drop(ROWS), "user_id", "left")
    score = (F.col("_points") + _user_points(use_cross_border)).cast("int")
    return (
        joined.withColumn("risk_score", score)
        .groupBy("merchant_category", "risk_score")
        .agg(F.sum("_n").alias("row_count"))
    )


def risk_distribution(cells: DataFrame) -> DataFrame:
    return cells.groupBy("risk_score").agg(F.sum("row_count").alias("row_count")).orderBy("risk_score")


def risk_by_category(cells: DataFrame, least: int = 100) -> DataFrame:
    """Share of high-risk rows per category with at least ``least`` rows, highest first."""
    high = F.sum(F.when(F.col("risk_score") >= HIGH_RISK, F.col("row_count")).otherwise(0))
    return (
        cells.where(F.col("merchant_category").isNotNull())
        .groupBy("merchant_category")
        .agg(high.alias("high_risk_count"), F.sum("row_count").alias("total_count"))
        .where(F.col("total_count") >= least)
        .withColumn("high_risk_pct", F.col("high_risk_count") / F.col("total_count") * 100)
        .orderBy(F.desc("high_risk_pct"), "merchant_category")
    )


def high_risk_share(cells: DataFrame) -> DataFrame:
    """One row: all rows, high-risk rows and their share, suspicious rows."""

    def rows_from(score: int) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col("risk_score") >= score, F.col("row_count")).otherwise(0)), F.lit(0)
        )

    return cells.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_count"),
        rows_from(HIGH_RISK).alias("high_risk_count"),
        rows_from(SUSPICIOUS).alias("suspicious_count"),
    ).withColumn(
        "high_risk_pct", F.try_divide(F.col("high_risk_count") * F.lit(100.0), F.col("total_count"))
    )


def suspicious_report(rows: DataFrame, k: int = 1000, use_cross_border: bool = True) -> DataFrame:
    """The ``k`` most suspicious transactions.

    The user can add two points at most, so rows that cannot reach the limit even
    then are dropped before anything is joined.
    """
    reachable = SUSPICIOUS - (2 if use_cross_border else 1)
    facts, moments = _facts(rows)
    candidates = _with_own_points(rows, moments).where(F.col("_points") >= reachable)
    known = attach_by_key(candidates, facts, "user_id")
    scored = known.withColumn(
        "risk_score", (F.col("_points") + _user_points(use_cross_border)).cast("int")
    )
    report = scored.where(F.col("risk_score") >= SUSPICIOUS)
    best = report.orderBy(F.desc("risk_score"), F.desc("amount_zscore"), "transaction_id").limit(k)
    return best.select(present(best, REPORT_COLUMNS))
