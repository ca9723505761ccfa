"""Removing repeated transaction ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in the given order; null keys count as one key.

    The filter on ``row_number() = 1`` lets Spark drop later rows before the
    shuffle (``WindowGroupLimit``), so a key with a third of all rows sends at
    most one row per task.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return (
        rows.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") == 1).drop("_nth")
    )


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the keys of ``seen``; rows without a key are kept.

    Each key should be in ``rows`` once, as :func:`keep_first` leaves them.
    ``seen`` may be the whole history, so it is first cut down to the keys that
    occur in ``rows``: at most as many as the increment has.
    """
    repeated = seen.select(key).join(rows.select(key).distinct(), key, "left_semi").distinct()
    return rows.join(repeated, key, "left_anti")


def repeat_counts(rows: DataFrame, key: str) -> DataFrame:
    """One row: all rows, rows beyond the first of their key, and their percentage."""
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sums = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return sums.withColumn(
        "duplicate_pct", F.try_divide(F.col("duplicate_rows") * F.lit(100.0), F.col("total_rows"))
    )
