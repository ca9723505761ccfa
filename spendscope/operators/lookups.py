"""Joins with reference tables and lists of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.operators.dedup import keep_first


def with_reference(
    rows: DataFrame, reference: DataFrame | None, detail: str = "merchant_category_detailed", key: str = "merchant_id"
) -> DataFrame:
    """Left join of one reference column; the rows alone when there is no such reference.

    Spark broadcasts the reference when it measures it to be small; else it splits the partitions of
    merchants with a large share of the rows. Repeated merchants in the reference would repeat
    transactions, so the first detail per merchant is taken.
    """
    if reference is None or not {key, detail} <= set(reference.columns):
        return rows
    once = keep_first(reference.select(key, detail), key, [F.asc_nulls_last(detail)])
    return rows.join(once, key, "left")


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values, alphabetical among equals."""
    return (
        rows.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc(column))
        .limit(k)
        .select(column)
    )


def in_top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Rows with one of the ``k`` most frequent values; the list of ``k`` is broadcast."""
    return rows.join(F.broadcast(top_values(rows, column, k)), column, "left_semi")
