"""Cleaning of raw transaction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.functions.calendar import parse_timestamp
from spendscope.functions.money import clip
from spendscope.functions.text import tidy
from spendscope.operators.dedup import keep_first
from spendscope.operators.quantiles import iqr_fences, one_row
from spendscope.sources.schemas import TEXT_COLUMNS, present


def tidy_text(rows: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Trimmed lower-case text, ``unknown`` for nulls, in those columns the table has."""
    return rows.withColumns(
        {c: F.coalesce(tidy(F.col(c)), F.lit("unknown")) for c in present(rows, columns)}
    )


def fill_gaps(rows: DataFrame) -> DataFrame:
    """Missing amounts flagged and set to 0, missing online flags set to false."""
    new: dict[str, Column] = {}
    if "amount" in rows.columns:
        new["missing_amount"] = F.col("amount").isNull()
        new["amount"] = F.coalesce("amount", F.lit(0.0))
    if "is_online" in rows.columns:
        new["is_online"] = F.coalesce("is_online", F.lit(False))
    return rows.withColumns(new)


def read_timestamps(rows: DataFrame) -> DataFrame:
    if dict(rows.dtypes).get("timestamp") != "string":
        return rows
    return rows.withColumn("timestamp", parse_timestamp(F.col("timestamp")))


def flag_high_amounts(rows: DataFrame) -> DataFrame:
    """``is_amount_outlier``: above the upper interquartile-range bound of all rows."""
    fences = one_row(iqr_fences(rows, "amount"))
    return rows.withColumn("is_amount_outlier", F.col("amount") > fences["high"])


def flag_outer_amounts(rows: DataFrame) -> DataFrame:
    """Outside either bound, and ``amount_capped`` moved to the nearer bound."""
    amount = F.col("amount")
    bounded = rows.withColumn("_fence", one_row(iqr_fences(rows, "amount")))
    low, high = F.col("_fence.low"), F.col("_fence.high")
    return bounded.withColumns(
        {
            "is_amount_outlier": (amount < low) | (amount > high),
            "amount_capped": clip(amount, low, high),
        }
    ).drop("_fence")


def clean_for_analysis(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Analysis cleaning: one row per id first, then outliers on both sides and capping."""
    filled = fill_gaps(tidy_text(read_timestamps(raw)))
    return flag_outer_amounts(keep_first(filled, "transaction_id", order))


def with_target(rows: DataFrame, target: str) -> DataFrame:
    return rows.where(F.col(target).isNotNull())
