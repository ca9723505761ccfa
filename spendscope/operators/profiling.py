"""Column profiles and data-quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.functions.text import HASH_SPAN, stable_hash
from spendscope.operators.dedup import repeat_counts
from spendscope.operators.quantiles import (
    iqr_fences,
    linear_cells,
    one_row,
    quantiles,
    smallest,
)


def value_counts(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count per column and non-null value, all columns in one scan and one shuffle; for each ``by`` apart."""
    texts = rows.select(*by, *[F.col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot(list(by), list(columns), "column_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "column_name", "value")
        .agg(F.count(F.lit(1)).alias("value_count"))
    )


def distinct_profile(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Type, distinct values, non-null values and percentage of distinct values per column.

    With ``by`` (a source file or its day) each of its values has a profile of its own.
    """
    kinds = dict(rows.dtypes)
    kind = F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])]), F.col("column_name"))
    return (
        value_counts(rows, columns, by)
        .groupBy(*by, "column_name")
        .agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("value_count").alias("non_null_values"))
        .withColumn("data_type", kind)
        .withColumn(
            "unique_pct", F.try_divide(F.col("distinct_values") * F.lit(100.0), F.col("non_null_values"))
        )
    )


def describe_all(rows: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """One row per column: the eight figures of a number; count, distinct values, most frequent and its count of a text.

    Figures that a column does not have are null. Of equally frequent values the alphabetically first is named.
    """
    long = rows.select([F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], list(numbers), "column_name", "v")
    quartiles = quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column_name"], few_groups=True)
    moments = long.groupBy("column_name").agg(
        F.count("v").alias("value_count"),
        F.avg("v").alias("mean_value"),
        F.stddev_samp("v").alias("std_value"),
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
    )
    counts = value_counts(rows, texts)
    best = F.min_by("value", F.struct((-F.col("value_count")).alias("n"), "value"))
    described = counts.groupBy("column_name").agg(
        F.sum("value_count").alias("value_count"),
        F.count(F.lit(1)).alias("unique_values"),
        best.alias("top_value"),
        F.max("value_count").alias("top_count"),
    )
    # One row per column on both sides of the join.
    return moments.join(quartiles, "column_name").unionByName(described, allowMissingColumns=True)


def _ends(counts: DataFrame, first: list, last: list, k: int) -> DataFrame:
    """First and last ``k`` values per column. Each side is ranked by itself, so the
    rank limit is applied before the shuffle and no column gathers in one task."""

    def side(order: list, name: str) -> DataFrame:
        w = Window.partitionBy("column_name").orderBy(*order)
        return (
            counts.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= k)
            .withColumn("side", F.lit(name))
        )

    return side(first, "top").unionByName(side(last, "bottom"))


def ends_by_count(counts: DataFrame, k: int = 10) -> DataFrame:
    return _ends(
        counts, [F.desc("value_count"), F.asc("value")], [F.asc("value_count"), F.desc("value")], k
    )


def ends_by_value(counts: DataFrame, k: int = 10) -> DataFrame:
    return _ends(counts, [F.asc("value")], [F.desc("value")], k)


def numeric_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and median per numeric column."""
    numbers = rows.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    basic = numbers.groupBy("column_name").agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
    )
    middle = quantiles(numbers, "value", {"median_value": 0.5}, ["column_name"], few_groups=True)
    return basic.join(F.broadcast(middle), "column_name", "left")


def missing_profile(rows: DataFrame) -> DataFrame:
    """Missing values and their percentage for the columns that miss any."""
    names = rows.columns
    gaps = rows.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    )
    return (
        gaps.unpivot("_rows", names, "column_name", "missing_count")
        .where(F.col("missing_count") > 0)
        .withColumn("missing_pct", F.col("missing_count") * F.lit(100.0) / F.col("_rows"))
        .drop("_rows")
        .orderBy(F.desc("missing_pct"), "column_name")
    )


def cardinality(rows: DataFrame) -> DataFrame:
    """Distinct non-null values per text column."""
    texts = [name for name, kind in rows.dtypes if kind == "string"]
    counted = value_counts(rows, texts).groupBy("column_name")
    return counted.agg(F.count(F.lit(1)).alias("unique_values"))


def duplicates(rows: DataFrame) -> DataFrame:
    return repeat_counts(rows, "transaction_id")


def describe(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, quartiles and maximum."""
    quartiles = one_row(
        quantiles(rows, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    )
    c = F.col(column)
    basic = rows.agg(
        F.count(c).alias("value_count"),
        F.avg(c).alias("mean_value"),
        F.stddev_samp(c).alias("std_value"),
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
    )
    return basic.withColumn("_q", quartiles).select("*", "_q.*").drop("_q")


def iqr_outlier_share(rows: DataFrame, column: str) -> DataFrame:
    """Rows outside the two interquartile-range bounds and their share of all rows."""
    fenced = rows.select(F.col(column).alias("_v")).withColumn("_f", one_row(iqr_fences(rows, column)))
    outside = (F.col("_v") < F.col("_f.low")) | (F.col("_v") > F.col("_f.high"))
    return fenced.agg(
        F.max("_f.low").alias("lower_bound"),
        F.max("_f.high").alias("upper_bound"),
        F.count_if(outside).alias("outlier_count"),
        (F.count_if(outside) * F.lit(100.0) / F.count(F.lit(1))).alias("outlier_pct"),
    )


def sample_rows(rows: DataFrame, n: int, key: str = "transaction_id") -> DataFrame:
    """Exactly ``n`` rows (all when there are fewer), chosen by a hash of the key."""
    hashed = rows.withColumn("_hash", stable_hash(F.col(key)))
    return smallest(hashed, "_hash", n, key, cells=linear_cells(0.0, HASH_SPAN)).drop("_hash")


def sample_entities(rows: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """All rows of ``n`` entities chosen by a hash; all rows when there are no more than ``n``.

    The chosen keys number at most ``n``, which bounds the broadcast.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    chosen = sample_rows(keys, n, key)
    chosen = F.broadcast(chosen) if n <= 100_000 else chosen
    return rows.join(chosen, key, "left_semi")
