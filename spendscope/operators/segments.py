"""Recency, frequency and spend per user, cut into three segments each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.functions.calendar import whole_days_between
from spendscope.functions.money import total
from spendscope.operators.aggregates import keyed
from spendscope.operators.quantiles import one_row, quantiles
from spendscope.session import settle

# Segment names from the lowest to the highest third.
SPEND_NAMES = FREQUENCY_NAMES = ("Low", "Medium", "High")
RECENCY_NAMES = ("Recent", "Moderate", "Old")

# segment column, measure it cuts, names
CUTS = (
    ("spend_segment", "total_spend", SPEND_NAMES),
    ("frequency_segment", "transaction_count", FREQUENCY_NAMES),
    ("recency_segment", "recency_days", RECENCY_NAMES),
)


def user_base(rows: DataFrame) -> DataFrame:
    return (
        keyed(rows, "user_id")
        .groupBy("user_id")
        .agg(
            F.count("transaction_id").alias("transaction_count"),
            total(F.col("amount")).alias("total_spend"),
            F.avg("amount").alias("avg_transaction"),
            F.min("timestamp").alias("first_transaction"),
            F.max("timestamp").alias("last_transaction"),
        )
    )


def with_recency(rows: DataFrame) -> DataFrame:
    """Whole days from the last transaction to the newest of all, and between first and last plus 1."""
    newest = rows.agg(F.max("timestamp").alias("newest")).scalar()
    return user_base(rows).withColumns(
        {
            "recency_days": whole_days_between(F.col("last_transaction"), newest),
            "tenure_days": whole_days_between(F.col("first_transaction"), F.col("last_transaction")) + 1,
        }
    )


def tertile_edges(users: DataFrame, measures: list[str]) -> DataFrame:
    """One row: the four tertile edges of each measure, all measures in one pass."""
    long = users.select([F.col(m).cast("double").alias(m) for m in measures]).unpivot(
        [], measures, "measure", "v"
    )
    thirds = {"e0": 0.0, "e1": 1 / 3, "e2": 2 / 3, "e3": 1.0}
    edges = quantiles(long, "v", thirds, ["measure"], few_groups=True)
    return edges.agg(
        *[
            F.max(F.when(F.col("measure") == m, F.struct(*thirds))).alias(m)
            for m in measures
        ]
    )


def third_of(value: str, edges: str, names: tuple[str, str, str]) -> Column:
    """Name of the third, bins closed on the right.

    The bins are the tertiles, or three of equal width when any two edges coincide
    (the range then widens by 0.1 % when all values are equal).
    """
    low, mid, high = names
    tied = " or ".join(f"{edges}.e{i} = {edges}.e{i + 1}" for i in range(3))
    width = f"({edges}.e3 - {edges}.e0) / 3"
    return F.expr(
        f"""case when {value} is null then null
                 when {edges}.e0 = {edges}.e3 then '{mid}'
                 when {value} <= if({tied}, {edges}.e0 + {width}, {edges}.e1) then '{low}'
                 when {value} <= if({tied}, {edges}.e0 + {width} * 2, {edges}.e2) then '{mid}'
                 else '{high}' end"""
    )


def segmented(rows: DataFrame) -> DataFrame:
    """Users with recency, tenure and the three segments.

    The user table is settled first: edges and labels both need it, and computing
    it is the only step that reads all transactions.
    """
    return label_users(settle(with_recency(rows), "users"))


def label_users(users: DataFrame) -> DataFrame:
    edges = one_row(tertile_edges(users, [measure for _, measure, _ in CUTS]))
    cut = users.withColumn("_edges", edges)
    return cut.withColumns(
        {
            name: third_of(measure, f"_edges.{measure}", names)
            for name, measure, names in CUTS
        }
    ).drop("_edges")


def segment_summary(users: DataFrame) -> DataFrame:
    """User count and means for all 27 combinations of the three segments, empty ones included."""
    keys = [name for name, _, _ in CUTS]
    grid = users.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, SPEND_NAMES))).alias(keys[0])
    )
    for key, names in zip(keys[1:], (FREQUENCY_NAMES, RECENCY_NAMES)):
        grid = grid.withColumn(key, F.explode(F.array(*map(F.lit, names))))
    groups = users.groupBy(*keys).agg(
        F.count("user_id").alias("user_count"),
        F.avg("total_spend").alias("avg_total_spend"),
        F.avg("transaction_count").alias("avg_transaction_count"),
        F.avg("avg_transaction").alias("avg_transaction_size"),
        F.avg("recency_days").alias("avg_recency_days"),
        F.avg("tenure_days").alias("avg_tenure_days"),
    )
    return grid.join(F.broadcast(groups), keys, "left").fillna(0, ["user_count"])
