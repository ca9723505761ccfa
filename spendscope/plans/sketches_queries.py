"""Sketches, checked by the bounds that their figures must keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.operators import profiling, sketches
from spendscope.operators.quantiles import one_row
from spendscope.plans.ingest_queries import day_files
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.session import fresh_path
from spendscope.sources import files
from spendscope.sources.fixtures import card_month, with_views
from spendscope.sources.schemas import TEXT_COLUMNS
from spendscope.streaming import increments

_CSV = "*.csv"
_UNPIVOT = (
    "(unpivot (select timestamp, "
    + ", ".join(f"cast({c} as varchar) as {c}" for c in ("user_id", *TEXT_COLUMNS))
    + f" from t1) on {', '.join(('user_id', *TEXT_COLUMNS))} into name column_name value v)"
)


def _close(estimate: str, exact: str):
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(0.03 * F.col(exact), F.lit(1.0))


@named(
    "profile_sketch_by_file",
    with_views(
        "t1",
        f"""select cast(cast(timestamp as date) as varchar) as source_day, column_name, cast(count(v) as bigint) as value_count,
                   true as is_close from {_UNPIVOT} group by 1, 2""",
    ),
)
def profile_sketch_by_file(spark, folder):
    """Distinct values of each daily file within 3 % (or 1) of the exact number."""
    rows = files.read_raw(spark, day_files(spark, folder), _CSV)
    columns = ["user_id", *TEXT_COLUMNS]
    said = sketches.read_profile(sketches.merged(sketches.profile_sketches(rows, columns, [], ["source_file", "source_day"]), ["source_day"]))
    exact = profiling.distinct_profile(rows, columns, ["source_day"]).select("source_day", "column_name", F.col("distinct_values").alias("exact"))
    both = said.join(exact, ["source_day", "column_name"])
    return shaped(both.select("source_day", "column_name", F.col("count").alias("value_count"), _close("distinct_values", "exact").alias("is_close")))


@named(
    "profile_sketch_merged",
    with_views(
        "t1",
        f"""select column_name, cast(count(v) as bigint) as value_count, true as is_close, null::double as min_value, null::double as max_value
            from {_UNPIVOT} group by 1
            union all select 'amount', count(amount), true, round(min(amount), 4), round(max(amount), 4) from t1""",
    ),
)
def profile_sketch_merged(spark, folder):
    """The whole month from sketches that a stream kept per batch; distinct values within 3 %, quantiles within 1 % of the ranks."""
    out, checkpoint = fresh_path(spark, "sketches"), fresh_path(spark, "progress")
    columns = ["user_id", *TEXT_COLUMNS]
    arriving = increments.incoming(spark, day_files(spark, folder), files_per_batch=8)
    increments.maintain_profile(arriving, out, checkpoint, columns, ["amount"])
    said = sketches.read_profile(increments.latest_profile(spark, out))
    rows = card_month(spark, folder)
    exact = profiling.distinct_profile(rows, [*columns, "amount"]).select("column_name", F.col("distinct_values").alias("exact"))
    amount = one_row(said.where("column_name = 'amount'"))
    share = {name: F.count_if(F.col("amount") <= F.col(f"_said.{name}")) / F.count("amount") for name in sketches.QUANTILES}
    ranks = one_row(rows.withColumn("_said", amount).agg(*[share[name].alias(name) for name in share]))
    near = [F.abs(ranks[name] - p) <= 0.01 for name, p in sketches.QUANTILES.items()]
    in_rank = F.when(F.col("column_name") == "amount", near[0] & near[1] & near[2] & near[3]).otherwise(True)
    both = said.join(exact, "column_name").withColumn("is_close", _close("distinct_values", "exact") & in_rank)
    return shaped(both.select("column_name", F.col("count").alias("value_count"), "is_close", "min_value", "max_value"), 4)


@named(
    "distinct_users_sketch",
    with_views(
        "t1",
        """select coalesce(merchant_category, 'all') as merchant_category, cast(count(*) as bigint) as transaction_count, true as is_close
           from t1 group by rollup (merchant_category)""",
    ),
)
def distinct_users_sketch(spark, folder):
    """Distinct users per category and of all, from sketches per category and day."""
    rows = card_month(spark, folder).withColumn("date", F.to_date("timestamp"))
    kept = sketches.distinct_over(rows, "user_id", ["merchant_category", "date"])
    said = sketches.distinct_in(kept, ["merchant_category"]).unionByName(
        sketches.distinct_in(kept).withColumn("merchant_category", F.lit("all"))
    )
    exact = rows.rollup("merchant_category").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.count_distinct("user_id").alias("exact")
    )
    exact = exact.fillna("all", ["merchant_category"])
    both = said.join(exact, "merchant_category")
    return both.select("merchant_category", "transaction_count", _close("distinct_values", "exact").alias("is_close"))


@named(
    "high_value_sketch",
    with_views("t1", "select true as is_close, cast(count(*) as bigint) as row_count from t1"),
)
def high_value_sketch(spark, folder):
    """Amounts above the approximate 95th percentile are 5 % of all, to one in a hundred rows."""
    rows = card_month(spark, folder)
    edge = one_row(sketches.read_profile(sketches.profile_sketches(rows, [], ["amount"])))["q95"]
    above = rows.withColumn("_edge", edge).agg(
        F.count_if(F.col("amount") > F.col("_edge")).alias("high"), F.count(F.lit(1)).alias("row_count")
    )
    return above.select((F.abs(F.col("high") / F.col("row_count") - 0.05) <= 0.01).alias("is_close"), "row_count")
