"""Cleaning and duplicate removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.operators import cleaning, dedup
from spendscope.plans.registry import named
from spendscope.sources.fixtures import dirty_month, merchant_lines, with_views
from spendscope.sources.schemas import TEXT_COLUMNS

TIDY_SQL = ", ".join(
    f"coalesce(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), 'unknown') as {c}" for c in TEXT_COLUMNS
)
FILLED = """
filled as (select * exclude (amount, is_online, timestamp), amount is null as missing_amount,
                  coalesce(amount, 0.0) as amount, coalesce(is_online, false) as is_online,
                  try_cast(timestamp as timestamp) as timestamp
           from t1raw),
"""
# round(.., 9) undoes the last-bit error the oracle makes when it interpolates
# between two equal values; amounts have two decimals.
def fences_sql(source: str) -> str:
    return f"""
fence as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high
          from (select round(quantile_cont(amount, 0.25), 9) as q1,
                       round(quantile_cont(amount, 0.75), 9) as q3 from {source}))"""


_FIRST = """
first_rows as (select * exclude (nth) from (
  select *, row_number() over (partition by transaction_id order by file_seq) as nth from filled)
  where nth = 1),
"""


@named(
    "clean_strings",
    with_views("t1raw", f"select transaction_id, file_seq, merchant_id, {TIDY_SQL} from t1raw"),
)
def clean_strings(spark, folder):
    rows = cleaning.tidy_text(dirty_month(spark, folder))
    return rows.select("transaction_id", "file_seq", "merchant_id", *TEXT_COLUMNS)


@named(
    "clean_amount_flags",
    with_views(
        "t1raw",
        f"with {FILLED.strip().rstrip(',')} "
        "select transaction_id, file_seq, missing_amount, round(amount, 2) as amount, is_online from filled",
    ),
)
def clean_amount_flags(spark, folder):
    rows = cleaning.fill_gaps(dirty_month(spark, folder))
    return rows.select(
        "transaction_id", "file_seq", "missing_amount", F.round("amount", 2).alias("amount"), "is_online"
    )


@named(
    "clean_timestamp_coerce",
    with_views(
        "t1raw",
        """select transaction_id, file_seq, try_cast(timestamp as timestamp) as timestamp,
                  try_cast(timestamp as timestamp) is null as bad_timestamp from t1raw""",
    ),
)
def clean_timestamp_coerce(spark, folder):
    rows = cleaning.read_timestamps(dirty_month(spark, folder))
    return rows.select(
        "transaction_id", "file_seq", "timestamp", F.col("timestamp").isNull().alias("bad_timestamp")
    )


@named(
    "outlier_upper_iqr",
    with_views(
        "t1raw",
        f"with {FILLED} {fences_sql('filled')} "
        "select transaction_id, file_seq, round(amount, 2) as amount, amount > high as is_amount_outlier "
        "from filled, fence",
    ),
)
def outlier_upper_iqr(spark, folder):
    rows = cleaning.flag_high_amounts(cleaning.fill_gaps(dirty_month(spark, folder)))
    return rows.select(
        "transaction_id", "file_seq", F.round("amount", 2).alias("amount"), "is_amount_outlier"
    )


_TWO_SIDED = f"with {FILLED} {_FIRST} {fences_sql('first_rows')}"


def _analysis_rows(spark, folder):
    filled = cleaning.fill_gaps(dirty_month(spark, folder))
    return cleaning.flag_outer_amounts(dedup.keep_first(filled, "transaction_id", ["file_seq"]))


@named(
    "outlier_two_sided_iqr",
    with_views(
        "t1raw",
        f"{_TWO_SIDED} select transaction_id, amount < low or amount > high as is_amount_outlier "
        "from first_rows, fence",
    ),
)
def outlier_two_sided_iqr(spark, folder):
    return _analysis_rows(spark, folder).select("transaction_id", "is_amount_outlier")


@named(
    "amount_capped",
    with_views(
        "t1raw",
        f"{_TWO_SIDED} select transaction_id, round(amount, 2) as amount, "
        "round(least(greatest(amount, low), high), 4) as amount_capped from first_rows, fence",
    ),
)
def amount_capped(spark, folder):
    return _analysis_rows(spark, folder).select(
        "transaction_id",
        F.round("amount", 2).alias("amount"),
        F.round("amount_capped", 4).alias("amount_capped"),
    )


@named(
    "dedup_keep_first",
    with_views(
        "t3",
        """select transaction_id, user_id, merchant_id, merchant_category, round(amount, 4) as amount, timestamp
           from (select *, row_number() over (partition by transaction_id
                   order by timestamp, merchant_id, amount, merchant_category, user_id) as nth from t3)
           where nth = 1""",
    ),
)
def dedup_keep_first(spark, folder):
    order = ["timestamp", "merchant_id", "amount", "merchant_category", "user_id"]
    first = dedup.keep_first(merchant_lines(spark, folder), "transaction_id", order)
    return first.select(
        "transaction_id", "user_id", "merchant_id", "merchant_category",
        F.round("amount", 4).alias("amount"), "timestamp",
    )


@named(
    "dedup_across_files",
    with_views(
        "t1raw",
        """select transaction_id, file_seq, merchant_category, round(amount, 2) as amount
           from (select *, row_number() over (partition by transaction_id order by file_seq) as nth
                 from t1raw) where nth = 1""",
    ),
)
def dedup_across_files(spark, folder):
    rows = dirty_month(spark, folder)
    first, second = (
        dedup.keep_first(rows.where(F.col("file_seq") == n), "transaction_id", ["timestamp", "amount"])
        for n in (1, 2)
    )
    kept = first.unionByName(dedup.unseen(second, first, "transaction_id"))
    return kept.select(
        "transaction_id", "file_seq", "merchant_category", F.round("amount", 2).alias("amount")
    )


@named(
    "dedup_removed_count",
    with_views(
        "t3",
        """select cast(count(*) as bigint) as rows_before,
                  cast(count(distinct transaction_id) as bigint) as rows_after,
                  cast(count(*) - count(distinct transaction_id) as bigint) as rows_removed from t3""",
    ),
)
def dedup_removed_count(spark, folder):
    counts = dedup.repeat_counts(merchant_lines(spark, folder), "transaction_id")
    return counts.select(
        F.col("total_rows").alias("rows_before"),
        (F.col("total_rows") - F.col("duplicate_rows")).alias("rows_after"),
        F.col("duplicate_rows").alias("rows_removed"),
    )


@named(
    "ids_seen_vs_new",
    with_views(
        "t1raw",
        """select transaction_id, count(*) filter (file_seq = 1) > 0 as in_first,
                  count(*) filter (file_seq = 2) > 0 as in_second,
                  case when count(*) filter (file_seq = 1) > 0 and count(*) filter (file_seq = 2) > 0
                       then 'seen' when count(*) filter (file_seq = 2) > 0 then 'new'
                       else 'first only' end as id_state
           from t1raw group by transaction_id""",
    ),
)
def ids_seen_vs_new(spark, folder):
    """Which ids both files share, as the intersection and the two differences of the id sets."""
    rows = dirty_month(spark, folder)
    first = rows.where("file_seq = 1").select("transaction_id")
    second = rows.where("file_seq = 2").select("transaction_id")

    def state(ids, in_first, in_second, name):
        return ids.select(
            "transaction_id",
            F.lit(in_first).alias("in_first"),
            F.lit(in_second).alias("in_second"),
            F.lit(name).alias("id_state"),
        )

    return (
        state(first.intersect(second), True, True, "seen")
        .unionByName(state(second.subtract(first), False, True, "new"))
        .unionByName(state(first.subtract(second), True, False, "first only"))
    )


@named(
    "union_all_files",
    with_views(
        "t1raw",
        """select file_seq, cast(count(*) as bigint) as rows, round(sum(amount), 2) as total_amount
           from t1raw group by file_seq""",
    ),
)
def union_all_files(spark, folder):
    rows = dirty_month(spark, folder)
    together = rows.where("file_seq = 1").unionByName(rows.where("file_seq = 2"), allowMissingColumns=True)
    return together.groupBy("file_seq").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("amount"), 2).alias("total_amount")
    )
