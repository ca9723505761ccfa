"""Profiles, data quality and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.operators import profiling
from spendscope.plans.registry import named
from spendscope.sources.fixtures import card_month, dirty_month, order_years, with_views
from spendscope.sources.schemas import TRANSACTION_COLUMNS

_TEXTS = [c for c in TRANSACTION_COLUMNS if c not in ("amount", "is_online", "timestamp")]


def _counts_sql(columns) -> str:
    parts = [f"select '{c}' as column_name, cast({c} as varchar) as value from t1raw" for c in columns]
    return (
        "counts as (select column_name, value, cast(count(*) as bigint) as value_count from ("
        + " union all ".join(parts)
        + ") where value is not null group by column_name, value)"
    )


@named(
    "profile_distinct",
    with_views(
        "t1raw",
        f"""with {_counts_sql(TRANSACTION_COLUMNS)}
        select column_name, case column_name when 'amount' then 'double' when 'is_online' then 'boolean'
                 else 'string' end as data_type,
               cast(count(*) as bigint) as distinct_values,
               cast(sum(value_count) as bigint) as non_null_values,
               round(count(*) * 100.0 / sum(value_count), 6) as unique_pct
        from counts group by column_name""",
    ),
)
def profile_distinct(spark, folder):
    profile = profiling.distinct_profile(dirty_month(spark, folder), TRANSACTION_COLUMNS)
    return profile.withColumn("unique_pct", F.round("unique_pct", 6))


def _ends_sql(top: str, bottom: str) -> str:
    ranked = (
        "select column_name, value, value_count, '{side}' as side, cast(row_number() over"
        " (partition by column_name order by {order}) as int) as position from counts"
    )
    both = " union all ".join(
        ranked.format(side=s, order=o) for s, o in (("top", top), ("bottom", bottom))
    )
    return with_views(
        "t1raw", f"with {_counts_sql(_TEXTS)} select * from ({both}) where position <= 10"
    )


@named("profile_top_bottom_by_count", _ends_sql("value_count desc, value", "value_count, value desc"))
def profile_top_bottom_by_count(spark, folder):
    return profiling.ends_by_count(profiling.value_counts(dirty_month(spark, folder), _TEXTS))


@named("profile_top_bottom_lex", _ends_sql("value", "value desc"))
def profile_top_bottom_lex(spark, folder):
    return profiling.ends_by_value(profiling.value_counts(dirty_month(spark, folder), _TEXTS))


@named(
    "profile_numeric",
    with_views(
        "t1raw",
        """select 'amount' as column_name, round(min(amount), 4) as min_value, round(max(amount), 4) as max_value,
                  round(avg(amount), 6) as mean_value, round(median(amount), 6) as median_value from t1raw
           union all
           select 'file_seq', min(file_seq), max(file_seq), round(avg(file_seq), 6), median(file_seq) from t1raw""",
    ),
)
def profile_numeric(spark, folder):
    p = profiling.numeric_profile(dirty_month(spark, folder), ["amount", "file_seq"])
    return p.select(
        "column_name",
        F.round("min_value", 4).alias("min_value"),
        F.round("max_value", 4).alias("max_value"),
        F.round("mean_value", 6).alias("mean_value"),
        F.round("median_value", 6).alias("median_value"),
    )


@named(
    "quality_missing",
    with_views(
        "t1raw",
        "select * from ("
        + " union all ".join(
            f"select '{c}' as column_name, cast(count(*) - count({c}) as bigint) as missing_count,"
            f" round((count(*) - count({c})) * 100.0 / count(*), 6) as missing_pct from t1raw"
            for c in (*TRANSACTION_COLUMNS, "file_seq")
        )
        + ") where missing_count > 0",
    ),
)
def quality_missing(spark, folder):
    gaps = profiling.missing_profile(dirty_month(spark, folder))
    return gaps.withColumn("missing_pct", F.round("missing_pct", 6))


@named(
    "quality_cardinality",
    with_views(
        "t1raw",
        " union all ".join(
            f"select '{c}' as column_name, cast(count(distinct {c}) as bigint) as unique_values from t1raw"
            for c in (*_TEXTS, "timestamp")
        ),
    ),
)
def quality_cardinality(spark, folder):
    return profiling.cardinality(dirty_month(spark, folder))


@named(
    "quality_duplicates",
    with_views(
        "t1raw",
        """select cast(count(*) as bigint) as total_rows,
                  cast(count(*) - count(distinct transaction_id) as bigint) as duplicate_rows,
                  round((count(*) - count(distinct transaction_id)) * 100.0 / count(*), 6) as duplicate_pct
           from t1raw""",
    ),
)
def quality_duplicates(spark, folder):
    figures = profiling.duplicates(dirty_month(spark, folder))
    return figures.withColumn("duplicate_pct", F.round("duplicate_pct", 6))


@named(
    "quality_describe",
    with_views(
        "t1raw",
        """select cast(count(amount) as bigint) as value_count, round(avg(amount), 6) as mean_value,
                  round(stddev_samp(amount), 6) as std_value, round(min(amount), 6) as min_value,
                  round(max(amount), 6) as max_value, round(quantile_cont(amount, 0.25), 6) as q25,
                  round(quantile_cont(amount, 0.5), 6) as q50, round(quantile_cont(amount, 0.75), 6) as q75
           from t1raw""",
    ),
)
def quality_describe(spark, folder):
    d = profiling.describe(dirty_month(spark, folder), "amount")
    return d.select("value_count", *[F.round(c, 6).alias(c) for c in d.columns if c != "value_count"])


@named(
    "quality_iqr_outliers",
    with_views(
        "t1raw",
        """with f as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high
             from (select round(quantile_cont(amount, 0.25), 9) as q1,
                          round(quantile_cont(amount, 0.75), 9) as q3 from t1raw))
           select round(max(low), 6) as lower_bound, round(max(high), 6) as upper_bound,
                  cast(count(*) filter (amount < low or amount > high) as bigint) as outlier_count,
                  round(count(*) filter (amount < low or amount > high) * 100.0 / count(*), 6) as outlier_pct
           from t1raw, f""",
    ),
)
def quality_iqr_outliers(spark, folder):
    share = profiling.iqr_outlier_share(dirty_month(spark, folder), "amount")
    return share.select(
        "outlier_count",
        *[F.round(c, 6).alias(c) for c in ("lower_bound", "upper_bound", "outlier_pct")],
    )


@named(
    "sample_exact_n",
    with_views(
        "t1",
        """select transaction_id, user_id, round(amount, 4) as amount from t1
           order by cast('0x' || substr(md5(transaction_id), 1, 13) as bigint), transaction_id limit 1000""",
    ),
)
def sample_exact_n(spark, folder):
    sample = profiling.sample_rows(card_month(spark, folder), 1000)
    return sample.select("transaction_id", "user_id", F.round("amount", 4).alias("amount"))


@named(
    "sample_users",
    with_views(
        "t2",
        """select transaction_id, user_id, round(amount, 4) as amount from t2 where user_id in
             (select user_id from (select distinct user_id from t2)
              order by cast('0x' || substr(md5(user_id), 1, 13) as bigint), user_id limit 500)""",
    ),
)
def sample_users(spark, folder):
    sample = profiling.sample_entities(order_years(spark, folder), 500)
    return sample.select("transaction_id", "user_id", F.round("amount", 4).alias("amount"))
