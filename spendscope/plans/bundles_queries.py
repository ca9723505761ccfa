"""Whole analyses as single tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from spendscope.plans import bundles
from spendscope.plans.cleaning_queries import TIDY_SQL, fences_sql
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.sources.fixtures import card_month, dirty_month, with_views
from spendscope.sources.schemas import TEXT_COLUMNS


@named(
    "analysis_table",
    with_views(
        "t1raw",
        f"""with tidied as (select transaction_id, user_id, merchant_id, file_seq, {TIDY_SQL},
             amount is null as missing_amount, coalesce(amount, 0.0) as amount,
             coalesce(is_online, false) as is_online, try_cast(timestamp as timestamp) as timestamp from t1raw),
        first_rows as (select * exclude (nth) from (select *, row_number() over (
          partition by transaction_id order by file_seq) as nth from tidied) where nth = 1),
        {fences_sql('first_rows')},
        edge as (select round(quantile_cont(amount, 0.95), 9) as p95 from first_rows),
        home as (select user_id, location_country as home_country from (
          select user_id, location_country, row_number() over (partition by user_id
            order by count(*) desc, location_country) as nth from first_rows group by 1, 2) where nth = 1)
        select transaction_id, user_id, merchant_id, merchant_name, merchant_category, currency, location_country, location_city,
               device_type, status, is_online, timestamp, round(amount, 2) as amount, missing_amount,
               coalesce(cast(year(timestamp) as int), -1) as year, coalesce(cast(month(timestamp) as int), -1) as month,
               coalesce(cast(day(timestamp) as int), -1) as day, coalesce(cast(isodow(timestamp) - 1 as int), -1) as day_of_week,
               coalesce(isodow(timestamp) >= 6, false) as is_weekend,
               coalesce(cast(date_diff('day', cast(timestamp as date), date '2024-03-01') as int), -1) as days_since_transaction,
               amount < low or amount > high as is_amount_outlier,
               round(least(greatest(amount, low), high), 4) as amount_capped,
               coalesce(cast(cast(timestamp as date) as varchar), 'none') as date,
               coalesce(cast(hour(timestamp) as int), -1) as hour,
               case when hour(timestamp) < 6 then 'night' when hour(timestamp) < 12 then 'morning'
                    when hour(timestamp) < 18 then 'afternoon' when hour(timestamp) >= 18 then 'evening'
                    else 'unknown' end as time_period,
               amount > 1000 and is_online as high_value_online, amount > p95 as high_value,
               case when amount <= 10 then 'very_small' when amount <= 50 then 'small'
                    when amount <= 100 then 'medium' when amount <= 500 then 'large'
                    when amount <= 1000 then 'very_large' else 'huge' end as amount_category,
               location_country is distinct from coalesce(home_country, 'unknown') as unusual_location
        from first_rows left join home using (user_id), fence, edge""",
    ),
)
def analysis_table(spark, folder):
    """Raw rows to the analysis table: cleaning, duplicates, bounds and all derived columns."""
    rows = bundles.analysis_table(
        dirty_month(spark, folder), ["file_seq"], F.lit("2024-03-01").cast("date")
    )
    chosen = rows.select(
        "transaction_id", "user_id", "merchant_id", *TEXT_COLUMNS, "is_online", "timestamp", "amount", "missing_amount",
        "is_amount_outlier", "amount_capped", F.coalesce(F.col("date").cast("string"), F.lit("none")).alias("date"),
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("year", "month", "day", "hour", "day_of_week", "days_since_transaction")],
        "is_weekend", "time_period", "high_value_online", "high_value", "amount_category", "unusual_location",
    )
    return shaped(chosen, amount=2, amount_capped=4)


_PART = """select '{kind}' as kind, cast({key} as varchar) as label,
  cast({counted} as double) as transaction_count, round({value}, 2) as transaction_value,
  round({mean}, 9) as avg_transaction_value, round({shares} * 100.0 / sum({shares}) over (), 6) as count_share_pct,
  round({value_shares} * 100.0 / sum({value_shares}) over (), 6) as value_share_pct
  from t1 where {key} is not null group by {key}"""
_FIGURES = {"counted": "count(transaction_id)", "value": "coalesce(sum(amount), 0)", "mean": "avg(amount)"}
_NO_SHARES = {"shares": "null::double", "value_shares": "null::double"}
_BASIC_SQL = (
    ("day", "cast(timestamp as date)", _FIGURES | _NO_SHARES, ""),
    ("hour", "hour(timestamp)", _FIGURES | _NO_SHARES, ""),
    ("category", "merchant_category", _FIGURES | _NO_SHARES, "order by 3 desc, 2 limit 10"),
    ("channel", "is_online", _FIGURES | {"shares": "count(transaction_id)", "value_shares": "sum(amount)"}, ""),
    ("merchant by count", "merchant_name",
     {"counted": "count(*)", "value": "null::double", "mean": "null::double"} | _NO_SHARES, "order by 3 desc, 2 limit 10"),
    ("merchant by value", "merchant_name",
     {"counted": "null::double", "value": "sum(amount)", "mean": "null::double"} | _NO_SHARES, "order by sum(amount) desc, 2 limit 10"),
)


@named(
    "basic_summary",
    with_views("t1", " union all ".join(f"({_PART.format(kind=kind, key=key, **figures)} {tail})" for kind, key, figures, tail in _BASIC_SQL)),
)
def basic_summary(spark, folder):
    """The six tables of the basic bundle as one long one: all of it comes from one settled cube."""
    tables = bundles.basic(card_month(spark, folder))
    keys = {
        "daily_metrics": ("day", "date"),
        "hourly_pattern": ("hour", "hour"),
        "category_metrics": ("category", "merchant_category"),
        "online_metrics": ("channel", "is_online"),
        "top_merchants_count": ("merchant by count", "merchant_name"),
        "top_merchants_value": ("merchant by value", "merchant_name"),
    }
    figures = ("transaction_count", "transaction_value", "avg_transaction_value", "count_share_pct", "value_share_pct")

    def part(table, kind: str, key: str):
        named_alike = table.withColumnRenamed("total_value", "transaction_value")
        known = [F.col(c) if c in named_alike.columns else F.lit(None) for c in figures]
        return named_alike.select(
            F.lit(kind).alias("kind"),
            F.col(key).cast("string").alias("label"),
            *[column.cast("double").alias(c) for c, column in zip(figures, known)],
        )

    parts = [part(tables[name], kind, key) for name, (kind, key) in keys.items()]
    return shaped(reduce(lambda a, b: a.unionByName(b), parts), transaction_value=2, avg_transaction_value=9)
