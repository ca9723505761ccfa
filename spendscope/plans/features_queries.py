"""Derived columns, lookups and flags per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.functions.money import amount_class_order
from spendscope.operators import features, lookups
from spendscope.plans.registry import named
from spendscope.session import settle
from spendscope.sources.fixtures import (
    card_month,
    dirty_month,
    merchant_lines,
    merchant_reference,
    parsed,
    with_views,
)

HOME_SQL = """
home as (select user_id, location_country as home_country from (
  select user_id, location_country, row_number() over (
    partition by user_id order by count(*) desc, location_country) as nth
  from {source} where location_country is not null group by user_id, location_country) where nth = 1)
"""
_LINE = ["transaction_id", "merchant_id", "timestamp"]


@named(
    "feat_calendar",
    with_views(
        "t1",
        """select transaction_id, cast(cast(timestamp as date) as varchar) as date, cast(year(timestamp) as int) as year,
                  cast(month(timestamp) as int) as month, cast(day(timestamp) as int) as day,
                  cast(hour(timestamp) as int) as hour, cast(isodow(timestamp) - 1 as int) as day_of_week,
                  isodow(timestamp) >= 6 as is_weekend from t1""",
    ),
)
def feat_calendar(spark, folder):
    rows = features.add_calendar(card_month(spark, folder))
    return rows.select(
        "transaction_id", F.col("date").cast("string").alias("date"), "year", "month", "day", "hour", "day_of_week", "is_weekend"
    )


@named(
    "feat_calendar_dirty",
    with_views(
        "t1raw",
        """select transaction_id, file_seq, coalesce(cast(hour(ts) as int), -1) as hour,
                  coalesce(cast(isodow(ts) - 1 as int), -1) as day_of_week,
                  coalesce(isodow(ts) >= 6, false) as is_weekend
           from (select *, try_cast(timestamp as timestamp) as ts from t1raw)""",
    ),
)
def feat_calendar_dirty(spark, folder):
    """Rows without a valid timestamp have no hour and are on no weekend."""
    rows = features.add_calendar(parsed(dirty_month(spark, folder)))
    shown = rows.select("transaction_id", "file_seq", "hour", "day_of_week", "is_weekend")
    return shown.fillna(-1, ["hour", "day_of_week"])


@named(
    "feat_day_names",
    with_views(
        "t1",
        """select transaction_id, dayname(timestamp) as day_name, monthname(timestamp) as month_name,
                  cast(quarter(timestamp) as int) as quarter from t1""",
    ),
)
def feat_day_names(spark, folder):
    rows = features.add_calendar_names(card_month(spark, folder))
    return rows.select("transaction_id", "day_name", "month_name", "quarter")


@named(
    "feat_time_period",
    with_views(
        "t1raw",
        """select transaction_id, file_seq, case when h < 6 then 'night' when h < 12 then 'morning'
                  when h < 18 then 'afternoon' when h >= 18 then 'evening' else 'unknown' end as time_period
           from (select *, hour(try_cast(timestamp as timestamp)) as h from t1raw)""",
    ),
)
def feat_time_period(spark, folder):
    rows = features.add_day_period(parsed(dirty_month(spark, folder)))
    return rows.select("transaction_id", "file_seq", "time_period")


@named(
    "feat_time_of_day",
    with_views(
        "t1raw",
        """select transaction_id, file_seq, case when h <= 6 then 'Night' when h <= 12 then 'Morning'
                  when h <= 18 then 'Afternoon' when h <= 24 then 'Evening' end as time_of_day
           from (select *, hour(try_cast(timestamp as timestamp)) as h from t1raw)""",
    ),
)
def feat_time_of_day(spark, folder):
    rows = features.add_day_part(parsed(dirty_month(spark, folder)))
    return rows.select("transaction_id", "file_seq", "time_of_day")


@named(
    "feat_days_since",
    with_views(
        "t1",
        """select transaction_id, cast(date_diff('day', cast(timestamp as date), date '2024-03-01') as int)
             as days_since_transaction from t1""",
    ),
)
def feat_days_since(spark, folder):
    rows = features.add_age(card_month(spark, folder), F.lit("2024-03-01").cast("date"))
    return rows.select("transaction_id", "days_since_transaction")


@named(
    "feat_high_value_online",
    with_views(
        "t3",
        """select transaction_id, merchant_id, timestamp, amount > 1000 as high_value,
                  amount > 1000 and is_online as high_value_online from t3""",
    ),
)
def feat_high_value_online(spark, folder):
    rows = features.add_high_value(merchant_lines(spark, folder))
    return rows.select(*_LINE, "high_value", "high_value_online")


@named(
    "feat_high_value_p95",
    with_views(
        "t3",
        """select transaction_id, merchant_id, timestamp, round(amount, 4) as amount,
                  amount > (select round(quantile_cont(amount, 0.95), 9) from t3) as high_value from t3""",
    ),
)
def feat_high_value_p95(spark, folder):
    """The joined lines are settled: the quantile reads them twice, the flags once more."""
    lines = settle(merchant_lines(spark, folder).select(*_LINE, "amount"), "lines")
    rows = features.add_relative_high_value(lines)
    return rows.select(*_LINE, F.round("amount", 4).alias("amount"), "high_value")


@named(
    "feat_amount_category",
    with_views(
        "t3",
        """select transaction_id, merchant_id, timestamp,
                  case when amount is null then 'unknown' when amount <= 10 then 'very_small'
                       when amount <= 50 then 'small' when amount <= 100 then 'medium'
                       when amount <= 500 then 'large' when amount <= 1000 then 'very_large'
                       else 'huge' end as amount_category,
                  case when amount is null then null when amount <= 10 then 1 when amount <= 50 then 2
                       when amount <= 100 then 3 when amount <= 500 then 4 when amount <= 1000 then 5
                       else 6 end as amount_category_order from t3""",
    ),
)
def feat_amount_category(spark, folder):
    rows = features.add_amount_class(merchant_lines(spark, folder))
    return rows.select(
        *_LINE,
        "amount_category",
        amount_class_order(F.col("amount_category")).alias("amount_category_order"),
    )


def _unusual_sql(view: str, columns: str) -> str:
    return with_views(
        view,
        f"""with {HOME_SQL.format(source=view)}
        select {columns}, location_country is distinct from coalesce(home_country, 'unknown')
          as unusual_location from {view} left join home using (user_id)""",
    )


@named("feat_unusual_location", _unusual_sql("t3", "transaction_id, merchant_id, timestamp, location_country"))
def feat_unusual_location(spark, folder):
    rows = features.add_unusual_location(merchant_lines(spark, folder))
    return rows.select(*_LINE, "location_country", "unusual_location")


@named(
    "feat_unusual_location_month",
    _unusual_sql("t1raw", "transaction_id, file_seq, location_country"),
)
def feat_unusual_location_month(spark, folder):
    rows = features.add_unusual_location(dirty_month(spark, folder))
    return rows.select("transaction_id", "file_seq", "location_country", "unusual_location")


@named("user_home_country", with_views("t3", f"with {HOME_SQL.format(source='t3')} select * from home"))
def user_home_country(spark, folder):
    return features.home_countries(merchant_lines(spark, folder))


@named(
    "join_merchant_ref",
    with_views(
        "t3 merchant_ref",
        """select transaction_id, merchant_id, timestamp, merchant_category_detailed
           from t3 left join merchant_ref using (merchant_id)""",
    ),
)
def join_merchant_ref(spark, folder):
    rows = lookups.with_reference(merchant_lines(spark, folder), merchant_reference(spark, folder))
    return rows.select(*_LINE, "merchant_category_detailed")


@named(
    "join_merchant_ref_partial",
    with_views(
        "t1 merchant_ref",
        """select transaction_id, merchant_id, merchant_category_detailed from t1
           left join (select concat('M', merchant_id) as merchant_id, merchant_category_detailed
                      from merchant_ref) using (merchant_id)""",
    ),
)
def join_merchant_ref_partial(spark, folder):
    """Merchants without a reference row keep their transactions, with a null detail."""
    reference = merchant_reference(spark, folder).withColumn(
        "merchant_id", F.concat(F.lit("M"), "merchant_id")
    )
    rows = lookups.with_reference(card_month(spark, folder), reference)
    return rows.select("transaction_id", "merchant_id", "merchant_category_detailed")


@named(
    "geo_cross_border_flag",
    with_views(
        "t1",
        f"""with {HOME_SQL.format(source='t1')}
        select transaction_id, location_country, home_country,
               location_country is distinct from home_country as is_cross_border
        from t1 left join home using (user_id)""",
    ),
)
def geo_cross_border_flag(spark, folder):
    rows = features.add_cross_border(card_month(spark, folder))
    return rows.select("transaction_id", "location_country", "home_country", "is_cross_border")


@named(
    "semi_top_categories",
    with_views(
        "t3",
        """select transaction_id, merchant_id, timestamp, merchant_category from t3 where merchant_category in (
             select merchant_category from t3 where merchant_category is not null group by merchant_category
             order by count(*) desc, merchant_category limit 5)""",
    ),
)
def semi_top_categories(spark, folder):
    rows = lookups.in_top_values(merchant_lines(spark, folder), "merchant_category", 5)
    return rows.select(*_LINE, "merchant_category")
