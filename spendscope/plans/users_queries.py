"""Features per user and enriched transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.operators import users
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.sources.fixtures import card_month, merchant_lines, with_views


@named(
    "user_behaviour",
    with_views(
        "t1",
        """select user_id, cast(count(transaction_id) as bigint) as transaction_count,
                  round(sum(amount), 2) as total_amount, round(avg(amount), 6) as avg_amount,
                  round(max(amount), 6) as max_amount,
                  round(coalesce(stddev_samp(amount), 0), 6) as std_amount
           from t1 where user_id is not null group by user_id""",
    ),
)
def user_behaviour(spark, folder):
    return shaped(users.behaviour(card_month(spark, folder)), total_amount=2)


@named(
    "user_activity",
    with_views(
        "t1",
        """select user_id, round(avg(n), 6) as avg_daily_transactions, cast(count(*) as bigint) as active_days
           from (select user_id, cast(timestamp as date) as date, count(*) as n from t1 group by 1, 2)
           group by user_id""",
    ),
)
def user_activity(spark, folder):
    return shaped(users.activity(card_month(spark, folder)))


def _features_sql(view: str, mean_digits: int = 6, sum_digits: int = 2) -> str:
    return with_views(
        view,
        f"""with act as (select user_id, avg(n) as daily, count(*) as days
          from (select user_id, cast(timestamp as date) as date, count(*) as n from {view} group by 1, 2) group by 1),
        dev as (select user_id, device_type from (select user_id, device_type, row_number() over (
          partition by user_id order by count(*) desc, device_type) as nth
          from {view} where device_type is not null group by 1, 2) where nth = 1),
        main as (select user_id, cast(count(transaction_id) as bigint) as transaction_count,
          round(avg(amount) + 1e-11, {mean_digits}) as avg_transaction_amount,
          round(coalesce(stddev_samp(amount), 0), 6) as std_transaction_amount,
          round(min(amount), 6) as min_transaction_amount, round(max(amount), 6) as max_transaction_amount,
          round(sum(amount), {sum_digits}) as total_spend, round(avg(cast(is_online as int)), 6) as online_transaction_ratio,
          round(avg(case when isodow(timestamp) >= 6 then 1 else 0 end), 6) as weekend_transaction_ratio,
          cast(count(distinct merchant_id) as bigint) as unique_merchants,
          cast(count(distinct merchant_category) as bigint) as unique_categories,
          cast(count(distinct location_country) as bigint) as unique_countries,
          round(avg(hour(timestamp)), 6) as avg_transaction_hour,
          round(coalesce(stddev_samp(hour(timestamp)), 0), 6) as std_transaction_hour,
          round(avg(isodow(timestamp) - 1), 6) as avg_day_of_week
          from {view} where user_id is not null group by user_id)
        select main.*, device_type as preferred_device, round(daily, 6) as avg_daily_transactions,
               cast(days as bigint) as active_days
        from main left join dev using (user_id) left join act using (user_id)""",
    )


@named("user_features", _features_sql("t1"))
def user_features(spark, folder):
    rows = users.model_rows(card_month(spark, folder))
    return shaped(_off_halves(users.user_features(rows)), total_spend=2)


def _off_halves(features):
    """Means of few amounts often end on a half of the last digit shown; a shift, as in the SQL, lets both sides round alike."""
    return features.withColumn("avg_transaction_amount", F.col("avg_transaction_amount") + F.lit(1e-11))


@named("user_features_lines", _features_sql("t3", 8, 4))
def user_features_lines(spark, folder):
    rows = users.model_rows(merchant_lines(spark, folder))
    return shaped(_off_halves(users.user_features(rows)), total_spend=4, avg_transaction_amount=8)


_STATS_SQL = """with s as (select user_id, count(transaction_id) as n, avg(amount) as a from {view}
  where user_id is not null group by 1)
  select {columns}, cast(n as bigint) as user_transaction_count, round(a, 6) as user_avg_amount
  from {view} left join s using (user_id)"""


@named(
    "enrich_user_stats",
    with_views("t1", _STATS_SQL.format(view="t1", columns="transaction_id, user_id")),
)
def enrich_user_stats(spark, folder):
    rows = users.enrich_with_user_stats(card_month(spark, folder))
    return shaped(rows.select("transaction_id", "user_id", "user_transaction_count", "user_avg_amount"))


@named(
    "ml_preprocess",
    with_views(
        "t1",
        """select transaction_id, cast(hour(timestamp) as int) as hour,
                  cast(isodow(timestamp) - 1 as int) as day_of_week, cast(day(timestamp) as int) as day_of_month,
                  cast(month(timestamp) as int) as month, cast(year(timestamp) as int) as year,
                  case when isodow(timestamp) >= 6 then 1 else 0 end as is_weekend,
                  case when hour(timestamp) <= 6 then 'Night' when hour(timestamp) <= 12 then 'Morning'
                       when hour(timestamp) <= 18 then 'Afternoon' else 'Evening' end as time_of_day,
                  cast(is_online as int) as is_online from t1""",
    ),
)
def ml_preprocess(spark, folder):
    rows = users.model_rows(card_month(spark, folder))
    return rows.select(
        "transaction_id", "hour", "day_of_week", "day_of_month", "month", "year",
        "is_weekend", "time_of_day", "is_online",
    )
