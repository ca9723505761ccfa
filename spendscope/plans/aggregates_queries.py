"""Grouped figures."""

from __future__ import annotations

from spendscope.operators import aggregates as agg
from spendscope.operators import geography
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.sources.fixtures import card_month, merchant_lines, order_years, with_views

_MONEY = {"transaction_value": 2, "total_value": 2, "total_amount": 2}


def _figures_sql(key: str, expression: str, view: str = "t1", tail: str = "", kept: str = "") -> str:
    return with_views(
        view,
        f"""select {kept or key}, cast(count(transaction_id) as bigint) as transaction_count,
                   round(coalesce(sum(amount), 0), 2) as transaction_value,
                   round(avg(amount), 6) as avg_transaction_value
            from (select *, {expression} as {key} from {view}) where {key} is not null group by {key} {tail}""",
    )


DAILY_SQL = _figures_sql("date", "cast(cast(timestamp as date) as varchar)")


@named("agg_daily", DAILY_SQL)
def agg_daily(spark, folder):
    return shaped(agg.daily(card_month(spark, folder)), **_MONEY)


@named(
    "agg_daily_recent",
    with_views(
        "t2",
        """select cast(cast(timestamp as date) as varchar) as date, cast(count(*) as bigint) as row_count,
                  round(sum(amount), 2) as total_amount from t2 group by 1 order by 1 desc limit 180""",
    ),
)
def agg_daily_recent(spark, folder):
    return shaped(agg.daily_recent(order_years(spark, folder)), **_MONEY)


@named("agg_hourly", _figures_sql("hour", "cast(hour(timestamp) as int)"))
def agg_hourly(spark, folder):
    return shaped(agg.hourly(card_month(spark, folder)), **_MONEY)


@named(
    "peak_hour",
    with_views(
        "t1",
        """select cast(hour(timestamp) as int) as hour, cast(count(transaction_id) as bigint) as transaction_count
           from t1 group by 1 order by 2 desc, 1 limit 1""",
    ),
)
def peak_hour(spark, folder):
    return agg.peak_hour(card_month(spark, folder))


@named(
    "top_merchants_count",
    with_views(
        "t1",
        """select merchant_name, cast(count(*) as bigint) as transaction_count from t1
           where merchant_name is not null group by 1 order by 2 desc, 1 limit 10""",
    ),
)
def top_merchants_count(spark, folder):
    return agg.top_merchants_by_count(card_month(spark, folder))


@named(
    "top_merchants_value",
    with_views(
        "t1",
        """select merchant_name, round(sum(amount), 2) as total_value from t1
           where merchant_name is not null group by 1 order by sum(amount) desc, 1 limit 10""",
    ),
)
def top_merchants_value(spark, folder):
    return shaped(agg.top_merchants_by_value(card_month(spark, folder)), **_MONEY)


@named(
    "top_merchants_value_lines",
    with_views(
        "t3",
        """select merchant_name, round(sum(amount), 2) as total_value from t3
           where merchant_name is not null group by 1 order by sum(amount) desc, 1 limit 10""",
    ),
)
def top_merchants_value_lines(spark, folder):
    return shaped(agg.top_merchants_by_value(merchant_lines(spark, folder)), **_MONEY)


_BY_CATEGORY = "order by transaction_count desc, merchant_category limit 10"


@named(
    "agg_category",
    with_views(
        "t3",
        f"""select merchant_category, cast(count(transaction_id) as bigint) as transaction_count,
                   round(coalesce(sum(amount), 0), 2) as transaction_value,
                   round(avg(amount), 6) as avg_transaction_value
            from t3 where merchant_category is not null group by merchant_category {_BY_CATEGORY}""",
    ),
)
def agg_category(spark, folder):
    return shaped(agg.top_categories(merchant_lines(spark, folder)), **_MONEY)


@named(
    "agg_online",
    with_views(
        "t1",
        """with g as (select is_online, count(transaction_id) as n, sum(amount) as v, avg(amount) as a
             from t1 where is_online is not null group by is_online)
           select is_online, case when is_online then 'Online' else 'Offline' end as transaction_type,
                  cast(n as bigint) as transaction_count, round(v, 2) as transaction_value,
                  round(a, 6) as avg_transaction_value,
                  round(n * 100.0 / sum(n) over (), 6) as count_share_pct,
                  round(v * 100.0 / sum(v) over (), 6) as value_share_pct from g""",
    ),
)
def agg_online(spark, folder):
    return shaped(agg.by_channel(card_month(spark, folder)), **_MONEY)


@named(
    "category_frequency",
    with_views(
        "t1",
        """select merchant_category, cast(count(*) as bigint) as row_count, round(avg(amount), 6) as avg_amount
           from t1 where merchant_category is not null group by 1""",
    ),
)
def category_frequency(spark, folder):
    return shaped(agg.category_frequency(card_month(spark, folder)))


_DAYS_SQL = """days as (select unnest([0, 1, 2, 3, 4, 5, 6]) as day_of_week, unnest(['Monday', 'Tuesday',
  'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) as day_name)"""


@named(
    "freq_dow_hour",
    with_views(
        "t1",
        f"""with {_DAYS_SQL}
        select 'day' as kind, cast(day_of_week as int) as position, day_name as label,
               cast(n as bigint) as row_count
        from days left join (select isodow(timestamp) - 1 as day_of_week, count(*) as n from t1 group by 1)
          using (day_of_week)
        union all
        select 'hour', cast(hour(timestamp) as int), cast(hour(timestamp) as varchar), cast(count(*) as bigint)
        from t1 where timestamp is not null group by 2, 3""",
    ),
)
def freq_dow_hour(spark, folder):
    return agg.frequency_by_day_and_hour(card_month(spark, folder))


@named(
    "crosstab_dow_hour",
    with_views(
        "t1",
        f"with {_DAYS_SQL} select cast(day_of_week as int) as day_of_week, day_name, "
        + ", ".join(
            f"cast(count(timestamp) filter (hour(timestamp) = {h}) as bigint) as h{h}" for h in range(24)
        )
        + " from days left join t1 on isodow(timestamp) - 1 = day_of_week group by day_of_week, day_name",
    ),
)
def crosstab_dow_hour(spark, folder):
    return agg.day_hour_crosstab(card_month(spark, folder))


@named(
    "crosstab_dow_hour_long",
    with_views(
        "t1",
        """select cast(isodow(timestamp) - 1 as int) as day_of_week, dayname(timestamp) as day_name,
                  cast(hour(timestamp) as int) as hour, cast(count(*) as bigint) as row_count
           from t1 where timestamp is not null group by 1, 2, 3""",
    ),
)
def crosstab_dow_hour_long(spark, folder):
    return agg.day_hour_long(card_month(spark, folder))


def _boxplot_sql(view: str) -> str:
    return with_views(
        view,
        f"""select merchant_category, round(min(amount), 6) as min_value,
                   round(quantile_cont(amount, 0.25), 6) as q1, round(median(amount), 6) as median_value,
                   round(quantile_cont(amount, 0.75), 6) as q3, round(max(amount), 6) as max_value
            from {view} where merchant_category is not null group by merchant_category""",
    )


@named("category_boxplot", _boxplot_sql("t1"))
def category_boxplot(spark, folder):
    return shaped(agg.category_five_numbers(card_month(spark, folder)))


@named("category_boxplot_lines", _boxplot_sql("t3"))
def category_boxplot_lines(spark, folder):
    return shaped(agg.category_five_numbers(merchant_lines(spark, folder)))


@named(
    "trend_top_categories",
    with_views(
        "t1",
        """select cast(cast(timestamp as date) as varchar) as date, merchant_category,
                  cast(count(*) as bigint) as row_count from t1
           where timestamp is not null and merchant_category in (
             select merchant_category from t1 where merchant_category is not null group by 1
             order by count(*) desc, merchant_category limit 5)
           group by 1, 2""",
    ),
)
def trend_top_categories(spark, folder):
    return shaped(agg.daily_top_categories(card_month(spark, folder)))


@named(
    "distinct_users",
    with_views("t1", "select cast(count(distinct user_id) as bigint) as distinct_user_id from t1"),
)
def distinct_users(spark, folder):
    return agg.distinct_count(card_month(spark, folder), "user_id")


@named(
    "top_cities_count",
    with_views(
        "t1",
        """select location_city, cast(count(*) as bigint) as transaction_count from t1
           where location_city is not null group by 1 order by 2 desc, 1 limit 20""",
    ),
)
def top_cities_count(spark, folder):
    return geography.top_cities(card_month(spark, folder))
