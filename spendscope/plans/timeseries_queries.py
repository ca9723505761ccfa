"""Daily and weekly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.operators import timeseries as ts
from spendscope.operators.aggregates import with_date
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.sources.fixtures import order_years, with_views

SERIES_SQL = """
per_day as (select cast(timestamp as date) as date, count(transaction_id) as n, sum(amount) as v, avg(amount) as a
            from t2 where timestamp is not null group by 1),
spine as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from per_day),
series as (select date, cast(coalesce(n, 0) as bigint) as n, coalesce(v, 0) as v, coalesce(a, 0) as a
           from spine left join per_day using (date))
"""
WEEKS_SQL = """
weeks as (select date + cast(7 - isodow(date) as int) as week_end, cast(sum(n) as bigint) as n, sum(v) as v,
                 avg(a) as a from series group by 1)
"""
_DAYS_MONEY = {"transaction_value": 2}


def _series(spark, folder):
    return ts.daily_series(order_years(spark, folder))


@named(
    "date_range_spine",
    with_views(
        "t2",
        """select cast(cast(unnest(generate_series(min(cast(timestamp as date)), max(cast(timestamp as date)),
                  interval 1 day)) as date) as varchar) as date from t2""",
    ),
)
def date_range_spine(spark, folder):
    return shaped(ts.date_spine(with_date(order_years(spark, folder))))


@named(
    "ts_daily_filled",
    with_views(
        "t2",
        f"""with {SERIES_SQL} select cast(date as varchar) as date, n as transaction_count,
        round(v, 2) as transaction_value, round(a, 6) as avg_transaction_value,
        cast(year(date) as int) as year, cast(month(date) as int) as month, cast(day(date) as int) as day,
        cast(isodow(date) - 1 as int) as day_of_week, isodow(date) >= 6 as is_weekend,
        dayname(date) as day_name, monthname(date) as month_name, cast(quarter(date) as int) as quarter
        from series""",
    ),
)
def ts_daily_filled(spark, folder):
    return shaped(_series(spark, folder), **_DAYS_MONEY)


_MEANS = """round(avg(n), 6) as transaction_count, round(avg(v), 4) as transaction_value,
            round(avg(a), 6) as avg_transaction_value"""


@named(
    "ts_dow_patterns",
    with_views(
        "t2",
        f"""with {SERIES_SQL} select cast(isodow(date) - 1 as int) as day_of_week, dayname(date) as day_name,
        {_MEANS} from series group by 1, 2""",
    ),
)
def ts_dow_patterns(spark, folder):
    return shaped(ts.week_day_pattern(_series(spark, folder)), transaction_value=4)


@named(
    "ts_monthly",
    with_views(
        "t2",
        f"""with {SERIES_SQL} select cast(year(date) as int) as year, cast(month(date) as int) as month,
        monthname(date) as month_name, cast(sum(n) as bigint) as transaction_count,
        round(sum(v), 2) as transaction_value, round(avg(a), 6) as avg_transaction_value,
        cast(count(*) as bigint) as days, round(sum(n) / count(*), 6) as daily_avg_count,
        round(sum(v) / count(*), 4) as daily_avg_value,
        concat(monthname(date), ' ', cast(year(date) as varchar)) as month_year
        from series group by year(date), month(date), monthname(date)""",
    ),
)
def ts_monthly(spark, folder):
    return shaped(ts.monthly_pattern(_series(spark, folder)), transaction_value=2, daily_avg_value=4)


@named(
    "ts_month_avg",
    with_views(
        "t2",
        f"""with {SERIES_SQL} select cast(month(date) as int) as month, monthname(date) as month_name,
        {_MEANS} from series group by 1, 2""",
    ),
)
def ts_month_avg(spark, folder):
    return shaped(ts.month_of_year_pattern(_series(spark, folder)), transaction_value=4)


@named(
    "ts_weekly",
    with_views(
        "t2",
        f"""with {SERIES_SQL}, {WEEKS_SQL} select cast(week_end as varchar) as week_end, n as transaction_count,
        round(v, 2) as transaction_value, round(a, 6) as avg_transaction_value from weeks""",
    ),
)
def ts_weekly(spark, folder):
    return shaped(ts.weekly(_series(spark, folder)), **_DAYS_MONEY)


@named(
    "ts_weekly_trend",
    with_views(
        "t2",
        f"""with {SERIES_SQL}, {WEEKS_SQL},
        pos as (select *, row_number() over (order by week_end) as i, count(*) over () as total from weeks),
        sized as (select *, least(12, total // 4) as w from pos),
        framed as (select *, i - (w - 1 - (w - 1) // 2) as a1, i + (w - 1) // 2 as b1 from sized),
        smooth as (select f.week_end, f.n, f.v, f.a, f.w, count(p.i) as got, avg(p.n) as tc, avg(p.v) as tv
                   from framed f left join pos p on f.w > 0 and p.i between f.a1 and f.b1
                   group by f.week_end, f.n, f.v, f.a, f.w)
        select cast(week_end as varchar) as week_end, n as transaction_count, round(v, 2) as transaction_value,
               round(a, 6) as avg_transaction_value,
               round(case when got = w and w > 0 then tc end, 6) as trend_count,
               round(case when got = w and w > 0 then tv end, 4) as trend_value from smooth""",
    ),
)
def ts_weekly_trend(spark, folder):
    trend = ts.weekly_trend(ts.weekly(_series(spark, folder)))
    return shaped(trend, transaction_value=2, trend_value=4)


@named(
    "ts_decompose_weekly",
    with_views(
        "t2",
        f"""with {SERIES_SQL}, {WEEKS_SQL},
        pos as (select week_end, cast(n as double) as observed, row_number() over (order by week_end) - 1 as i,
                       count(*) over () as total from weeks),
        kept as (select * from pos where total >= 104),
        tr as (select k.week_end, k.observed, k.i,
                 case when count(o.i) = 53 then sum(o.observed * case when abs(o.i - k.i) = 26 then 0.5 else 1 end)
                   / 52 end as trend
               from kept k left join kept o on o.i between k.i - 26 and k.i + 26
               group by k.week_end, k.observed, k.i),
        ph as (select i % 52 as phase, avg(observed - trend) as m from tr group by 1),
        se as (select phase, m - (select avg(m) from ph) as seasonal from ph)
        select cast(week_end as varchar) as week_end, observed, round(trend, 6) as trend,
               round(seasonal, 6) as seasonal, round(observed - trend - seasonal, 6) as residual
        from tr join se on tr.i % 52 = se.phase""",
    ),
)
def ts_decompose_weekly(spark, folder):
    return shaped(ts.decompose(ts.weekly(_series(spark, folder))))


@named(
    "ingest_pending_dates",
    with_views(
        "t2",
        """with days as (select cast(timestamp as date) as date, status from t2),
        spine as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
                  from days),
        done as (select distinct date from days where status <> 'P'),
        checked as (select date from days group by date having bool_and(status = 'F'))
        select cast(date as varchar) as date, 'ingest' as step from spine where date not in (select date from done)
        union all
        select cast(date as varchar), 'validate' from done
        where date in (select date from spine) and date not in (select date from checked)""",
    ),
)
def ingest_pending_dates(spark, folder):
    """Days to ingest and days to validate.

    A day counts as ingested when it has an order that is not pending and as
    validated when all its orders are finished.
    """
    from spendscope.sources.ingest import pending_dates

    days = with_date(order_years(spark, folder))
    completed = days.where(F.col("status") != "P").select("date").distinct()
    validated = (
        days.groupBy("date").agg(F.bool_and(F.col("status") == "F").alias("ok")).where("ok").select("date")
    )
    return shaped(pending_dates(ts.date_spine(days), completed, validated))
