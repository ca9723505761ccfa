"""Numbers behind the insight texts."""

from __future__ import annotations

from spendscope.operators import insights
from spendscope.plans.geography_queries import cross_border_sql
from spendscope.plans.registry import named
from spendscope.plans.risk_queries import CATEGORY_SQL, SCORED_SQL
from spendscope.plans.shape import shaped
from spendscope.plans.timeseries_queries import SERIES_SQL
from spendscope.sources.fixtures import card_month, order_years, with_views


@named(
    "insight_top_geo",
    with_views(
        "t1",
        """select 'country' as kind, cast(row_number() over (order by count(*) desc, location_country) as int)
                  as position, location_country as label, cast(count(*) as double) as measure
           from t1 where location_country is not null group by location_country
           qualify row_number() over (order by count(*) desc, location_country) <= 5
           union all
           select 'city', cast(row_number() over (order by count(*) desc, location_country, location_city) as int),
                  location_city, cast(count(*) as double)
           from t1 where location_country is not null and location_city is not null
           group by location_country, location_city
           qualify row_number() over (order by count(*) desc, location_country, location_city) <= 5""",
    ),
)
def insight_top_geo(spark, folder):
    return insights.top_places(card_month(spark, folder))


@named(
    "insight_cross_border_pct",
    with_views(
        "t1",
        f"""with cb as ({cross_border_sql('t1')})
        select cast(coalesce(sum(transaction_count) filter (is_cross_border), 0) as bigint) as cross_border_count,
               cast(sum(transaction_count) as bigint) as transaction_count,
               round(sum(transaction_count) filter (is_cross_border) * 100.0 / sum(transaction_count), 6)
                 as cross_border_pct from cb""",
    ),
)
def insight_cross_border_pct(spark, folder):
    return shaped(insights.cross_border_percent(card_month(spark, folder)))


@named(
    "insight_peaks",
    with_views(
        "t2",
        f"""with {SERIES_SQL},
        d as (select dayname(date) as label, isodow(date) as o, avg(n) as measure from series group by 1, 2),
        m as (select monthname(date) as label, month(date) as o, avg(n) as measure from series group by 1, 2),
        r as (select 'peak day' as kind, row_number() over (order by measure desc, o) as p, label, measure from d
              union all select 'peak month', row_number() over (order by measure desc, o), label, measure from m
              union all select 'low month', row_number() over (order by measure, o), label, measure from m)
        select kind, cast(p as int) as position, label, round(measure, 6) as measure from r where p <= 2""",
    ),
)
def insight_peaks(spark, folder):
    return shaped(insights.peaks(order_years(spark, folder)))


@named(
    "insight_risk",
    with_views(
        "t1",
        f"""with {SCORED_SQL}, cat as ({CATEGORY_SQL})
        select 'high risk percent' as kind, 1 as position, 'all' as label,
               round(count(*) filter (risk_score >= 3) * 100.0 / count(*), 6) as measure from scored
        union all
        select 'suspicious count', 1, 'all', cast(count(*) filter (risk_score >= 4) as double) from scored
        union all
        select 'risky category', cast(row_number() over (order by high_risk_pct desc, merchant_category) as int),
               merchant_category, round(high_risk_pct, 6) from cat
        qualify row_number() over (order by high_risk_pct desc, merchant_category) <= 3""",
    ),
)
def insight_risk(spark, folder):
    return shaped(insights.risk_summary(card_month(spark, folder)))
