"""Countries, cities and borders."""

from __future__ import annotations

from spendscope.operators import geography as geo
from spendscope.plans.features_queries import HOME_SQL
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.sources.fixtures import card_month, dirty_month, merchant_lines, with_views

_PLACE_SQL = """select {keys}, cast(count(*) as bigint) as transaction_count,
  round(coalesce(sum(amount), 0), 2) as transaction_value,
  round(coalesce(sum(amount), 0) / count(*), 6) as avg_transaction_value
  from t1 where {present} group by {keys} order by transaction_count desc, {keys} limit {k}"""


@named(
    "geo_country_metrics",
    with_views(
        "t1", _PLACE_SQL.format(keys="location_country", present="location_country is not null", k=20)
    ),
)
def geo_country_metrics(spark, folder):
    return shaped(geo.country_figures(card_month(spark, folder)), transaction_value=2)


@named(
    "geo_country_top50",
    with_views(
        "t1", _PLACE_SQL.format(keys="location_country", present="location_country is not null", k=50)
    ),
)
def geo_country_top50(spark, folder):
    return shaped(geo.country_figures(card_month(spark, folder), 50), transaction_value=2)


@named(
    "geo_city_metrics",
    with_views(
        "t1",
        _PLACE_SQL.format(
            keys="location_country, location_city",
            present="location_country is not null and location_city is not null",
            k=50,
        ),
    ),
)
def geo_city_metrics(spark, folder):
    return shaped(geo.city_figures(card_month(spark, folder)), transaction_value=2)


def cross_border_sql(view: str) -> str:
    return f"""with {HOME_SQL.format(source=view)},
    flagged as (select *, location_country is distinct from home_country as is_cross_border
                from {view} left join home using (user_id)),
    g as (select is_cross_border, count(transaction_id) as n, coalesce(sum(amount), 0) as v, avg(amount) as a
          from flagged group by is_cross_border)
    select is_cross_border, case when is_cross_border then 'Cross-Border' else 'Domestic' end
             as transaction_type, cast(n as bigint) as transaction_count, round(v, 2) as transaction_value,
           round(a, 6) as avg_transaction_value, round(n * 100.0 / sum(n) over (), 6) as count_share_pct,
           round(v * 100.0 / sum(v) over (), 6) as value_share_pct from g"""


@named("geo_cross_border", with_views("t1", cross_border_sql("t1")))
def geo_cross_border(spark, folder):
    return shaped(geo.cross_border_figures(card_month(spark, folder)), transaction_value=2)


@named("geo_cross_border_dirty", with_views("t1raw", cross_border_sql("t1raw")))
def geo_cross_border_dirty(spark, folder):
    return shaped(geo.cross_border_figures(dirty_month(spark, folder)), transaction_value=2)


@named("geo_cross_border_lines", with_views("t3", cross_border_sql("t3")))
def geo_cross_border_lines(spark, folder):
    return shaped(geo.cross_border_figures(merchant_lines(spark, folder)), transaction_value=2)
