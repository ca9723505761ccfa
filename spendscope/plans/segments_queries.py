"""Recency, frequency and spend segments."""

from __future__ import annotations

from spendscope.operators import segments as seg
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.sources.fixtures import card_month, order_years, with_views

_MONEY = {"total_spend": 2}


def _users_sql(view: str) -> str:
    return f"""
base as (select user_id, count(transaction_id) as n, coalesce(sum(amount), 0) as v, avg(amount) as a,
                min(timestamp) as f, max(timestamp) as l from {view} where user_id is not null group by 1),
users as (select *, cast(floor(epoch((select max(timestamp) from {view}) - l) / 86400) as int) as recency_days,
                 cast(floor(epoch(l - f) / 86400) as int) + 1 as tenure_days from base)"""


def _edges_sql(name: str, measure: str) -> str:
    """Tertile edges by position, interpolated from the nearer neighbour."""
    parts = []
    for i, p in enumerate((0.0, 1 / 3, 2 / 3, 1.0)):
        spot = f"((n - 1) * {p * 100 / 100!r}e0)"
        low, high = (f"max(case when i = {f}({spot}) then x end)" for f in ("floor", "ceil"))
        t = f"max({spot} - floor({spot}))"
        parts.append(
            f"case when {t} < 0.5 then {low} + ({high} - {low}) * {t}"
            f" else {high} - ({high} - {low}) * (1 - {t}) end as e{i}"
        )
    return f"""{name} as (select {", ".join(parts)} from (
      select cast({measure} as double) as x, row_number() over (order by {measure}) - 1 as i,
             count(*) over () as n from users))"""


def _third_sql(measure: str, edge: str, names: tuple[str, str, str]) -> str:
    low, mid, high = names
    e = [f"{edge}.e{i}" for i in range(4)]
    tied = f"({e[0]} = {e[1]} or {e[1]} = {e[2]} or {e[2]} = {e[3]})"
    return f"""case when {e[0]} = {e[3]} then '{mid}'
      when {measure} <= case when {tied} then {e[0]} + ({e[3]} - {e[0]}) / 3 else {e[1]} end then '{low}'
      when {measure} <= case when {tied} then {e[0]} + ({e[3]} - {e[0]}) / 3 * 2 else {e[2]} end then '{mid}'
      else '{high}' end"""


_SPEND = ("v", "es", seg.SPEND_NAMES)
_FREQUENCY = ("n", "ef", seg.FREQUENCY_NAMES)
_RECENCY = ("recency_days", "er", seg.RECENCY_NAMES)


def _labelled_sql(view: str, select: str) -> str:
    return with_views(
        view,
        f"""with {_users_sql(view)}, {_edges_sql('es', 'v')}, {_edges_sql('ef', 'n')},
        {_edges_sql('er', 'recency_days')},
        labelled as (select *, {_third_sql(*_SPEND)} as spend_segment,
          {_third_sql(*_FREQUENCY)} as frequency_segment, {_third_sql(*_RECENCY)} as recency_segment
          from users, es, ef, er)
        {select}""",
    )


@named(
    "rfm_base",
    with_views(
        "t2",
        f"""with {_users_sql('t2')} select user_id, cast(n as bigint) as transaction_count,
        round(v, 2) as total_spend, round(a, 6) as avg_transaction, f as first_transaction,
        l as last_transaction from users""",
    ),
)
def rfm_base(spark, folder):
    return shaped(seg.user_base(order_years(spark, folder)), **_MONEY)


@named(
    "rfm_recency",
    with_views(
        "t2", f"with {_users_sql('t2')} select user_id, recency_days, tenure_days from users"
    ),
)
def rfm_recency(spark, folder):
    return seg.with_recency(order_years(spark, folder)).select("user_id", "recency_days", "tenure_days")


@named(
    "rfm_recency_month",
    with_views(
        "t1", f"with {_users_sql('t1')} select user_id, recency_days, tenure_days from users"
    ),
)
def rfm_recency_month(spark, folder):
    """With times of day: elapsed days, not calendar days."""
    return seg.with_recency(card_month(spark, folder)).select("user_id", "recency_days", "tenure_days")


@named(
    "rfm_spend_segment",
    _labelled_sql("t2", "select user_id, round(v, 2) as total_spend, spend_segment from labelled"),
)
def rfm_spend_segment(spark, folder):
    users = seg.segmented(order_years(spark, folder))
    return shaped(users.select("user_id", "total_spend", "spend_segment"), **_MONEY)


@named(
    "rfm_frequency_segment",
    _labelled_sql(
        "t2", "select user_id, cast(n as bigint) as transaction_count, frequency_segment from labelled"
    ),
)
def rfm_frequency_segment(spark, folder):
    users = seg.segmented(order_years(spark, folder))
    return users.select("user_id", "transaction_count", "frequency_segment")


@named(
    "rfm_recency_segment",
    _labelled_sql("t2", "select user_id, recency_days, recency_segment from labelled"),
)
def rfm_recency_segment(spark, folder):
    users = seg.segmented(order_years(spark, folder))
    return users.select("user_id", "recency_days", "recency_segment")


@named(
    "rfm_equal_width_fallback",
    _labelled_sql("t1", "select user_id, spend_segment, frequency_segment, recency_days, recency_segment from labelled"),
)
def rfm_equal_width_fallback(spark, folder):
    """Most users of one month are equally recent, so recency falls back to equal widths."""
    users = seg.segmented(card_month(spark, folder))
    return users.select(
        "user_id", "spend_segment", "frequency_segment", "recency_days", "recency_segment"
    )


@named(
    "rfm_segment_summary",
    _labelled_sql(
        "t2",
        """, grid as (select s as spend_segment, f as frequency_segment, r as recency_segment
             from (select unnest(['Low', 'Medium', 'High']) as s) a1,
                  (select unnest(['Low', 'Medium', 'High']) as f) b1,
                  (select unnest(['Recent', 'Moderate', 'Old']) as r) c1)
        select spend_segment, frequency_segment, recency_segment, cast(count(user_id) as bigint) as user_count,
               round(avg(v), 4) as avg_total_spend, round(avg(n), 6) as avg_transaction_count,
               round(avg(a), 6) as avg_transaction_size, round(avg(recency_days), 6) as avg_recency_days,
               round(avg(tenure_days), 6) as avg_tenure_days
        from grid left join labelled using (spend_segment, frequency_segment, recency_segment)
        group by 1, 2, 3""",
    ),
)
def rfm_segment_summary(spark, folder):
    summary = seg.segment_summary(seg.segmented(order_years(spark, folder)))
    return shaped(summary, avg_total_spend=4)
