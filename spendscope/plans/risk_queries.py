"""Anomalies and risk scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.operators import risk
from spendscope.plans.features_queries import HOME_SQL
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.sources.fixtures import card_month, with_views

_USERS_SQL = """
u as (select user_id, count(transaction_id) as n, sum(amount) as v, avg(amount) as a, max(amount) as m,
             coalesce(stddev_samp(amount), 0) as s from t1 where user_id is not null group by 1),
uq as (select round(quantile_cont(cast(n as double), 0.25), 9) as n1,
              round(quantile_cont(cast(n as double), 0.75), 9) as n3,
              quantile_cont(v, 0.25) as v1, quantile_cont(v, 0.75) as v3 from u),
uu as (select user_id, n, v, a, m, s, n > n3 + 1.5 * (n3 - n1) as hn, v > v3 + 1.5 * (v3 - v1) as hv from u, uq)
"""
_ZSCORE_SQL = """
st as (select avg(amount) as mean, stddev_samp(amount) as std from t1),
zs as (select *, abs((amount - mean) / std) as z from t1, st)
"""
SCORED_SQL = f"""
{_USERS_SQL.strip()}, {HOME_SQL.format(source='t1').strip()}, {_ZSCORE_SQL.strip()},
scored as (select zs.*, cast(
    case when z > 2 then 1 else 0 end + case when z > 3 then 1 else 0 end + case when z > 4 then 2 else 0 end
    + case when hour(timestamp) >= 23 or hour(timestamp) <= 4 then 1 else 0 end
    + case when hn or hv then 1 else 0 end + case when is_online then 1 else 0 end
    + case when location_country is distinct from home_country then 1 else 0 end as int) as risk_score
  from zs left join uu using (user_id) left join home using (user_id))
"""


@named(
    "anomaly_zscore",
    with_views(
        "t1",
        f"with {_ZSCORE_SQL} select transaction_id, round(z, 6) as amount_zscore, z > 3 as is_z_outlier from zs",
    ),
)
def anomaly_zscore(spark, folder):
    rows = risk.add_zscore(card_month(spark, folder))
    return shaped(rows.select("transaction_id", "amount_zscore", "is_z_outlier"))


@named(
    "anomaly_unusual_users",
    with_views(
        "t1",
        f"""with {_USERS_SQL} select user_id, cast(n as bigint) as transaction_count, round(v, 2) as total_amount,
        hn as high_transaction_count, hv as high_total_amount, hn or hv as is_unusual_user from uu""",
    ),
)
def anomaly_unusual_users(spark, folder):
    users = risk.unusual_users(card_month(spark, folder))
    return shaped(users.drop("avg_amount", "max_amount", "std_amount"), total_amount=2)


@named(
    "risk_score",
    with_views(
        "t1",
        f"with {SCORED_SQL} select transaction_id, round(z, 6) as amount_zscore, risk_score from scored",
    ),
)
def risk_score(spark, folder):
    rows = risk.add_risk_score(card_month(spark, folder))
    return shaped(rows.select("transaction_id", "amount_zscore", "risk_score"))


@named(
    "risk_distribution",
    with_views(
        "t1",
        f"with {SCORED_SQL} select risk_score, cast(count(*) as bigint) as row_count from scored group by 1",
    ),
)
def risk_distribution(spark, folder):
    return risk.risk_distribution(risk.risk_cells(card_month(spark, folder)))


CATEGORY_SQL = """select merchant_category, cast(count(*) filter (risk_score >= 3) as bigint) as high_risk_count,
  cast(count(*) as bigint) as total_count,
  round(count(*) filter (risk_score >= 3) / count(*) * 100, 6) as high_risk_pct
  from scored where merchant_category is not null group by 1 having count(*) >= 100"""


@named("risk_by_category", with_views("t1", f"with {SCORED_SQL} {CATEGORY_SQL}"))
def risk_by_category(spark, folder):
    return shaped(risk.risk_by_category(risk.risk_cells(card_month(spark, folder))))


@named(
    "risk_high_share",
    with_views(
        "t1",
        f"""with {SCORED_SQL} select cast(count(*) as bigint) as total_count,
        cast(count(*) filter (risk_score >= 3) as bigint) as high_risk_count,
        cast(count(*) filter (risk_score >= 4) as bigint) as suspicious_count,
        round(count(*) filter (risk_score >= 3) * 100.0 / count(*), 6) as high_risk_pct from scored""",
    ),
)
def risk_high_share(spark, folder):
    return shaped(risk.high_risk_share(risk.risk_cells(card_month(spark, folder))))


@named(
    "suspicious_report",
    with_views(
        "t1",
        f"""with {SCORED_SQL} select transaction_id, user_id, timestamp, round(amount, 4) as amount, risk_score,
        round(z, 6) as amount_zscore, merchant_id, merchant_category, location_country, location_city
        from scored where risk_score >= 4 order by scored.risk_score desc, z desc, transaction_id limit 1000""",
    ),
)
def suspicious_report(spark, folder):
    return shaped(risk.suspicious_report(card_month(spark, folder)), amount=4)


@named(
    "suspicious_report_domestic",
    with_views(
        "t1",
        f"""with {SCORED_SQL.replace("case when location_country is distinct from home_country then 1 else 0 end", "0")}
        select transaction_id, user_id, risk_score, round(z, 6) as amount_zscore
        from scored where risk_score >= 4 order by scored.risk_score desc, z desc, transaction_id limit 1000""",
    ),
)
def suspicious_report_domestic(spark, folder):
    """Without the cross-border factor."""
    report = risk.suspicious_report(card_month(spark, folder), use_cross_border=False)
    return shaped(report.select("transaction_id", "user_id", "risk_score", F.col("amount_zscore")))
