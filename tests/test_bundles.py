import pytest

from spendscope.operators import aggregates, risk
from spendscope.plans import bundles
from spendscope.sources.fixtures import card_month, merchant_lines, order_years


def rows_of(df):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_cube_gives_the_direct_figures(spark, folder):
    rows = merchant_lines(spark, folder)
    found = bundles.basic(rows)
    direct = {
        "daily_metrics": aggregates.daily(rows),
        "hourly_pattern": aggregates.hourly(rows),
        "category_metrics": aggregates.top_categories(rows),
        "online_metrics": aggregates.by_channel(rows),
        "top_merchants_count": aggregates.top_merchants_by_count(rows),
        "top_merchants_value": aggregates.top_merchants_by_value(rows),
    }
    assert found.keys() == direct.keys()
    for name, expected in direct.items():
        assert rows_of(found[name]) == rows_of(expected), name


def test_anomalies_agree_with_rows(spark, folder):
    rows = card_month(spark, folder)
    found = bundles.anomalies(rows)
    scores = risk.add_risk_score(rows).groupBy("risk_score").count().collect()
    assert {r["risk_score"]: r["row_count"] for r in found["risk_score_distribution"].collect()} == {
        r["risk_score"]: r["count"] for r in scores
    }
    share = found["high_risk_share"].first()
    suspicious = found["suspicious_transactions"].collect()
    assert len(suspicious) == min(1000, share["suspicious_count"])
    assert all(r["risk_score"] >= risk.SUSPICIOUS for r in suspicious)


@pytest.mark.parametrize("bundle", [bundles.geographic, bundles.segmentation])
def test_bundles_have_rows(spark, folder, bundle):
    for name, table in bundle(card_month(spark, folder)).items():
        assert table.count() > 0, name


def test_seasonal(spark, folder):
    found = bundles.seasonal(order_years(spark, folder))
    assert found["dow_patterns"].count() == 7 and found["month_avg_patterns"].count() == 12
    assert found["weekly_trend"].count() == found["decomposition"].count() >= 104


def test_modelling(spark, folder):
    found = bundles.modelling(card_month(spark, folder), clusters=3)
    assert found["cluster_profile"].count() == 3
    assert found["regression_metrics"].first()["test_rows"] == found["predictions"].count() > 0
    assert found["residual_histogram"].agg({"row_count": "sum"}).first()[0] == found["predictions"].count()
