"""Shape of the physical plans."""

import pytest

from spendscope.operators import cleaning, dedup, features, profiling, risk
from spendscope.plans import models_queries
from spendscope.plans.registry import catalogue
from spendscope.sources.fixtures import card_month, dirty_month, merchant_lines, table

# These write files or fit models while they are built.
EAGER = ("scan_", "file_", "sink_", "stream_", "ingest_", "ml_", "cluster", "enrich_cluster", "insight_cluster",
         "analysis_table", "basic_summary", "anomaly_isolation", "insight_cluster", "profile_by_file", "join_merchant_ref_csv",
          "risk_distribution_with", "suspicious_report_with")
LAZY = [n for n in catalogue() if not n.startswith(EAGER)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(name, spark, folder):
    plan = plan_of(catalogue()[name].build(spark, folder))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in plan


def test_repeats_are_dropped_before_the_shuffle(spark, folder):
    plan = plan_of(dedup.keep_first(merchant_lines(spark, folder), "transaction_id", ["timestamp"]))
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan[plan.index("Exchange hashpartitioning(transaction_id") :]


def test_rankings_are_limited_before_the_shuffle(spark, folder):
    counts = profiling.value_counts(dirty_month(spark, folder), ["merchant_name", "transaction_id"])
    assert plan_of(profiling.ends_by_count(counts)).count("WindowGroupLimit") >= 4
    assert "WindowGroupLimit" in plan_of(features.home_countries(merchant_lines(spark, folder)))


def test_only_needed_columns_are_read(spark, folder):
    plan = plan_of(catalogue()["agg_daily_recent"].build(spark, folder))
    assert "o_orderpriority" not in plan and "c_mktsegment" not in plan
    plan = plan_of(cleaning.with_target(card_month(spark, folder), "amount").select("amount"))
    assert "IsNotNull(value)" in plan


def test_filters_reach_the_scan(spark, folder):
    plan = plan_of(table(spark, folder, "lineitem").where("l_quantity > 49").select("l_orderkey"))
    assert "GreaterThan(l_quantity,49.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_risk_totals_do_not_join_transactions(spark, folder):
    """Rows are counted per cell before user facts are joined."""
    plan = plan_of(risk.risk_cells(card_month(spark, folder)))
    assert "LeftAnti" not in plan and "transaction_id" not in plan


def test_high_values_join_the_lines_once(spark, folder):
    """The quantile and the flags read the settled lines."""
    assert "Join" not in plan_of(catalogue()["feat_high_value_p95"].build(spark, folder))


def test_the_forest_joins_the_lines_once(spark, folder):
    """Sample, quantile and flags read the settled lines."""
    assert "l_orderkey" not in plan_of(catalogue()["anomaly_isolation_forest_lines"].build(spark, folder))


def test_ridge_joins_the_lines_once(spark, folder, monkeypatch):
    """The lines are settled before the user facts read them twice."""
    seen, plain = [], models_queries.regression.prediction_features
    monkeypatch.setattr(models_queries.regression, "prediction_features", lambda rows: seen.append(rows) or plain(rows))
    catalogue()["ml_ridge_predict_lines"].build(spark, folder)
    assert len(seen) == 1 and "Join" not in plan_of(seen[0])
