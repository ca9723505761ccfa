"""How often operators read the rows they are given, by the records that Spark's stages report."""

import pytest
from pyspark.sql import functions as F

from spendscope.operators import features, insights, risk, users
from spendscope.session import fresh_path

N = 20_000


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    made = spark.range(N).select(
        i.cast("string").alias("transaction_id"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), i % 40)).alias("user_id"),
        (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100).alias("amount"),
        F.when(i % 50 == 0, None).otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)))).alias("location_country"),
        F.concat(F.lit("m"), i % 5).alias("merchant_category"),
        (i % 2 == 0).alias("is_online"),
        F.timestamp_seconds(1_700_000_000 + i * 977).cast("timestamp_ntz").alias("timestamp"),
    )
    path = fresh_path(spark, "rows")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def records_read(spark):
    sc = spark.sparkContext
    bus = sc._jsc.sc().listenerBus()
    bus.waitUntilEmpty(10_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).inputRecords() for k in range(stages.size())}


@pytest.mark.parametrize("operator", [
    risk.add_risk_score, risk.suspicious_report, insights.risk_summary,
    users.enrich_with_user_stats, features.add_unusual_location, features.add_cross_border,
])
def test_rows_are_read_twice_at_most(operator, spark, rows):
    before = records_read(spark)
    operator(rows).write.format("noop").mode("overwrite").save()
    after = records_read(spark)
    read = sum(n for stage, n in after.items() if stage not in before)
    assert N <= read <= 2.2 * N  # what was set aside in between is small here


def _shuffled(spark, before, df):
    """Records that stages write to shuffles while ``df`` is made."""
    df.write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in stage_figures(spark, "shuffleWriteRecords").items() if stage not in before)


def stage_figures(spark, figure):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): getattr(s, figure)() for s in map(stages.apply, range(stages.size()))}


def test_user_features_move_each_row_once(spark, rows):
    """Rows of users that one task can hold are not copied per column; counts of buckets and users come on top."""
    many = rows.withColumn("user_id", F.concat(F.lit("u"), F.floor(F.col("transaction_id") / 4)))
    many = many.withColumns({"merchant_id": F.col("transaction_id"), "device_type": F.col("location_country")})
    before = stage_figures(spark, "shuffleWriteRecords")
    moved = _shuffled(spark, before, users.user_features(users.model_rows(many)))
    assert N <= moved <= 2 * N


def test_users_of_many_rows_have_the_same_features(spark, rows):
    """What partial sums give is what all rows of a user give."""
    made = rows.withColumns({
        "user_id": F.when(F.col("transaction_id") % 1000 == 1, None).otherwise(F.col("user_id")),
        "merchant_id": F.concat(F.lit("m"), F.col("transaction_id") % 77),
        "device_type": F.when(F.col("transaction_id") % 3 > 0, F.concat(F.lit("d"), F.col("transaction_id") % 4)),
        "amount": F.when(F.col("transaction_id") % 13 > 0, F.col("amount")),
        "timestamp": F.when(F.col("transaction_id") % 17 > 0, F.col("timestamp")),
    })
    # hot_share 4: only the user of a third of the rows; 1 with a row limit above: none
    tables = [users.user_features(users.model_rows(made), "median", share) for share in (1, 4, 1_000_000)]
    found = [{r["user_id"]: r.asDict() for r in t.collect()} for t in tables]
    assert found[0].keys() == found[1].keys() == found[2].keys() and len(found[0]) == 41
    for other in found[1:]:
        for user, row in found[0].items():
            assert {k: v if isinstance(v, str | None) else pytest.approx(v, rel=1e-9) for k, v in row.items()} == other[user]
