"""Model features, clusters, regression and the isolation forest."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from spendscope.operators import clustering as cl
from spendscope.operators import forest, regression, risk, users
from spendscope.plans.checked_queries import USERS_SQL
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.session import settle
from spendscope.sources.fixtures import card_month, dirty_month, merchant_lines, parsed, with_views

CLUSTERS = 4


def _user_table(spark, folder):
    """User features, settled: every model here reads them several times."""
    return settle(users.user_features(users.model_rows(card_month(spark, folder))), "features")


def _clustered(spark, folder):
    table = _user_table(spark, folder)
    return cl.with_clusters(table, cl.fit_clusters(table, CLUSTERS))


_SCALED_SQL = f"with {USERS_SQL.strip()} select user_id, " + ", ".join(
    f"round(({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1), 6) + 0.0 as {c}"
    for c in users.FEATURE_COLUMNS
) + " from labelled"


@named("ml_scaled_features", with_views("t1", _SCALED_SQL))
def ml_scaled_features(spark, folder):
    return shaped(cl.scale(_user_table(spark, folder)))


@named("ml_elbow")
def ml_elbow(spark, folder):
    return shaped(cl.elbow(_user_table(spark, folder)))


@named("ml_kmeans_assign")
def ml_kmeans_assign(spark, folder):
    return cl.fit_clusters(_user_table(spark, folder), CLUSTERS).users


@named("cluster_profile")
def cluster_profile(spark, folder):
    return shaped(cl.profile(_clustered(spark, folder)))


@named("cluster_profile_normalized")
def cluster_profile_normalized(spark, folder):
    return shaped(cl.normalised_profile(cl.profile(_clustered(spark, folder))))


@named("cluster_distribution")
def cluster_distribution(spark, folder):
    return shaped(cl.distributions(_clustered(spark, folder)))


@named("insight_cluster_payload")
def insight_cluster_payload(spark, folder):
    return cl.payload(shaped(cl.profile(_clustered(spark, folder))))


@named("enrich_cluster")
def enrich_cluster(spark, folder):
    table = _user_table(spark, folder)
    labels = cl.fit_clusters(table, CLUSTERS).users
    rows = users.enrich_with_cluster(card_month(spark, folder), labels)
    return rows.select("transaction_id", "user_id", "cluster")


@named("ml_pca_2d")
def ml_pca_2d(spark, folder):
    return shaped(cl.project(_user_table(spark, folder)))


_HASH_SQL = "cast('0x' || substr(md5(transaction_id), 1, 13) as bigint) % 100 < 20"


@named(
    "ml_split",
    with_views("t1", f"select transaction_id, {_HASH_SQL} as is_test from t1"),
)
def ml_split(spark, folder):
    return card_month(spark, folder).select("transaction_id", regression.is_test().alias("is_test"))


_STATS_SQL = """s as (select user_id, cast(count(transaction_id) as double) as n, avg(amount) as a
  from {source} where user_id is not null group by 1)"""
_FEATURES_SQL = """select transaction_id, {test} as is_test, round(amount, 4) as target, merchant_category,
  currency, location_country, device_type,
  case when hour(timestamp) <= 6 then 'Night' when hour(timestamp) <= 12 then 'Morning'
       when hour(timestamp) <= 18 then 'Afternoon' else 'Evening' end as time_of_day,
  cast(cast(is_online as int) as varchar) as is_online, cast(hour(timestamp) as double) as hour,
  cast(isodow(timestamp) - 1 as double) as day_of_week, cast(day(timestamp) as double) as day_of_month,
  cast(month(timestamp) as double) as month, cast(year(timestamp) as double) as year,
  case when isodow(timestamp) >= 6 then 1.0::double else 0.0::double end as is_weekend,
  n as user_transaction_count, round(a, 6) as user_avg_amount
  from t1 left join s using (user_id) where amount is not null"""


@named(
    "ml_prediction_features",
    with_views("t1", f"with {_STATS_SQL.format(source='t1')} {_FEATURES_SQL.format(test=_HASH_SQL)}"),
)
def ml_prediction_features(spark, folder):
    return shaped(regression.prediction_features(card_month(spark, folder)), target=4)


@named(
    "ml_prediction_features_leak_free",
    with_views(
        "t1",
        f"""with {_STATS_SQL.format(source=f'(select * from t1 where not ({_HASH_SQL}))')}
        {_FEATURES_SQL.format(test=_HASH_SQL)}""",
    ),
)
def ml_prediction_features_leak_free(spark, folder):
    features = regression.prediction_features(card_month(spark, folder), leak_free=True)
    return shaped(features, target=4)


@named(
    "ml_prediction_features_dirty",
    with_views(
        "t1raw",
        f"""with rows as (select * exclude (timestamp), try_cast(timestamp as timestamp) as timestamp from t1raw),
        {_STATS_SQL.format(source='rows')}
        select transaction_id, file_seq, round(amount, 4) as target, coalesce(location_country, 'missing') as location_country,
          coalesce(cast(hour(timestamp) as double), -1) as hour,
          case when isodow(timestamp) >= 6 then 1.0::double else 0.0::double end as is_weekend,
          n as user_transaction_count, round(a, 6) as user_avg_amount
        from rows left join s using (user_id) where amount is not null""",
    ),
)
def ml_prediction_features_dirty(spark, folder):
    """Amounts are missing here: such rows count for the user and are not predicted."""
    rows = parsed(dirty_month(spark, folder)).withColumn("transaction_id", F.concat_ws("/", "transaction_id", "file_seq"))
    found = regression.prediction_features(rows).withColumn("_id", F.split("transaction_id", "/"))
    return shaped(
        found.select(
            F.col("_id")[0].alias("transaction_id"), F.col("_id")[1].cast("int").alias("file_seq"), "target", "location_country",
            F.coalesce("hour", F.lit(-1.0)).alias("hour"), "is_weekend", "user_transaction_count", "user_avg_amount",
        ),
        target=4,
    )


def _features(spark, folder):
    """The prediction table, settled: fitting and scoring pass over it several times."""
    return settle(regression.prediction_features(card_month(spark, folder)), "prediction")


def _test_predictions(features):
    ridge = regression.fit_ridge(features)
    return ridge.predict(features.where(F.col("is_test")))


_ENCODED_NUMBERS = ("hour", "day_of_week", "day_of_month", "month", "year", "is_weekend", *regression.USER_NUMBERS)


def _encoded_sql() -> str:
    """Sizes and sums of the vectors from counts, means and deviations of the training rows."""
    numbers, texts = _ENCODED_NUMBERS, regression.CATEGORIES
    levels = ", ".join(f"list(distinct {c}) as {c}_levels" for c in texts)
    moments = ", ".join(f"avg({c}) as {c}_mean, stddev_pop({c}) as {c}_std" for c in numbers)
    hot = [f"case when len({c}_levels) > 1 and list_contains({c}_levels, {c}) then 1 else 0 end" for c in texts]
    scaled = [f"case when {c}_std > 0 then ({c} - {c}_mean) / {c}_std else 0 end" for c in numbers]
    wide = [f"case when len({c}_levels) > 1 then len({c}_levels) else 0 end" for c in texts]
    wide += [f"case when {c}_std > 0 then 1 else 0 end" for c in numbers]
    filled = hot + [f"case when {x} <> 0 then 1 else 0 end" for x in scaled]
    features = _FEATURES_SQL.format(test=_HASH_SQL).replace("round(a, 6)", "a")
    return f"""with {_STATS_SQL.format(source='t1')}, f as ({features}),
      seen as (select {levels}, {moments} from f where not is_test)
      select transaction_id, cast({' + '.join(wide)} as int) as feature_count, cast({' + '.join(filled)} as int) as filled_count,
             round({' + '.join(hot + scaled)}, 6) + 0.0 as feature_sum from f, seen"""


@named("ml_encoded_features", with_views("t1", _encoded_sql()))
def ml_encoded_features(spark, folder):
    features = _features(spark, folder)
    encoder = regression.fit_encoder(features.where(~F.col("is_test")))
    vector = vector_to_array("features")
    return encoder.encode(features).select(
        "transaction_id",
        F.size(vector).alias("feature_count"),
        F.size(F.filter(vector, lambda x: x != 0)).alias("filled_count"),
        (F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 6) + F.lit(0.0)).alias("feature_sum"),
    )


@named("ml_ridge_predict")
def ml_ridge_predict(spark, folder):
    return shaped(_test_predictions(_features(spark, folder)))


@named("ml_ridge_predict_lines")
def ml_ridge_predict_lines(spark, folder):
    """On a table without currency: the model takes the columns there are."""
    lines = settle(regression.used(merchant_lines(spark, folder)), "lines")  # read for the users and for the features
    features = settle(regression.prediction_features(lines), "prediction")
    return shaped(_test_predictions(features))


@named("ml_ridge_with_cluster")
def ml_ridge_with_cluster(spark, folder):
    table = _user_table(spark, folder)
    labels = cl.fit_clusters(table, CLUSTERS).users
    rows = users.enrich_with_cluster(card_month(spark, folder), labels)
    features = settle(regression.prediction_features(rows), "prediction")
    return shaped(regression.evaluate(_test_predictions(features)))


@named("ml_regression_metrics")
def ml_regression_metrics(spark, folder):
    return shaped(regression.evaluate(_test_predictions(_features(spark, folder))))


@named("ml_residual_histogram")
def ml_residual_histogram(spark, folder):
    return shaped(regression.residual_histogram(_test_predictions(_features(spark, folder))))


@named("ml_feature_importance")
def ml_feature_importance(spark, folder):
    return shaped(regression.fit_ridge(_features(spark, folder)).importance(spark))


@named("anomaly_isolation_forest")
def anomaly_isolation_forest(spark, folder):
    rows = forest.flag_isolated(card_month(spark, folder))
    return shaped(rows.select("transaction_id", "amount", "ml_score", "is_ml_anomaly"), amount=4)


@named("anomaly_isolation_forest_lines")
def anomaly_isolation_forest_lines(spark, folder):
    """Large enough for disjoint samples; with the day of the week as a third feature."""
    lines = merchant_lines(spark, folder).select("transaction_id", "amount", "timestamp")
    rows = forest.flag_isolated(lines, ("amount", "hour", "day_of_week"))
    return shaped(rows.select("transaction_id", "amount", "ml_score", "is_ml_anomaly"), amount=4)


@named("risk_distribution_with_forest")
def risk_distribution_with_forest(spark, folder):
    flagged = forest.flag_isolated(card_month(spark, folder)).drop("ml_score")
    return risk.risk_distribution(risk.risk_cells(flagged))


@named("suspicious_report_with_forest")
def suspicious_report_with_forest(spark, folder):
    flagged = forest.flag_isolated(card_month(spark, folder)).drop("ml_score")
    return shaped(risk.suspicious_report(flagged), amount=4)
