import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from spendscope.operators import clustering as cl
from spendscope.operators import forest, regression, risk
from spendscope.operators.users import FEATURE_COLUMNS, model_rows, user_features
from spendscope.session import settle
from spendscope.sources.fixtures import card_month


@pytest.fixture(scope="module")
def rows(spark, folder):
    return settle(card_month(spark, folder))


@pytest.fixture(scope="module")
def users(rows):
    return settle(user_features(model_rows(rows)))


@pytest.fixture(scope="module")
def prediction(rows):
    return settle(regression.prediction_features(rows))


def test_scaled_columns(users):
    scaled = cl.scale(users).toPandas().set_index("user_id")
    np.testing.assert_allclose(scaled.mean(), 0, atol=1e-9)
    spread = scaled.std(ddof=0)
    assert all(np.isclose(s, 1) or np.isclose(s, 0) for s in spread)


def test_every_user_gets_one_of_k_clusters_ordered_by_spend(users):
    fitted = cl.with_clusters(users, cl.fit_clusters(users, 3))
    assert fitted.count() == users.count()
    profile = cl.profile(fitted).toPandas()
    assert list(profile["cluster"]) == [0, 1, 2]
    assert profile["size"].sum() == users.count()
    assert profile["total_spend"].is_monotonic_increasing
    np.testing.assert_allclose(profile["size_pct"].sum(), 100)
    flat = cl.normalised_profile(cl.profile(fitted)).toPandas()
    assert flat["total_spend"].min() == 0 and flat["total_spend"].max() == 1


def test_elbow(users):
    found = cl.elbow(users, 5).toPandas()
    assert list(found["k"]) == [2, 3, 4, 5] and found["is_suggested"].sum() == 1
    assert (found["inertia"].diff().dropna() < found["inertia"].iloc[0] * 0.05).all()
    # changes -50, -20, -5 of the cost: ratios -0.6 and -0.75, so the first is larger
    assert cl.suggested_size([2, 3, 4, 5], [100, 50, 30, 25]) == 3


def test_medians_fill_gaps(spark, users):
    holed = users.withColumn("std_transaction_amount", F.when(F.col("active_days") > 1, F.col("std_transaction_amount")))
    holed = holed.withColumn("avg_day_of_week", F.lit(None).cast("double"))
    filled = cl.fill_with_medians(holed).toPandas()
    assert filled["std_transaction_amount"].notna().all() and (filled["avg_day_of_week"] == 0).all()


def test_projection_is_centred_and_uncorrelated(users):
    scores = cl.project(users).toPandas()
    matrix = users.select(*FEATURE_COLUMNS).toPandas().to_numpy(float)
    centred = matrix - matrix.mean(axis=0)
    singular = np.linalg.svd(centred, compute_uv=False)
    np.testing.assert_allclose(scores[["pc1", "pc2"]].mean(), 0, atol=1e-6)
    np.testing.assert_allclose((scores["pc1"] ** 2).sum(), singular[0] ** 2, rtol=1e-6)
    assert abs(np.corrcoef(scores["pc1"], scores["pc2"])[0, 1]) < 1e-6


def test_ridge_matches_the_closed_form(prediction):
    alpha = 3.0
    ridge = regression.fit_ridge(prediction, alpha)
    training = prediction.where(~F.col("is_test"))
    pdf = ridge.encoder.encode(training).select("target", vector_to_array("features").alias("x")).toPandas()
    x, y = np.vstack(pdf["x"]), pdf["target"].to_numpy()
    xc = x - x.mean(axis=0)
    expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    np.testing.assert_allclose(ridge.model.coefficients.toArray(), expected, atol=1e-6)
    assert len(ridge.encoder.names) == x.shape[1]
    assert {"month", "year"} == set(ridge.encoder.constant)


def test_both_ridge_solvers_minimise_the_same_sum(prediction):
    tests = prediction.where("is_test")
    one, two = (
        regression.fit_ridge(prediction, solver=s).predict(tests).select("transaction_id", F.col("prediction").alias(s[0]))
        for s in ("normal", "l-bfgs")
    )
    gap = one.join(two, "transaction_id").agg(F.max(F.abs(F.col("n") - F.col("l")))).first()[0]
    assert gap < 1e-3


def test_regression_figures(spark, prediction):
    ridge = regression.fit_ridge(prediction)
    found = settle(ridge.predict(prediction.where("is_test")))
    pdf = found.toPandas()
    row = regression.evaluate(found).first()
    error = pdf["target"] - pdf["prediction"]
    np.testing.assert_allclose(row["rmse"], np.sqrt((error**2).mean()))
    np.testing.assert_allclose(row["mae"], error.abs().mean())
    np.testing.assert_allclose(row["r2"], 1 - (error**2).sum() / ((pdf["target"] - pdf["target"].mean()) ** 2).sum())
    bars = regression.residual_histogram(found).orderBy("bin").toPandas()
    np.testing.assert_array_equal(bars["row_count"], np.histogram(error, 30)[0])
    top = ridge.importance(spark).toPandas()
    assert len(top) <= 20 and top["importance"].is_monotonic_decreasing


def test_unseen_categories_are_all_zeros(spark, prediction):
    encoder = regression.fit_encoder(prediction.where(~F.col("is_test")))
    odd = prediction.limit(1).withColumn("currency", F.lit("never seen"))
    vector = encoder.encode(odd).select(vector_to_array("features").alias("x")).first()["x"]
    places = [i for i, n in enumerate(encoder.names) if n.startswith("currency_")]
    assert places and all(vector[i] == 0 for i in places)


def test_leak_free_statistics_use_training_rows_only(rows):
    features = regression.prediction_features(rows, leak_free=True).toPandas()
    user = rows.select("transaction_id", "user_id", "amount").toPandas().merge(features, on="transaction_id")
    training = user[~user["is_test"]].groupby("user_id")["amount"].mean()
    joined = user.set_index("user_id").join(training.rename("expected")).dropna()
    np.testing.assert_allclose(joined["user_avg_amount"], joined["expected"])


def test_forest_flags_about_one_percent_and_repeats(spark, rows):
    first = forest.flag_isolated(rows, trees=20).select("transaction_id", "amount", "ml_score", "is_ml_anomaly")
    again = forest.flag_isolated(rows.repartition(7), trees=20).select("transaction_id", "ml_score", "is_ml_anomaly")
    a = first.toPandas().set_index("transaction_id").sort_index()
    b = again.toPandas().set_index("transaction_id").sort_index()
    assert a["ml_score"].equals(b["ml_score"]) and a["is_ml_anomaly"].equals(b["is_ml_anomaly"])
    assert 0.002 <= a["is_ml_anomaly"].mean() <= 0.01
    assert a["ml_score"].between(0, 1).all()
    flagged = a[a["is_ml_anomaly"] == 1]
    assert flagged["amount"].mean() > 2 * a["amount"].mean()


def test_forest_with_disjoint_samples_and_missing_features(spark):
    table = spark.range(3000).selectExpr(
        "cast(id as string) as transaction_id", "if(id = 7, null, if(id = 5, 1e6D, rand(1) * 100)) as amount",
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id % 24)) as timestamp",
    )
    table = settle(table)
    featured = forest.with_forest_features(table)
    samples, per_tree = forest._samples(featured, "transaction_id", ["amount", "hour"], 10, 256, 1)
    counts = [r["count"] for r in samples.groupBy("tree").count().collect()]
    assert per_tree == 256 and counts == [256] * 10
    assert samples.select("transaction_id").distinct().count() == 2560
    scored = featured.withColumn("s", forest.fit_forest(featured, trees=10).score()).toPandas()
    assert scored["s"].isna().sum() == 1
    assert scored.set_index("transaction_id")["s"]["5"] > scored["s"].quantile(0.9)


def test_scores_are_those_of_a_plain_walk_through_the_trees(rows):
    """Depth by depth for one row at a time, as the published method has it."""
    featured = forest.with_forest_features(rows)
    grown = forest.fit_forest(featured, trees=15, sample=64)
    roots, feature, split, left, right, path, norm = grown.arrays.value
    found = featured.select("amount", "hour", grown.score().alias("score")).limit(200).collect()
    for r in found:
        total = 0.0
        for at in roots:
            while feature[at] >= 0:
                at = left[at] if float(r[int(feature[at])]) <= split[at] else right[at]
            total += path[at]
        assert r["score"] == pytest.approx(2 ** (-total / len(roots) / norm), rel=1e-12)


def test_scaling_leaves_scores_as_they_are(rows):
    plain, scaled = (
        {r["transaction_id"]: r["ml_score"] for r in forest.flag_isolated(rows, trees=20, scaled=on).collect()} for on in (False, True)
    )
    assert plain.keys() == scaled.keys() and all(abs(scaled[k] - v) < 1e-9 for k, v in plain.items() if v is not None)


def test_mean_path():
    assert forest.mean_path(1) == 0 and forest.mean_path(2) == 1
    np.testing.assert_allclose(forest.mean_path(256), 10.2448, atol=1e-3)


def test_forest_flag_adds_two_points(rows):
    flagged = rows.withColumn("is_ml_anomaly", F.lit(1))
    plain = risk.add_risk_score(rows).select("transaction_id", "risk_score").toPandas().set_index("transaction_id")
    more = risk.add_risk_score(flagged).select("transaction_id", "risk_score").toPandas().set_index("transaction_id")
    assert ((more["risk_score"] - plain["risk_score"]) == 2).all()
    cells = risk.risk_distribution(risk.risk_cells(flagged)).toPandas().set_index("risk_score")["row_count"]
    assert cells.to_dict() == more["risk_score"].value_counts().to_dict()


def test_scores_are_those_of_the_trees(spark):
    """Scores by cells of ranks are what each row gets on its way down every tree, on splits and without a value too."""
    i = F.col("id")
    rows = spark.range(3000).select(
        i.cast("string").alias("transaction_id"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("a"),
        F.when(i % 50 > 0, F.sin("id")).alias("b"), (i % 7).cast("double").alias("c"),
    )
    grown = forest.fit_forest(rows, ("a", "b", "c"), trees=9, sample=64)
    roots, feature, split, left, right, path, norm = grown.arrays.value
    on_split = float(split[feature == 0][0])
    rows = rows.withColumn("a", F.when(F.col("transaction_id") % 11 == 0, on_split).otherwise(F.col("a"))).repartition(3)
    for row in rows.withColumn("s", grown.score()).collect():
        if row["b"] is None:
            assert row["s"] is None
            continue
        depths = []
        for at in roots:
            while feature[at] >= 0:
                at = left[at] if row["abc"[int(feature[at])]] <= split[at] else right[at]
            depths.append(path[at])
        assert abs(row["s"] - 2 ** (-sum(depths) / len(roots) / norm)) < 1e-12
