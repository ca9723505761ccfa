"""User clusters: scaling, k-means, the number of clusters, profiles and projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.operators import kmeans
from spendscope.operators.quantiles import one_row, quantiles
from spendscope.operators.users import FEATURE_COLUMNS
from spendscope.session import settle

SEED = 42
ONLINE_ABOVE, OFFLINE_BELOW = 0.7, 0.3


def fill_with_medians(users: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Nulls replaced by the exact median of their column; unchanged when there are none."""
    gaps = users.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    holes = [c for c in columns if gaps[c]]
    if not holes:
        return users
    long = users.select([F.col(c).cast("double").alias(c) for c in holes]).unpivot([], holes, "feature", "v")
    medians = quantiles(long, "v", {"m": 0.5}, ["feature"], few_groups=True).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(c) for c in holes]
    )
    return (
        users.withColumn("_medians", one_row(medians))
        .withColumns({c: F.coalesce(c, F.col("_medians")[c], F.lit(0.0)) for c in holes})
        .drop("_medians")
    )


def scale(users: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Columns shifted to mean 0 and divided by their population deviation (by 1 when that is 0)."""
    moments = users.agg(
        *[F.expr(f"avg({c}) as {c}_mean") for c in columns],
        *[F.expr(f"stddev_pop({c}) as {c}_std") for c in columns],
    )
    scaled = [
        f"({c} - _m.{c}_mean) / if(_m.{c}_std = 0, 1D, _m.{c}_std) as {c}" for c in columns
    ]
    return users.withColumn("_m", one_row(moments)).selectExpr("user_id", *scaled)


def _vectors(users: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    assembler = VectorAssembler(inputCols=list(columns), outputCol=name)
    return assembler.transform(users).select("user_id", name)


@dataclass(frozen=True)
class Clusters:
    users: DataFrame  # user_id, cluster
    cost: float
    centres: tuple[tuple[float, ...], ...]  # by cluster, in scaled features


def fit_clusters(users: DataFrame, k: int = 4, columns: Sequence[str] = FEATURE_COLUMNS) -> Clusters:
    """k-means on scaled features; clusters are numbered by the spend of their centre."""
    points = _vectors(scale(users, columns), columns)
    model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="_found").fit(points)
    order_by = list(columns).index("total_spend") if "total_spend" in columns else 0
    centres = model.clusterCenters()
    ranked = sorted(range(len(centres)), key=lambda c: (centres[c][order_by], *centres[c]))
    number = F.array(*[F.lit(ranked.index(c)) for c in range(len(centres))])
    labelled = model.transform(points).select(
        "user_id", F.element_at(number, F.col("_found") + 1).alias("cluster")
    )
    ordered = tuple(tuple(float(x) for x in centres[c]) for c in ranked)
    return Clusters(labelled, model.summary.trainingCost, ordered)


def fit_in_batches(users: DataFrame, k: int = 4, columns: Sequence[str] = FEATURE_COLUMNS, batch_rows: int = kmeans.BATCH_ROWS) -> Clusters:
    """As :func:`fit_clusters`, moving the centres by small batches of users instead of by all of them."""
    points = settle(scale(users, columns), "points")
    start = kmeans.first_centres(points, columns, [k])
    centres, costs = kmeans.in_batches(points, columns, start, batch_rows=batch_rows)
    order_by = list(columns).index("total_spend") if "total_spend" in columns else 0
    ordered = tuple(sorted((tuple(float(x) for x in c) for c in centres[k]), key=lambda c: (c[order_by], *c)))
    labels = kmeans.labelled(points, columns, ordered).select("user_id", "cluster")
    return Clusters(labels, costs[k], ordered)


def elbow(users: DataFrame, most: int = 10, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Cost of 2 to ``most`` clusters and the suggested number; all numbers are fitted in the same passes.

    Suggested is the number after which the drop in cost flattens most: the
    largest ratio of the change of the drop to the drop itself.
    """
    points = settle(scale(users, columns), "points")
    sizes = list(range(2, most + 1))
    centres, fitted = kmeans.full(points, columns, kmeans.first_centres(points, columns, sizes))
    fitted = kmeans.never_dearer(points, columns, centres, fitted)
    costs = [fitted[k] for k in sizes]
    best = suggested_size(sizes, costs)
    rows = [(k, float(c), k == best) for k, c in zip(sizes, costs)]
    return users.sparkSession.createDataFrame(rows, "k int, inertia double, is_suggested boolean")


def suggested_size(sizes: Sequence[int], costs: Sequence[float]) -> int:
    drops = [b - a for a, b in zip(costs, costs[1:])]
    ratios = [(b - a) / a if a else float("-inf") for a, b in zip(drops, drops[1:])]
    if not ratios:
        return sizes[0]
    return sizes[ratios.index(max(ratios)) + 1]


def with_clusters(users: DataFrame, clusters: Clusters) -> DataFrame:
    """User features with their cluster; both sides have one row per user."""
    return users.join(clusters.users, "user_id")


def profile(clustered: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Size, share, feature means and tags per cluster."""
    overall = one_row(
        clustered.agg(
            F.avg("avg_transaction_amount").alias("amount"),
            F.avg("transaction_count").alias("count"),
            F.count(F.lit(1)).alias("users"),
        )
    )
    means = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in columns]
    )
    online = F.col("online_transaction_ratio")
    return (
        means.withColumn("_all", overall)
        .withColumn("size_pct", F.col("size") * F.lit(100.0) / F.col("_all.users"))
        .withColumn("is_high_value", F.col("avg_transaction_amount") > F.col("_all.amount"))
        .withColumn("is_frequent", F.col("transaction_count") > F.col("_all.count"))
        .withColumn(
            "channel",
            F.when(online > ONLINE_ABOVE, "online").when(online < OFFLINE_BELOW, "in-store").otherwise("mixed"),
        )
        .drop("_all")
        .orderBy("cluster")
    )


def normalised_profile(profiles: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Feature means scaled to 0..1 over the clusters (null when all are equal)."""
    every = Window.partitionBy()  # one row per cluster

    def share(c: str):
        low, high = F.min(c).over(every), F.max(c).over(every)
        return F.try_divide(F.col(c) - low, high - low).alias(c)

    return profiles.select("cluster", *[share(c) for c in columns])


def distributions(clustered: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS[:5]) -> DataFrame:
    """Five-number summary per cluster and feature."""
    long = clustered.select("cluster", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["cluster"], list(columns), "feature", "v"
    )
    five = {"min_value": 0.0, "q1": 0.25, "median_value": 0.5, "q3": 0.75, "max_value": 1.0}
    return quantiles(long, "v", five, ["cluster", "feature"], few_groups=True)


def project(users: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """First two principal components of the centred, unscaled features.

    The sign is fixed by making the largest loading of each component positive.
    """
    raw = _vectors(users, columns, "raw")
    centre = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(raw)
    centred = centre.transform(raw)
    model = PCA(k=2, inputCol="features", outputCol="scores").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    scores = model.transform(centred).select("user_id", vector_to_array("scores").alias("s"))
    return scores.select(
        "user_id", (F.col("s")[0] * signs[0]).alias("pc1"), (F.col("s")[1] * signs[1]).alias("pc2")
    )


def payload(profiles: DataFrame) -> DataFrame:
    """One JSON text per cluster with its id, size, share and key means."""
    record = F.struct(
        F.col("cluster").alias("cluster_id"),
        "size",
        F.col("size_pct").alias("percentage"),
        F.col("transaction_count").alias("avg_transactions"),
        F.col("avg_transaction_amount").alias("avg_amount"),
        "total_spend",
        F.col("online_transaction_ratio").alias("online_ratio"),
    )
    return profiles.select("cluster", F.to_json(record).alias("payload"))
