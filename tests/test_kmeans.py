"""k-means for many sizes at once against separate fits and a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendscope.operators import clustering, kmeans

COLUMNS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 8, (5, 3))
    rows = centres[rng.integers(0, 5, 4000)] + rng.normal(0, 1, (4000, 3))
    data = [(f"u{i}", *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "user_id string, x double, y double, z double").repartition(5), rows


def plain(rows, centres, rounds):
    for _ in range(rounds):
        near = ((rows[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([rows[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        done = ((moved - centres) ** 2).sum(axis=1).max() <= kmeans.TOLERANCE**2
        centres = moved
        if done:
            break
    return ((rows[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_all_sizes_at_once_are_as_separate_fits(cloud):
    points, rows = cloud
    start = kmeans.first_centres(points, COLUMNS, range(2, 9))
    _, costs = kmeans.full(points, COLUMNS, start)
    for k in (2, 5, 8):
        _, alone = kmeans.full(points, COLUMNS, {k: start[k]})
        assert costs[k] == pytest.approx(alone[k], rel=1e-6)
    assert costs == pytest.approx({k: plain(rows, c, kmeans.ROUNDS) for k, c in start.items()}, rel=1e-6)


def test_small_batches_come_near(cloud):
    points, _ = cloud
    start = kmeans.first_centres(points, COLUMNS, [5])
    _, costs = kmeans.full(points, COLUMNS, start)
    _, small = kmeans.in_batches(points, COLUMNS, start, batch_rows=200)
    assert small[5] <= 1.05 * costs[5]
    again = kmeans.in_batches(points.repartition(3), COLUMNS, start, batch_rows=200)[1]
    assert again[5] == pytest.approx(small[5], rel=1e-9)


def test_fewer_points_than_clusters(spark):
    points = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0)], "user_id string, x double, y double, z double")
    centres, costs = kmeans.full(points, COLUMNS, kmeans.first_centres(points, COLUMNS, [3]))
    assert costs[3] == 0.0 and len(centres[3]) == 3
    assert kmeans.labelled(points, COLUMNS, centres[3]).select("cluster").distinct().collect() == [(0,)]


def test_clusters_by_batches_are_numbered_by_spend(cloud):
    points, _ = cloud
    users = points.withColumnRenamed("x", "total_spend")
    found = clustering.fit_in_batches(users, 4, ["total_spend", "y", "z"], batch_rows=500)
    spend = [c[0] for c in found.centres]
    assert spend == sorted(spend) and found.users.groupBy("cluster").agg(F.count("*")).count() == 4
