"""Isolation forest (Liu, Ting and Zhou 2008) as Spark jobs.

Spark draws the samples and brings each to one task, which grows one tree from
at most 256 rows. The grown nodes are a small table (some 50,000 rows for 100
trees) that is broadcast; scoring is an Arrow-batched expression on every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.functions import calendar as cal
from spendscope.functions.text import HASH_SPAN, fast_hash
from spendscope.operators.quantiles import linear_cells, one_row, quantiles, smallest
from spendscope.session import settle

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.01
HELD_CELLS = 1 << 20  # whose scores a task remembers, 16 MB
FEATURES = ("amount", "hour")

_NODES = "tree int, node int, feature int, split double, left int, right int, path double"


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + float(np.euler_gamma)) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree: (node, feature, split, left, right, path); leaves have feature -1."""
    limit = math.ceil(math.log2(max(len(values), 2)))
    nodes: list[tuple] = []
    waiting = [(0, values, 0)]
    used = 1
    while waiting:
        node, rows, depth = waiting.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varied):
            nodes.append((node, -1, 0.0, -1, -1, depth + mean_path(len(rows))))
            continue
        feature = int(rng.choice(varied))
        split = float(rng.uniform(low[feature], high[feature]))
        left = rows[:, feature] <= split
        nodes.append((node, feature, split, used, used + 1, 0.0))
        waiting += [(used, rows[left], depth + 1), (used + 1, rows[~left], depth + 1)]
        used += 2
    return nodes


def _samples(
    rows: DataFrame, key: str, features: Sequence[str], trees: int, size: int, seed: int
) -> tuple[DataFrame, int]:
    """``size`` rows for each of ``trees`` trees, chosen by hash; and the rows per tree.

    The rows with the smallest hashes form a pool of at most ``trees * size`` and are dealt
    out in turn, starting again when all are dealt: a large table gives disjoint samples, a
    smaller one lets rows recur, by the same rule. A tree never gets a row twice.
    """
    numbered = rows.select(key, *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    hashed = numbered.withColumn("_hash", fast_hash(F.col(key), F.lit(seed)))
    best = smallest(hashed, "_hash", trees * size, key, *features, cells=linear_cells(0.0, HASH_SPAN))
    pool = settle(best, "pool")
    found = pool.count()
    if not found:
        return pool.withColumn("tree", F.lit(0)), 0
    per_tree = min(size, found)
    turn = F.row_number().over(Window.partitionBy().orderBy("_hash", key, *features)) - 1  # the pool is bounded
    dealt = pool.withColumn("_turn", turn).withColumn(
        "_slot", F.explode(F.sequence(F.col("_turn"), F.lit(trees * per_tree - 1), F.lit(found)))
    )
    return dealt.withColumn("tree", F.floor(F.col("_slot") / per_tree).cast("int")), per_tree


@dataclass(frozen=True)
class Forest:
    """Grown trees as flat arrays; ``roots`` holds the first node of each tree."""

    features: tuple[str, ...]
    arrays: Broadcast
    height: int

    def score(self) -> Column:
        """Anomaly score between 0 and 1 of the feature columns; null when one is null.

        A row meets the splits of a feature only by its rank among them, so rows of equal ranks score
        alike: each task scores the cells that it meets once, and remembers up to ``HELD_CELLS`` of them.
        """
        shared, height = self.arrays, self.height

        @F.pandas_udf("double")
        def isolate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            roots, feature, split, left, right, path, norm = shared.value
            splits = [np.unique(split[feature == k]) for k in range(len(self.features))]
            places = np.array([len(edges) + 1 for edges in splits])
            packs = float(np.prod(places.astype(float))) < 2.0**62
            rank = np.zeros(len(split), dtype=np.int32)  # of each split among those of its feature
            for k, edges in enumerate(splits):
                rank[feature == k] = np.searchsorted(edges, split[feature == k])
            known, scored = np.zeros(0, dtype=np.int64), np.zeros(0)

            def fresh(cells: np.ndarray) -> np.ndarray:
                """Scores of rows of ranks; a value is at most a split if its rank is at most the split's."""
                total = np.zeros(len(cells))
                columns = np.ascontiguousarray(cells.T.astype(np.int32)).reshape(-1)
                row = np.arange(len(cells))
                for root in roots:
                    at = np.full(len(cells), root)
                    for _ in range(height):
                        f = feature[at]
                        lower = columns[np.maximum(f, 0) * len(cells) + row] <= rank[at]
                        at = np.where(f < 0, at, np.where(lower, left[at], right[at]))
                    total += path[at]
                return np.exp2(-total / len(roots) / norm)

            for columns in batches:
                x = np.column_stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns])
                cells = np.column_stack([np.searchsorted(edges, x[:, k]) for k, edges in enumerate(splits)])
                if not packs:
                    scores = fresh(cells)
                else:
                    codes, first, back = np.unique(np.ravel_multi_index(cells.T, places), return_index=True, return_inverse=True)
                    spot = np.searchsorted(known, codes)
                    new = np.ones(len(codes), dtype=bool)
                    inside = spot < len(known)
                    new[inside] = known[spot[inside]] != codes[inside]
                    found = np.empty(len(codes))
                    found[~new] = scored[spot[~new]]
                    found[new] = fresh(cells[first[new]])
                    if len(known) + new.sum() <= HELD_CELLS:
                        known, scored = np.insert(known, spot[new], codes[new]), np.insert(scored, spot[new], found[new])
                    scores = found[back]
                yield pd.Series(scores).mask(np.isnan(x).any(axis=1))

        return isolate(*[F.col(f).cast("double") for f in self.features])


def fit_forest(
    rows: DataFrame,
    features: Sequence[str] = FEATURES,
    key: str = "transaction_id",
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> Forest:
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, *names])
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(pdf[names].to_numpy("float64"), np.random.default_rng([seed, tree]))
        grown = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "path"])
        grown.insert(0, "tree", tree)
        return grown

    samples, per_tree = _samples(rows, key, names, trees, sample, seed)
    # At most 2 * sample - 1 nodes per tree, so the driver holds a few megabytes.
    nodes = samples.groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    if nodes.empty:
        raise ValueError("no rows with all features to grow a forest from")
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    first = nodes.groupby("tree", sort=True)["node"].size().cumsum().shift(fill_value=0)
    offset = nodes["tree"].map(first).to_numpy()
    arrays = (
        first.to_numpy(),
        nodes["feature"].to_numpy(),
        nodes["split"].to_numpy(),
        nodes["left"].to_numpy() + offset,
        nodes["right"].to_numpy() + offset,
        nodes["path"].to_numpy(),
        max(mean_path(per_tree), 1e-12),
    )
    spark = rows.sparkSession
    height = math.ceil(math.log2(max(per_tree, 2)))
    return Forest(tuple(names), spark.sparkContext.broadcast(arrays), height)


def with_forest_features(rows: DataFrame) -> DataFrame:
    t = F.col("timestamp")
    return rows.withColumns({"hour": F.hour(t), "day_of_week": cal.day_of_week(t)})


def standardised(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with a copy of each feature shifted to mean 0 and divided by its population deviation, and their names."""
    numbers = [F.col(f).cast("double") for f in features]
    moments = rows.agg(
        *[F.avg(c).alias(f"{f}_mean") for c, f in zip(numbers, features)],
        *[F.stddev_pop(c).alias(f"{f}_std") for c, f in zip(numbers, features)],
    )
    names = [f"scaled_{f}" for f in features]
    m = F.col("_moments")
    scaled = [
        (c - m[f"{f}_mean"]) / F.when(m[f"{f}_std"] == 0, 1.0).otherwise(m[f"{f}_std"]) for c, f in zip(numbers, features)
    ]
    return rows.withColumn("_moments", one_row(moments)).withColumns(dict(zip(names, scaled))).drop("_moments"), names


def flag_isolated(
    rows: DataFrame,
    features: Sequence[str] = FEATURES,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    seed: int = 42,
    scaled: bool = False,
) -> DataFrame:
    """``ml_score`` and ``is_ml_anomaly`` (0/1): score above the exact upper quantile.

    The rows are settled, as the sample, the quantile and the flags read them. The quantile is taken
    over distinct feature values with their counts, so each
    is scored once; their scores are settled because two passes read them. ``scaled`` grows the trees
    on standardised features: splits move along with the values, so scores stay what they are.
    """
    featured = with_forest_features(settle(rows, "forest-rows"))
    names = list(features)
    if scaled:
        featured, names = standardised(featured, features)
    forest = fit_forest(featured, names, trees=trees, seed=seed)
    seen = featured.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"))
    scores = settle(seen.select(forest.score().alias("ml_score"), "_rows"), "scores")
    edge = quantiles(scores, "ml_score", {"edge": 1.0 - contamination}, weight="_rows").scalar()
    flag = F.coalesce((F.col("ml_score") > edge).cast("int"), F.lit(0))
    added = [c for c in ("hour", "day_of_week", *names) if c not in rows.columns]
    return (
        featured.withColumn("ml_score", forest.score()).withColumn("is_ml_anomaly", flag).drop(*added)
    )
