"""k-means for several numbers of clusters in the same passes, on all rows or on a batch per round."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.operators.profiling import sample_rows

SEED = 42
START_ROWS = 2000  # chosen by hash, from which the first centres are drawn on the driver
ROUNDS, TOLERANCE = 20, 1e-4
BATCH_ROWS, BATCH_ROUNDS = 1000, 40

Centres = dict[int, np.ndarray]  # by number of clusters: one row per centre


@dataclass(frozen=True)
class Sums:
    """What one pass gives for one number of clusters: rows and sums per centre, and the cost of the centres before."""

    counts: np.ndarray
    sums: np.ndarray
    cost: float


def first_centres(points: DataFrame, columns: Sequence[str], sizes: Sequence[int], key: str = "user_id") -> Centres:
    """Far-apart points of a fixed sample, each drawn by its squared distance to those before; the first k for k clusters.

    With fewer distinct points than clusters some centres coincide.
    """
    sample = sample_rows(points.select(key, *columns), START_ROWS, key).orderBy(key).toPandas()
    sample = sample[list(columns)].to_numpy(dtype=float)
    rng = np.random.default_rng(SEED)
    chosen = [sample[rng.integers(len(sample))]]
    near = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < max(sizes):
        whole = near.sum()
        chosen.append(sample[rng.choice(len(sample), p=near / whole) if whole > 0 else 0])
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return {k: np.array(chosen[:k]) for k in sizes}


def pass_over(points: DataFrame, columns: Sequence[str], centres: Centres) -> dict[int, Sums]:
    """One pass for all numbers of clusters: each task adds up its rows per (number, nearest centre)."""
    width = len(columns)
    names = ["k", "centre", "n", "cost", *(f"s{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(c), 2 + width)) for k, c in centres.items()}
        for batch in batches:
            rows = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in columns])
            for k, c in centres.items():
                far = ((rows[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
                nearest = far.argmin(axis=1)
                figures = np.column_stack([np.ones(len(rows)), far[np.arange(len(rows)), nearest], rows])
                np.add.at(total[k], nearest, figures)
        flat = [[k, i, *line] for k, lines in total.items() for i, line in enumerate(lines) if line[0]]
        columns_of = list(zip(*flat)) or [()] * len(names)
        kinds = [pa.int32(), pa.int32()] + [pa.float64()] * (len(names) - 2)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_of, kinds)], names)

    schema = ", ".join(f"{n} {'int' if n in ('k', 'centre') else 'double'}" for n in names)
    summed = points.select(*columns).mapInArrow(run, schema).groupBy("k", "centre")
    found = summed.agg(*[F.sum(n).alias(n) for n in names[2:]]).collect()  # a row per centre
    out = {k: Sums(np.zeros(len(c)), np.zeros(c.shape), sum(r["cost"] for r in found if r["k"] == k)) for k, c in centres.items()}
    for r in found:
        out[r["k"]].counts[r["centre"]] = r["n"]
        out[r["k"]].sums[r["centre"]] = [r[f"s{i}"] for i in range(width)]
    return out


def full(points: DataFrame, columns: Sequence[str], start: Centres, rounds: int = ROUNDS) -> tuple[Centres, dict[int, float]]:
    """Centres and costs after ``rounds`` rounds, or when no centre moves; a number that is settled leaves the passes.

    Every number of clusters ends as if it were fitted by itself. A centre without rows stays where it is.
    """
    now, open_ = dict(start), set(start)
    for _ in range(rounds):
        for k, s in pass_over(points, columns, {k: now[k] for k in open_}).items():
            moved = np.where(s.counts[:, None] > 0, s.sums / np.maximum(s.counts, 1)[:, None], now[k])
            if ((moved - now[k]) ** 2).sum(axis=1).max() <= TOLERANCE**2:
                open_.discard(k)
            now[k] = moved
        if not open_:
            break
    return now, {k: s.cost for k, s in pass_over(points, columns, now).items()}


def never_dearer(points: DataFrame, columns: Sequence[str], centres: Centres, costs: dict[int, float]) -> dict[int, float]:
    """``costs`` where no larger number of clusters costs more than a smaller one.

    Rounds end in a local minimum, so one may. It is then fitted again from the centres of the number before it and
    one more of its own, which cannot cost more.
    """
    sizes = sorted(costs)
    for fewer, k in zip(sizes, sizes[1:]):
        if costs[k] > costs[fewer]:
            own = np.array(centres[k])
            lonely = ((own[:, None] - centres[fewer][None]) ** 2).sum(axis=2).min(axis=1).argsort()[::-1][: k - fewer]
            again, cost = full(points, columns, {k: np.concatenate([centres[fewer], own[lonely]])})
            centres, costs = centres | again, costs | cost
    return costs


def in_batches(
    points: DataFrame, columns: Sequence[str], start: Centres, key: str = "user_id",
    batch_rows: int = BATCH_ROWS, rounds: int = BATCH_ROUNDS,
) -> tuple[Centres, dict[int, float]]:
    """As :func:`full`, but each round sees some ``batch_rows`` rows only, drawn by a hash of the key and the round.

    A centre moves towards the mean of its rows in the batch by their share in all rows it has had so far, so it
    settles as rounds go by. The cost is that of all rows.
    """
    n = points.count()
    now = {k: c.copy() for k, c in start.items()}
    had = {k: np.zeros(len(c)) for k, c in start.items()}
    for turn in range(rounds):
        for k, s in pass_over(points.where(_in_batch(key, turn, n, batch_rows)), columns, now).items():
            had[k] += s.counts
            rate = (s.counts / np.maximum(had[k], 1))[:, None]
            mean = s.sums / np.maximum(s.counts, 1)[:, None]
            now[k] = np.where(s.counts[:, None] > 0, now[k] + rate * (mean - now[k]), now[k])
    return now, {k: s.cost for k, s in pass_over(points, columns, now).items()}


def _in_batch(key: str, turn: int, n: int, batch_rows: int) -> Column:
    if n <= batch_rows:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(n)) < batch_rows


def labelled(points: DataFrame, columns: Sequence[str], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """Each row with the number of its nearest centre, the first of equal ones."""

    def far(centre) -> Column:
        return sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(columns, centre)), F.lit(0.0))

    every = F.array(*[F.struct(far(c).alias("far"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return points.withColumn(name, F.array_min(every)["i"])
