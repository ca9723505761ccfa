"""Exact order statistics without ever holding a whole group in one task.

The built-in exact ``percentile`` keeps one map of all distinct values per
group in a single reducer. Here the values are first counted on a monotone
grid (one narrow scan, combined on the map side), which tells in which cell
each wanted rank lies. A second narrow scan keeps only the rows of those cells.
Each such cell is cut into parts between its own least and largest value, twice, and only
the values of the wanted part are ranked: one task sorts some 64 values at most. No row is
shuffled that cannot be the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_PER_E_FOLD = 16384
LINEAR_CELLS = 1 << 17
PARTS = 1 << 16  # of a wanted cell, per round
REFINEMENTS = 2

# Cells of equal relative width (0.006 %), growing with the value and symmetric around 0.
LOG_CELLS = f"cast(signum(_v) * floor(least(log1p(abs(_v)), 720D) * {CELLS_PER_E_FOLD}) as bigint)"


def linear_cells(low: float, high: float) -> str:
    """Cells of equal width, for values known to lie evenly between two bounds."""
    return f"floor((_v - {low!r}D) / {(high - low) / LINEAR_CELLS!r}D)"


def order_statistics(
    rows: DataFrame,
    value: str,
    ranks: Sequence[str],
    by: Sequence[str] = (),
    cells: str = LOG_CELLS,
    few_groups: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Values at 0-based ``ranks``, given as SQL over ``group_rows``, the rows of the group.

    A ``weight`` column makes each row stand for that many equal ones.

    Returns one row per group: ``by..., group_rows, found_0, found_1, ...``; without
    groups always exactly one row. ``few_groups`` promises a fixed number of groups,
    so the wanted cells can be broadcast; without groups there are as many cells as
    ranks at most.
    """
    by = list(by)
    slots = range(len(ranks))
    group = ", ".join(f"`{b}`" for b in by)
    in_group = f"partition by {group} " if by else ""
    base = (
        rows.select(
            *by,
            F.col(value).cast("double").alias("_v"),
            F.col(weight).alias("_w") if weight else F.lit(1).alias("_w"),
        )
        .where("_v is not null and not isnan(_v)")
        .selectExpr("*", f"{cells} as _cell")
    )
    counted = (
        base.groupBy(*by, "_cell")
        .agg(F.expr("sum(_w) as _n"), F.expr("min(_v) as _low"), F.expr("max(_v) as _high"))
        .selectExpr(
            "*",
            f"sum(_n) over ({in_group}order by _cell rows unbounded preceding) - _n as _below",
            f"sum(_n) over ({in_group.strip()}) as group_rows",
        )
    )
    # Each wanted cell with the ranks it holds, counted from its first row.
    inside = [f"if({rank} >= _below and {rank} < _below + _n, cast({rank} as bigint) - _below, null)" for rank in ranks]
    held = ", ".join(f"{spot} as _r{i}" for i, spot in enumerate(inside))
    wanted = (
        counted.selectExpr(*by, "_cell", f"struct(group_rows, _low, _high, {held}) as _f")
        .where(f"coalesce({', '.join(f'_f._r{i}' for i in slots)}) is not null")
    )
    few = few_groups or not by
    # All that the steps below need goes along as one column: so they share one shuffle of the rows.
    ranked = (
        base.join(F.broadcast(wanted) if few else wanted, [*by, "_cell"])
        .groupBy(*by, "_cell", "_v", "_f")
        .agg(F.expr("sum(_w) as _m"))
    )
    for _ in range(REFINEMENTS):
        ranked = _refined(ranked, by, slots, few)
    in_cell = f"partition by {', '.join([group] * bool(by) + ['_cell'])}"
    ranked = ranked.selectExpr("*", f"sum(_m) over ({in_cell} order by _v rows unbounded preceding) as _upto")
    return ranked.groupBy(*by).agg(
        F.expr("max(_f.group_rows) as group_rows"),
        *[
            F.expr(f"max(if(_f._r{i} < _upto and _f._r{i} >= _upto - _m, _v, null)) as found_{i}")
            for i in slots
        ],
    )


def _refined(ranked: DataFrame, by: list[str], slots: range, few: bool) -> DataFrame:
    """``ranked`` cut down to the parts of each cell, between its least and its largest value, that hold a rank.

    Two rounds leave some 64 distinct values in a cell of ``LOG_CELLS`` at most, however close the values lie:
    doubles have 52 binary digits, of which cell and rounds use 14, 16 and 16.
    """
    part = f"coalesce(cast((_v - _f._low) / nullif(_f._high - _f._low, 0D) * {PARTS - 1}D as bigint), 0)"
    split = ranked.selectExpr("*", f"{part} as _part")
    group = ", ".join([*(f"`{b}`" for b in by), "_cell"])
    sums = (
        split.groupBy(*by, "_cell", "_f", "_part")
        .agg(F.expr("sum(_m) as _n"), F.expr("min(_v) as _low"), F.expr("max(_v) as _high"))
        .selectExpr("*", f"sum(_n) over (partition by {group} order by _part rows unbounded preceding) - _n as _below")
    )
    held = ", ".join(f"if(_f._r{i} >= _below and _f._r{i} < _below + _n, _f._r{i} - _below, null) as _r{i}" for i in slots)
    parts = sums.selectExpr(*by, "_cell", "_part", f"struct(_f.group_rows, _low, _high, {held}) as _g")
    parts = parts.where(f"coalesce({', '.join(f'_g._r{i}' for i in slots)}) is not null")
    kept = split.join(F.broadcast(parts) if few else parts, [*by, "_cell", "_part"])
    return kept.selectExpr(*by, "struct(_cell, _part) as _cell", "_v", "_g as _f", "_m")


def quantiles(
    rows: DataFrame,
    value: str,
    named: dict[str, float],
    by: Sequence[str] = (),
    cells: str = LOG_CELLS,
    few_groups: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles, one column per name; one row per group.

    Without ``by`` the result always has exactly one row (nulls for no input).
    """
    # By way of percent, as the usual array libraries do: a third then lies just below 1/3.
    spots = {name: f"{p * 100 / 100!r}D * (group_rows - 1)" for name, p in named.items()}
    ranks = [f"{edge}({spot})" for spot in spots.values() for edge in ("floor", "ceil")]
    found = order_statistics(rows, value, ranks, by, cells, few_groups, weight)

    def interpolate(i: int, spot: str) -> str:
        low, high, weight = f"found_{2 * i}", f"found_{2 * i + 1}", f"({spot} - floor({spot}))"
        from_low = f"{low} + ({high} - {low}) * {weight}"
        from_high = f"{high} - ({high} - {low}) * (1 - {weight})"
        return f"if({weight} < 0.5D, {from_low}, {from_high})"

    return found.selectExpr(
        *by, *[f"{interpolate(i, spot)} as {name}" for i, (name, spot) in enumerate(spots.items())]
    )


def iqr_fences(
    rows: DataFrame, value: str, by: Sequence[str] = (), few_groups: bool = False
) -> DataFrame:
    """Quartiles and the 1.5 interquartile-range bounds around them."""
    quartiles = quantiles(rows, value, {"q1": 0.25, "q3": 0.75}, by, few_groups=few_groups)
    return quartiles.selectExpr(
        *by, "q1", "q3", "q1 - 1.5D * (q3 - q1) as low", "q3 + 1.5D * (q3 - q1) as high"
    )


def smallest(rows: DataFrame, value: str, n: int, *ties: str, cells: str = LOG_CELLS) -> DataFrame:
    """The ``n`` rows with the smallest value, ties settled by the named columns.

    The exact n-th value is found first, so each task passes on only rows that
    belong to the answer instead of its own ``n`` best.
    """
    at_n = order_statistics(rows, value, [f"least({n}, group_rows) - 1"], cells=cells)
    limit = at_n.select("found_0").scalar()
    return rows.where(F.col(value) <= limit).orderBy(value, *ties).limit(n)


def one_row(stats: DataFrame) -> Column:
    """A one-row frame as a struct value: a scalar subquery, not a join."""
    return stats.select(F.struct("*")).scalar()
