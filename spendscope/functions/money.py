"""Amount expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges (inclusive) and names of the amount classes.
AMOUNT_EDGES = (10.0, 50.0, 100.0, 500.0, 1000.0)
AMOUNT_CLASSES = ("very_small", "small", "medium", "large", "very_large", "huge")


def amount_class(amount: Column, missing: str | None = "unknown") -> Column:
    """Class of the amount, bins closed on the right."""
    *closed, last = AMOUNT_CLASSES
    chosen = F.when(amount.isNull(), F.lit(missing))
    for edge, name in zip(AMOUNT_EDGES, closed):
        chosen = chosen.when(amount <= edge, name)
    return chosen.otherwise(last)


def amount_class_order(name: Column) -> Column:
    """1 for the smallest class and so on; null for anything else."""
    position = F.array_position(F.array(*map(F.lit, AMOUNT_CLASSES)), name).cast("int")
    return F.when(position > 0, position)


def clip(amount: Column, low: Column, high: Column) -> Column:
    """Amount moved to the nearer bound when outside; null stays null."""
    return F.when(amount < low, low).when(amount > high, high).otherwise(amount)


def total(amount: Column) -> Column:
    """Sum that is 0 rather than null when there is nothing to add."""
    return F.coalesce(F.sum(amount), F.lit(0.0))


def share_percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)
