"""Output shape of registered queries: rounded numbers and dates as text.

Floating sums differ in their last bits with the order of addition, so results
are rounded before they are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shaped(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    columns = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            # adding 0 turns a rounded -0.0 into 0.0
            c = F.round(c, per_column.get(name, digits)) + F.lit(0.0)
        elif kind == "date":
            c = c.cast("string")
        columns.append(c.alias(name))
    return df.select(*columns)
