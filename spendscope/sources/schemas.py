"""Schemas of the transaction files and checks on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of a transaction file in file order.
TRANSACTION_COLUMNS = (
    "transaction_id", "user_id", "merchant_id", "merchant_name", "merchant_category",
    "amount", "currency", "location_country", "location_city", "is_online",
    "device_type", "status", "timestamp",
)
# The text columns that cleaning normalises.
TEXT_COLUMNS = (
    "merchant_name", "merchant_category", "currency", "location_country",
    "location_city", "device_type", "status",
)

_TYPES = {"amount": T.DoubleType(), "is_online": T.BooleanType()}

# The timestamp stays text here: a bad one must become null, not fail the row.
RAW_TRANSACTIONS = T.StructType(
    [T.StructField(c, _TYPES.get(c, T.StringType())) for c in TRANSACTION_COLUMNS]
)
MERCHANT_REFERENCE = T.StructType(
    [
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_category_detailed", T.StringType()),
    ]
)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"table lacks the columns {', '.join(absent)}")


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def describe_types(df: DataFrame) -> DataFrame:
    """Column name and type as rows."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")
