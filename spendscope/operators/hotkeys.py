"""Attach per-key facts to rows when one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.session import settle

# A key is hot above this share of all rows: fewer than so many keys are broadcast, and no other key can make a
# shuffle partition of even a tenth of an ordinary one at 2000 partitions. Raise it with the number of partitions.
HOT_SHARE = 20_000
SALTS = 4096  # over which rows that need no fact are spread
ROWS = "_rows"  # the column of facts that says how many rows a key has


def attach_by_key(rows: DataFrame, facts: DataFrame, key: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """``rows LEFT JOIN facts`` on ``key``, reading ``rows`` once more after the facts were made.

    ``facts`` has one row per key and is settled here. An aggregate of the rows themselves should also
    count them as ``ROWS``, so that no further pass has to. Keys above ``1 / hot_share`` of all rows number
    less than ``hot_share`` whatever the data: their facts are broadcast. Their rows, and rows without
    a key, then match nothing in the join of all other facts, so a salt spreads them over its partitions,
    copies of one row included. Facts that Spark finds small enough are broadcast as a whole.
    """
    if ROWS not in facts.columns:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(ROWS))
        facts = counts.join(facts, key, "left")
    known = settle(facts, "facts")
    values = [c for c in known.columns if c not in (key, ROWS)]
    packed = known.select(key, ROWS, F.struct(*values).alias("_facts"))
    everything = known.agg(F.sum(ROWS)).scalar()
    hot = packed.where(F.col(ROWS) * hot_share > everything).select(key, F.col("_facts").alias("_hot"))
    # A computed 0: a literal would leave the join by the key alone.
    cold = packed.select(F.col(key).alias("_cold"), F.least(ROWS, F.lit(0)).cast("int").alias("_salt"), "_facts")

    marked = rows.join(F.broadcast(hot), key, "left")
    needed = F.when(F.col("_hot").isNull(), F.col(key))
    # By the task that read the row as well as by its values, so copies do not stay together.
    told = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind], F.spark_partition_id())
    salt = F.when(needed.isNull(), F.pmod(told, F.lit(SALTS)).cast("int") + 1).otherwise(0)
    joined = marked.select("*", needed.alias("_cold"), salt.alias("_salt")).join(cold, ["_cold", "_salt"], "left")
    either = F.coalesce("_hot", "_facts")
    return joined.select(*rows.columns, *[either[c].alias(c) for c in values])
