"""Incremental jobs over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.plans.aggregates_queries import DAILY_SQL
from spendscope.plans.ingest_queries import day_files, dirty_files
from spendscope.plans.registry import named
from spendscope.plans.shape import shaped
from spendscope.session import fresh_path
from spendscope.sources import sinks
from spendscope.sources.fixtures import card_month, dirty_month, with_views
from spendscope.sources.schemas import TRANSACTION_COLUMNS
from spendscope.streaming import increments


@named(
    "stream_ingest",
    with_views(
        "t1",
        f"select {', '.join(c for c in TRANSACTION_COLUMNS if c != 'amount')}, round(amount, 4) as amount from t1",
    ),
)
def stream_ingest(spark, folder):
    out, checkpoint = fresh_path(spark, "table"), fresh_path(spark, "progress")
    increments.ingest(increments.incoming(spark, day_files(spark, folder)), out, checkpoint)
    rows = spark.read.parquet(out)
    return shaped(rows.select(*TRANSACTION_COLUMNS), amount=4)


_ONCE_SQL = with_views(
    "t1raw",
    """select transaction_id, round(amount, 2) as amount, try_cast(timestamp as timestamp) as timestamp
       from (select *, row_number() over (partition by transaction_id order by file_seq) as nth from t1raw)
       where nth = 1""",
)


def _deliver(spark, folder, root, delivery):
    """Add one delivery of the dirty month to the incoming folder; the third one repeats some rows of the first."""
    rows = dirty_month(spark, folder)
    again = (F.col("file_seq") == 1) & (F.col("transaction_id").cast("bigint") % 30 == 7)
    rows = rows.where(again if delivery == 3 else F.col("file_seq") == delivery)
    sinks.write_daily_files(
        rows.select(*TRANSACTION_COLUMNS, F.lit(delivery).alias("delivery")), f"{root}/{delivery}", "delivery"
    )


@named("stream_dedup", _ONCE_SQL)
def stream_dedup(spark, folder):
    """Three deliveries, the later ones repeating ids of the first; one run after each."""
    root, out = fresh_path(spark, "incoming"), fresh_path(spark, "once")
    checkpoint = fresh_path(spark, "progress")
    for delivery in (1, 2, 3):
        _deliver(spark, folder, root, delivery)
        increments.ingest_once_per_id(increments.incoming(spark, root), out, checkpoint)
    return shaped(increments.written(spark, out).select("transaction_id", "amount", "timestamp"), amount=2)


@named("stream_dedup_watermark", _ONCE_SQL)
def stream_dedup_watermark(spark, folder):
    """Repeats within the allowed lateness are dropped; undated rows are kept once per id."""
    out, checkpoint = fresh_path(spark, "once"), fresh_path(spark, "progress")
    rows = increments.incoming(spark, dirty_files(spark, folder))
    lost = increments.ingest_once_within(rows, out, checkpoint, "60 days")
    if lost:
        raise RuntimeError(f"{lost} rows came later than the allowed lateness")
    kept = [increments.once_within(spark, out), increments.written(spark, increments.undated_part(out))]
    return shaped(kept[0].unionByName(kept[1]).select("transaction_id", "amount", "timestamp"), amount=2)


# Deliveries of seven hours each; every tenth row comes 20 deliveries after its own.
_SLICES, _HOURS, _DELAY = 103, 7, 20


@named(
    "stream_late_rows",
    with_views(
        "t1",
        f"""with sliced as (
              select transaction_id, amount, timestamp,
                     cast(floor(epoch(timestamp - timestamp '2024-01-01') / 3600 / {_HOURS}) as int) as slice from t1),
            placed as (
              select *, case when cast(transaction_id as bigint) % 10 = 0 and slice + {_DELAY} < {_SLICES}
                             then slice + {_DELAY} else slice end as delivery from sliced),
            newest as (select delivery, max(max(timestamp)) over (order by delivery rows between unbounded preceding
                              and 1 preceding) - interval 2 days as mark from placed group by delivery)
            select transaction_id, round(amount, 4) as amount, timestamp
            from placed join newest using (delivery) where timestamp <= mark""",
    ),
)
def stream_late_rows(spark, folder):
    """What comes more than two days after newer rows, over more than a hundred batches of one file each."""
    root, out, checkpoint = fresh_path(spark, "incoming"), fresh_path(spark, "once"), fresh_path(spark, "progress")
    hours = F.timestamp_diff("hour", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("timestamp"))
    delayed = (F.col("transaction_id").cast("bigint") % 10 == 0) & (F.col("slice") + _DELAY < _SLICES)
    rows = card_month(spark, folder).withColumn("slice", F.floor(hours / _HOURS).cast("int"))
    rows = rows.withColumn("delivery", F.when(delayed, F.col("slice") + _DELAY).otherwise(F.col("slice")))
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("string"))
    whole = rows.select(*TRANSACTION_COLUMNS, "delivery").repartition("delivery")
    whole.write.partitionBy("delivery").option("header", True).csv(root)
    _in_order(spark, root)
    lost = increments.ingest_once_within(increments.incoming(spark, root, files_per_batch=1), out, checkpoint, "2 days")
    late = increments.late_rows(spark, out)
    if lost != late.count():
        raise RuntimeError(f"{lost} late rows were counted, {late.count()} written")
    return shaped(late.select("transaction_id", "amount", "timestamp"), amount=4)


def _in_order(spark, root):
    """Deliveries come in the order of their numbers: streams take files by the time of their last change."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.globStatus(hadoop.Path(f"{root}/delivery=*/*.csv")):
        number = int(status.getPath().getParent().getName().split("=")[1])
        store.setTimes(status.getPath(), 1_700_000_000_000 + 60_000 * number, -1)


@named("stream_daily_metrics", DAILY_SQL)
def stream_daily_metrics(spark, folder):
    """Three deliveries of the month, the last one with its first days; one run after each."""
    root, out, checkpoint = fresh_path(spark, "incoming"), fresh_path(spark, "daily"), fresh_path(spark, "progress")
    day = F.dayofmonth("timestamp")
    rows = card_month(spark, folder).withColumn("day", F.to_date("timestamp"))
    late_first = F.when(day > 20, 1).when(day > 5, 2).otherwise(3)
    rows = rows.withColumn("delivery", late_first).withColumn("timestamp", F.col("timestamp").cast("string"))
    for delivery in (1, 2, 3):
        part = rows.where(F.col("delivery") == delivery).select(*TRANSACTION_COLUMNS, "day")
        sinks.write_daily_files(part, f"{root}/{delivery}", "day")
        increments.maintain_daily(increments.incoming(spark, root), out, checkpoint)
    return shaped(increments.latest_daily(spark, out), transaction_value=2)
