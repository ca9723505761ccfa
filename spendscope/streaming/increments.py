"""Incremental ingest with Structured Streaming.

Every stream here takes what has arrived since its last run and stops
(``availableNow``); the checkpoint remembers the files already taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from spendscope.functions.calendar import parse_timestamp
from spendscope.operators import sketches
from spendscope.operators.aggregates import keyed, with_date
from spendscope.operators.dedup import keep_first, unseen
from spendscope.session import scratch, settle
from spendscope.sources.commits import Commit, Commits
from spendscope.sources.id_index import IDS_A_BUCKET, IdIndex
from spendscope.sources.schemas import RAW_TRANSACTIONS


# What a stream writes: the transaction columns with parsed timestamps.
_WRITTEN = StructType([f if f.name != "timestamp" else StructField("timestamp", TimestampNTZType()) for f in RAW_TRANSACTIONS])


def incoming(
    spark: SparkSession, root: str, pattern: str = "*.csv", files_per_batch: int | None = None
) -> DataFrame:
    """New transaction files below ``root`` as a stream of parsed rows and where in a file they stand."""
    reader = (
        spark.readStream.schema(RAW_TRANSACTIONS)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    placed = reader.csv(root).select(
        "*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block")
    )
    return placed.withColumn("timestamp", parse_timestamp(F.col("timestamp")))


_ORIGIN = ("source_file", "source_block")


def _drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append new rows to Parquet; each file is taken exactly once."""
    kept = rows.drop(*_ORIGIN)
    _drain(kept.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def _batch(batch_id: int) -> str:
    return f"{batch_id:012d}"


def _in_file_order(batch: DataFrame) -> DataFrame:
    """The first row per id. Row ids grow along a partition, so file, block and id give the order in the files."""
    numbered = batch.withColumn("source_row", F.monotonically_increasing_id())
    return keep_first(numbered, "transaction_id", [*_ORIGIN, "source_row"]).drop(*_ORIGIN, "source_row")


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("transaction_id").alias("id"))


def ingest_once_per_id(rows: DataFrame, out: str, checkpoint: str, ids_a_bucket: int = IDS_A_BUCKET) -> None:
    """Append only transactions whose id was never written; of repeats the first one in file order stays.

    Nothing grows in the state store, and no batch reads the rows written before: an index of ids beside them says
    which ids it knows (``IdIndex``). A batch is published as a whole, so one that is repeated after a
    failure, or broke off between its rows and its ids, is completed and counts once. Read the table with
    :func:`written`. Table and checkpoint belong together.
    """
    spark = rows.sparkSession
    table, index = Commits(spark, out), IdIndex(spark, index_part(out), ids_a_bucket)

    def add(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return

        def write(path: str) -> dict:
            with scratch(spark):
                fresh = settle(_in_file_order(batch), "fresh")
                known = index.seen(_ids(fresh)).select(F.col("id").alias("transaction_id"))
                fresh.join(known, "transaction_id", "left_anti").select(*fresh.columns).write.parquet(path)
            return {"rows": spark.read.parquet(path).count()}

        table.put(_batch(batch_id), write)
        if not index.commits.holds(_batch(batch_id)):
            (own,) = (c.path for c in table.live() if c.last == _batch(batch_id))
            index.add(_batch(batch_id), _ids(spark.read.schema("transaction_id string").parquet(own)))

    _drain(rows.writeStream.foreachBatch(add), checkpoint)


def index_part(out: str) -> str:
    return f"{out}-ids"


def written(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all published batches of :func:`ingest_once_per_id`."""
    paths = [c.path for c in Commits(spark, out).live()]
    return spark.read.schema(_WRITTEN).parquet(*paths) if paths else spark.createDataFrame([], _WRITTEN)


def ingest_once_within(rows: DataFrame, out: str, checkpoint: str, lateness: str = "7 days") -> int:
    """Drop repeats that arrive within ``lateness`` of the newest row so far; older ids are forgotten.

    The watermark of a batch is the newest timestamp of all batches before it, less ``lateness``. Rows at or
    below it are late: they are not part of the table, but written beside it as they are (:func:`late_rows`),
    and the number of those that this run met is returned. A row in time is a repeat if its id stands in the
    table above the watermark less ``lateness``; only batches that reach so far, and of them two columns, are read.
    Rows without a valid timestamp cannot be late: they are kept once per id in ``undated_part(out)``.
    """
    spark = rows.sparkSession
    table, late = Commits(spark, out), 0
    span = F.expr(f"interval {lateness}")

    def add(batch: DataFrame, batch_id: int) -> None:
        nonlocal late
        before = [c for c in table.live() if c.facts["newest"]]
        newest = max((c.facts["newest"] for c in before), default=None)
        mark = F.lit(newest).cast("timestamp_ntz") - span
        time = F.col("timestamp")

        def write(path: str) -> dict:
            in_time = _in_file_order(batch.where(time > mark) if newest else batch)
            if newest:
                reached = [f"{c.path}/late=false" for c in _within_reach(spark, before, newest, lateness)]
                if reached:
                    known = spark.read.schema("transaction_id string, timestamp timestamp_ntz").parquet(*reached)
                    in_time = unseen(in_time, known.where(time > mark - span), "transaction_id")
            flagged = in_time.withColumn("late", F.lit(False))
            if newest:
                flagged = flagged.unionByName(batch.where(time <= mark).drop(*_ORIGIN).withColumn("late", F.lit(True)))
            flagged.write.partitionBy("late").parquet(path)
            stored = spark.read.schema("timestamp timestamp_ntz, late boolean").parquet(path)
            top, n, n_late = stored.agg(
                F.max("timestamp").cast("string"), F.count(F.lit(1)), F.count_if("late")
            ).first()
            return {"newest": max(filter(None, (top, newest)), default=None), "rows": n, "kept": n - n_late, "late": n_late}

        published = table.put(_batch(batch_id), write)
        late += published.facts["late"] if published else 0

    _drain(rows.where(F.col("timestamp").isNotNull()).writeStream.foreachBatch(add), checkpoint)
    undated = rows.where(F.col("timestamp").isNull())
    ingest_once_per_id(undated, undated_part(out), f"{checkpoint}-undated")
    return late


def _within_reach(spark: SparkSession, before: list[Commit], newest: str, lateness: str) -> list[Commit]:
    """The batches that may hold a row in the table above the watermark less ``lateness``: no more are opened."""
    span = F.expr(f"interval {lateness}")
    edge = (F.lit(newest).cast("timestamp_ntz") - span - span).cast("string")
    (near,) = spark.range(1).select(edge).first()
    return [c for c in before if c.facts["newest"] > near and c.facts["kept"]]


def once_within(spark: SparkSession, out: str) -> DataFrame:
    """The table of :func:`ingest_once_within` without its late rows."""
    return _flagged(spark, out, late=False)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that came too late for :func:`ingest_once_within`, each as often as it came."""
    return _flagged(spark, out, late=True)


def _flagged(spark: SparkSession, out: str, late: bool) -> DataFrame:
    count = "late" if late else "kept"
    paths = [f"{c.path}/late={str(late).lower()}" for c in Commits(spark, out).live() if c.facts[count]]
    return spark.read.schema(_WRITTEN).parquet(*paths) if paths else spark.createDataFrame([], _WRITTEN)


def undated_part(out: str) -> str:
    return f"{out}-undated"


_DAILY = "date date, ids bigint, amounts bigint, amount double"


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("date").agg(F.sum("ids").alias("ids"), F.sum("amounts").alias("amounts"), F.sum("amount").alias("amount"))


def maintain_daily(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Daily figures that grow with every batch; read with :func:`latest_daily`.

    Each batch publishes sums per day: counts and amounts add up, so there is no state, no watermark and no day
    that comes too late. A repeated batch adds nothing. Young batches are merged, so few are read however
    many there were. Rows without a valid timestamp belong to no day.
    """
    spark = rows.sparkSession
    table = Commits(spark, out)

    def stored(sums: DataFrame, path: str) -> dict:
        sums.write.parquet(path)
        return {"rows": spark.read.parquet(path).count()}

    def put(batch: DataFrame, batch_id: int) -> None:
        sums = keyed(with_date(batch), "date").groupBy("date").agg(
            F.count("transaction_id").alias("ids"), F.count("amount").alias("amounts"), F.sum("amount").alias("amount")
        )
        table.put(_batch(batch_id), lambda path: stored(sums, path))
        table.merge(lambda old, path: stored(_added(_daily_parts(spark, [c.path for c in old])), path))

    _drain(rows.writeStream.foreachBatch(put), checkpoint)


def _daily_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(_DAILY).parquet(*paths) if paths else spark.createDataFrame([], _DAILY)


def latest_daily(spark: SparkSession, out: str) -> DataFrame:
    """The figures per day over all batches: one row per day and live commit is read."""
    sums = _added(_daily_parts(spark, [c.path for c in Commits(spark, out).live()]))
    return sums.select(
        "date",
        F.col("ids").alias("transaction_count"),
        F.coalesce("amount", F.lit(0.0)).alias("transaction_value"),
        F.try_divide("amount", "amounts").alias("avg_transaction_value"),
    )


def maintain_profile(rows: DataFrame, out: str, checkpoint: str, texts: Sequence[str], numbers: Sequence[str]) -> None:
    """Column profiles that grow with every batch; read with :func:`latest_profile`.

    Each batch publishes one row of sketches per column, so what came before is never read again. A
    repeated batch adds nothing, and young batches are merged.
    """
    spark = rows.sparkSession
    table = Commits(spark, out)

    def stored(profile: DataFrame, path: str) -> dict:
        profile.write.parquet(path)
        return {"rows": spark.read.parquet(path).count()}

    def put(batch: DataFrame, batch_id: int) -> None:
        table.put(_batch(batch_id), lambda path: stored(sketches.profile_sketches(batch, texts, numbers), path))
        table.merge(lambda old, path: stored(sketches.merged(spark.read.parquet(*[c.path for c in old])), path))

    _drain(rows.writeStream.foreachBatch(put), checkpoint)


def latest_profile(spark: SparkSession, out: str) -> DataFrame:
    """The sketches per column over all batches; :func:`spendscope.operators.sketches.read_profile` reads them."""
    paths = [c.path for c in Commits(spark, out).live()]
    if not paths:
        raise FileNotFoundError(f"no batches in {out}")
    return sketches.merged(spark.read.parquet(*paths))
