"""Files in, files out. The files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.operators import profiling, risk
from spendscope.plans.cleaning_queries import FILLED, TIDY_SQL, fences_sql
from spendscope.plans.registry import named
from spendscope.plans.risk_queries import SCORED_SQL
from spendscope.plans.shape import shaped
from spendscope.session import fresh_path
from spendscope.sources import files, ingest, sinks
from spendscope.sources.fixtures import card_month, dirty_month, parsed, with_views
from spendscope.sources.schemas import TEXT_COLUMNS, TRANSACTION_COLUMNS

_CSV = "*.csv"


def day_files(spark, folder) -> str:
    """The clean month as CSV files, one folder per day."""
    root = fresh_path(spark, "days")
    rows = card_month(spark, folder).withColumn("day", F.to_date("timestamp"))
    # As text, because a written timestamp would lose its microseconds.
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("string"))
    sinks.write_daily_files(rows.select(*TRANSACTION_COLUMNS, "day"), root, "day")
    return root


def dirty_files(spark, folder) -> str:
    """The dirty month as CSV files, one folder per delivery and day."""
    root = fresh_path(spark, "dirty")
    raw = dirty_month(spark, folder)
    rows = raw.select(
        F.col("file_seq").alias("delivery"),
        F.coalesce(
            F.to_date(F.col("timestamp").try_cast("timestamp_ntz")).cast("string"), F.lit("undated")
        ).alias("day"),
        *TRANSACTION_COLUMNS,
    )
    sinks.write_daily_files(rows, root, "delivery", "day")
    return root


@named(
    "scan_csv_typed",
    with_views(
        "t1raw",
        f"""select {', '.join(c for c in TRANSACTION_COLUMNS if c not in ('amount', 'is_online', 'timestamp'))},
                  round(amount, 4) as amount, cast(is_online as varchar) as is_online,
                  try_cast(timestamp as timestamp) as timestamp from t1raw""",
    ),
)
def scan_csv_typed(spark, folder):
    rows = files.read_typed(spark, dirty_files(spark, folder), _CSV)
    return shaped(rows.select(*TRANSACTION_COLUMNS).withColumn("is_online", F.col("is_online").cast("string")), amount=4)


@named(
    "scan_daily_tree",
    with_views(
        "t1",
        """select cast(cast(timestamp as date) as varchar) as source_day, cast(count(*) as bigint) as row_count,
                  round(sum(amount), 2) as total_amount from t1 group by 1""",
    ),
)
def scan_daily_tree(spark, folder):
    """Files found below the root, with the day taken from the folder name."""
    rows = files.read_raw(spark, day_files(spark, folder), _CSV)
    per_day = rows.groupBy("source_day").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("amount").alias("total_amount")
    )
    return shaped(per_day, total_amount=2)


@named("scan_first_n_files")
def scan_first_n_files(spark, folder):
    rows = files.read_first_files(spark, day_files(spark, folder), 3, _CSV)
    return rows.select("transaction_id", F.col("source_day").cast("string").alias("source_day"))


@named(
    "file_row_counts",
    with_views(
        "t1",
        """select cast(cast(timestamp as date) as varchar) as source_day, cast(count(*) as bigint) as row_count
           from t1 group by 1""",
    ),
)
def file_row_counts(spark, folder):
    """Rows per file, added up per day as a large day has several files."""
    counts = files.row_counts(spark, day_files(spark, folder), _CSV)
    return shaped(counts.groupBy("source_day").agg(F.sum("row_count").alias("row_count")))


@named("file_manifest")
def file_manifest(spark, folder):
    found = files.manifest(spark, day_files(spark, folder), _CSV)
    return shaped(found.select("source_day", "length", "row_count", "sha256", "is_valid"))


@named(
    "scan_parquet",
    with_views(
        "t1", f"select {', '.join(c for c in TRANSACTION_COLUMNS if c != 'amount')}, round(amount, 4) as amount from t1"
    ),
)
def scan_parquet(spark, folder):
    out = fresh_path(spark, "table")
    card_month(spark, folder).write.parquet(out)
    rows = files.read_processed(spark, out)
    return shaped(rows.select(*TRANSACTION_COLUMNS), amount=4)


@named(
    "scan_common_columns",
    with_views(
        "t1",
        """select transaction_id, user_id, round(amount, 4) as amount, timestamp, cast(hour(timestamp) as bigint) as hour,
                  cast(cast(timestamp as date) as varchar) as date from t1""",
    ),
)
def scan_common_columns(spark, folder):
    """Two deliveries of a table by day, with different columns and widths of numbers, read with what they share."""
    out = fresh_path(spark, "drift")
    rows = card_month(spark, folder).withColumn("date", F.to_date("timestamp"))
    number = F.col("transaction_id").cast("bigint")
    shared = ["transaction_id", "user_id", "amount", "timestamp", "date"]
    for part, other, kind in ((number % 2 == 0, "currency", "int"), (number % 2 == 1, "status", "bigint")):
        delivered = rows.where(part).select(*shared, other, F.hour("timestamp").cast(kind).alias("hour"))
        sinks.write_processed(delivered, out, mode="append")
    return shaped(files.read_common_columns(spark, out), amount=4)


@named(
    "sink_parquet_roundtrip",
    with_views(
        "t1",
        """select transaction_id, round(amount, 4) as amount, cast(cast(timestamp as date) as varchar) as date from t1""",
    ),
)
def sink_parquet_roundtrip(spark, folder):
    out = fresh_path(spark, "processed")
    rows = card_month(spark, folder).withColumn("date", F.to_date("timestamp"))
    sinks.write_processed(rows, out)
    return shaped(files.read_processed(spark, out).select("transaction_id", "amount", "date"), amount=4)


@named(
    "sink_append",
    with_views(
        "t1raw",
        """select cast(count(*) as bigint) as row_count, cast(count(distinct transaction_id) as bigint) as ids
           from t1raw""",
    ),
)
def sink_append(spark, folder):
    """Two appends, the second one tried again as after a failure."""
    out = fresh_path(spark, "appended")
    rows = parsed(dirty_month(spark, folder)).withColumn("date", F.to_date("timestamp"))
    for name, part in (("1", "file_seq = 1"), ("2", "file_seq = 2"), ("2", "file_seq = 2")):
        sinks.append_processed(rows.where(part), out, name)
    return sinks.read_appended(spark, out).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("transaction_id").alias("ids")
    )


@named(
    "sink_suspicious_csv",
    with_views(
        "t1",
        f"""with {SCORED_SQL} select transaction_id, user_id, cast(risk_score as varchar) as risk_score, round(amount, 4) as amount,
        round(z, 6) as amount_zscore, merchant_id, merchant_category, location_country, location_city, timestamp
        from scored where risk_score >= 4 order by scored.risk_score desc, z desc, transaction_id limit 1000""",
    ),
)
def sink_suspicious_csv(spark, folder):
    out = fresh_path(spark, "report")
    # As text, because a written timestamp would lose its microseconds.
    report = risk.suspicious_report(card_month(spark, folder)).withColumn("timestamp", F.col("timestamp").cast("string"))
    sinks.write_report(report, out)
    read = spark.read.option("header", True).csv(out)
    numbers = {c: F.col(c).cast("double") for c in ("amount", "amount_zscore")}
    return shaped(read.withColumns(numbers).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), amount=4)


@named(
    "profile_by_file",
    with_views(
        "t1",
        "with v as (select cast(cast(timestamp as date) as varchar) as source_day, c as column_name, v as value from (unpivot (select timestamp, "
        + ", ".join(f"cast({c} as varchar) as {c}" for c in TEXT_COLUMNS)
        + f" from t1) on {', '.join(TEXT_COLUMNS)} into name c value v))"
        + """ select source_day, column_name, cast(count(distinct value) as bigint) as distinct_values,
             cast(count(*) as bigint) as non_null_values, 'string' as data_type,
             round(count(distinct value) * 100.0 / count(*), 6) as unique_pct from v group by 1, 2""",
    ),
)
def profile_by_file(spark, folder):
    """Each daily file has a profile of its own."""
    rows = files.read_raw(spark, day_files(spark, folder), _CSV)
    return shaped(profiling.distinct_profile(rows, TEXT_COLUMNS, ["source_day"]))


_FIRST = """first_rows as (select * exclude (nth) from (
  select *, row_number() over (partition by transaction_id order by file_seq) as nth from flagged) where nth = 1)"""


@named(
    "ingest_processed",
    with_views(
        "t1raw",
        f"""with {FILLED} {fences_sql('filled')},
        flagged as (select filled.*, amount > high as is_amount_outlier from filled, fence), {_FIRST}
        select transaction_id, user_id, {TIDY_SQL}, round(amount, 2) as amount, missing_amount, is_online,
               is_amount_outlier, timestamp, coalesce(cast(isodow(timestamp) - 1 as int), -1) as day_of_week,
               coalesce(isodow(timestamp) >= 6, false) as is_weekend,
               coalesce(cast(hour(timestamp) as int), -1) as hour,
               case when hour(timestamp) < 6 then 'night' when hour(timestamp) < 12 then 'morning'
                    when hour(timestamp) < 18 then 'afternoon' when hour(timestamp) >= 18 then 'evening'
                    else 'unknown' end as time_period,
               coalesce(cast(date_diff('day', cast(timestamp as date), date '2024-03-01') as int), -1)
                 as days_since_transaction,
               amount > 1000 and is_online as high_value_online
        from first_rows""",
    ),
)
def ingest_processed(spark, folder):
    """The whole ingest: files to the processed table."""
    out = fresh_path(spark, "processed")
    ingest.ingest_files(spark, dirty_files(spark, folder), out, _CSV, F.lit("2024-03-01").cast("date"))
    rows = files.read_processed(spark, out).select(
        "transaction_id", "user_id", *TEXT_COLUMNS, "amount", "missing_amount", "is_online", "is_amount_outlier",
        "timestamp", "day_of_week", "is_weekend", "hour", "time_period", "days_since_transaction",
        "high_value_online",
    )
    return shaped(rows.fillna(-1, ["day_of_week", "hour", "days_since_transaction"]), amount=2)


@named(
    "ingest_run_stats",
    with_views(
        "t1raw",
        """with first_rows as (select * from (select *, row_number() over (partition by transaction_id
             order by file_seq) as nth from t1raw) where nth = 1)
        select cast(count(*) as bigint) as rows_read,
               cast((select count(*) from first_rows) as bigint) as rows_written,
               cast(count(*) - (select count(*) from first_rows) as bigint) as duplicates_removed,
               cast(count(*) - count(amount) as bigint) as missing_amounts,
               cast((select count(*) filter (try_cast(timestamp as timestamp) is null) from first_rows) as bigint)
                 as bad_timestamps
        from t1raw""",
    ),
)
def ingest_run_stats(spark, folder):
    out = fresh_path(spark, "processed")
    return ingest.ingest_files(spark, dirty_files(spark, folder), out, _CSV)
