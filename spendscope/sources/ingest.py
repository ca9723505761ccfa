"""The ingest job and what is left to ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.operators.cleaning import fill_gaps, read_timestamps, tidy_text
from spendscope.operators.dedup import keep_first
from spendscope.operators.features import ingest_features
from spendscope.operators.quantiles import iqr_fences, one_row
from spendscope.session import scratch, settle
from spendscope.sources.files import FILE_NAME, FILE_ORDER, read_raw
from spendscope.sources.sinks import write_processed


def pending_dates(wanted: DataFrame, completed: DataFrame, validated: DataFrame) -> DataFrame:
    """Wanted days not completed (``ingest``), and completed but not validated (``validate``)."""
    to_ingest = wanted.join(completed, "date", "left_anti").withColumn("step", F.lit("ingest"))
    to_validate = (
        wanted.join(completed, "date", "left_semi")
        .join(validated, "date", "left_anti")
        .withColumn("step", F.lit("validate"))
    )
    return to_ingest.unionByName(to_validate)


def ingest_files(
    spark: SparkSession, root: str, out: str, pattern: str = FILE_NAME, as_of: Column | None = None
) -> DataFrame:
    """Read, clean, deduplicate and enrich all files below ``root`` into Parquet at ``out``.

    Returns one row of run statistics. They are counted from what was written, so tasks that ran twice
    count once: rows read and missing amounts from the amounts, which are set aside by themselves as the
    outlier bound needs them several times; the others from one column of the table.
    """
    raw = read_raw(spark, root, pattern)
    with scratch(spark):
        amounts = settle(raw.select("amount"), "amounts")
        cleaned = keep_first(_flagged(raw, amounts), "transaction_id", [F.col(c) for c in FILE_ORDER])
        processed = ingest_features(cleaned, as_of).withColumn("date", F.to_date("timestamp"))
        write_processed(processed.drop(*FILE_ORDER), out)
        n_read, missing = amounts.agg(F.count(F.lit(1)), F.count_if(F.col("amount").isNull())).first()
    table = spark.read.schema("timestamp timestamp_ntz").parquet(out)
    n_written, bad = table.agg(F.count(F.lit(1)), F.count_if(F.col("timestamp").isNull())).first()
    return spark.createDataFrame(
        [(n_read, n_written, n_read - n_written, missing, bad)],
        "rows_read bigint, rows_written bigint, duplicates_removed bigint, missing_amounts bigint,"
        " bad_timestamps bigint",
    )


def _flagged(rows: DataFrame, for_bounds: DataFrame) -> DataFrame:
    """Tidied rows with the outlier flag; ``for_bounds`` has all amounts."""
    bound = one_row(iqr_fences(fill_gaps(for_bounds), "amount"))["high"]
    filled = fill_gaps(tidy_text(read_timestamps(rows)))
    return filled.withColumn("is_amount_outlier", F.col("amount") > bound)
