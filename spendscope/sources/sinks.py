"""Writes: the processed table, reports and daily files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendscope.sources.commits import Commits


def write_processed(rows: DataFrame, folder: str, by: str = "date", mode: str = "overwrite") -> None:
    """Parquet with one folder per day.

    The rebalance hint gathers a day in few files of even size and splits a day
    that is too large for one task. ``mode='append'`` adds files; nothing already
    written is read or rewritten.
    """
    rows.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(folder)


def append_processed(rows: DataFrame, folder: str, name: str, by: str = "date") -> int | None:
    """Add a batch to a table of batches, one folder per day in each; the rows added, or None if ``name`` was there.

    A batch counts when it is complete and counts once: broken and repeated appends leave the table as it is.
    Names sort in the order of the appends. Read the table with :func:`read_appended`.
    """
    spark = rows.sparkSession

    def write(path: str) -> dict:
        write_processed(rows, path, by)
        return {"rows": spark.read.parquet(path).count()}

    added = Commits(spark, folder).put(name, write)
    return added.facts["rows"] if added else None


def read_appended(spark: SparkSession, folder: str) -> DataFrame:
    """All batches of :func:`append_processed`, with the partition column."""
    paths = [c.path for c in Commits(spark, folder).live()]
    if not paths:
        raise FileNotFoundError(f"no batches in {folder}")
    return spark.read.option("basePath", f"{folder.rstrip('/')}/data").parquet(*paths).drop("batch")


def write_report(report: DataFrame, folder: str) -> None:
    """One CSV file with header; for reports that are limited to a fixed number of rows."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_daily_files(rows: DataFrame, root: str, *by: str) -> None:
    """CSV files with header in one folder per value of ``by``, text kept as it is."""
    writer = rows.hint("rebalance", *by).write.partitionBy(*by).option("header", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
