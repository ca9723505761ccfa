"""Transaction files: discovery, typed reads, manifests and processed Parquet."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from spendscope.functions.calendar import parse_timestamp
from spendscope.session import settle
from spendscope.sources.schemas import MERCHANT_REFERENCE, RAW_TRANSACTIONS

FILE_NAME = "transactions.csv"
MIN_BYTES = 1000
MAX_HASHED_BYTES = 2**31 - 1  # a binary value cannot be longer
PIECE_BYTES = 8 << 20  # of a file that are in memory at once


def day_in_path(path: Column) -> Column:
    """The first yyyy-mm-dd folder in a path as a date; null without one."""
    text = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/]*/", 1)
    return text.try_cast("date")


def _csv(spark: SparkSession, paths: str | list[str], pattern: str | None) -> DataFrame:
    reader = spark.read.schema(RAW_TRANSACTIONS).option("header", True)
    if pattern:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.csv(paths)


def _with_origin(raw: DataFrame) -> DataFrame:
    """Source file, its day and the position of the row in it.

    Row ids grow along a partition, so file, block and id order the rows of a file
    as they stand in it.
    """
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        day_in_path(F.col("_metadata.file_path")).alias("source_day"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    )


# Keep-first order of rows read by read_raw.
FILE_ORDER = ("source_file", "source_block", "source_row")


def read_raw(spark: SparkSession, root: str, pattern: str = FILE_NAME) -> DataFrame:
    """All files of that name below ``root``; the timestamp is still text."""
    return _with_origin(_csv(spark, root, pattern))


def read_typed(spark: SparkSession, root: str, pattern: str = FILE_NAME) -> DataFrame:
    """As :func:`read_raw` with parsed timestamps, bad ones null."""
    return read_raw(spark, root, pattern).withColumn("timestamp", parse_timestamp(F.col("timestamp")))


def list_files(spark: SparkSession, root: str, pattern: str = FILE_NAME) -> DataFrame:
    """Path and size of the files; their content is not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return listing.option("pathGlobFilter", pattern).load(root).select("path", "length")


def read_first_files(spark: SparkSession, root: str, n: int, pattern: str = FILE_NAME) -> DataFrame:
    """Rows of the first ``n`` files in path order; the other files are not opened."""
    first = list_files(spark, root, pattern).orderBy("path").limit(n).collect()
    if not first:
        raise FileNotFoundError(f"no {pattern} below {root}")
    return _with_origin(_csv(spark, [row["path"] for row in first], None))


def row_counts(spark: SparkSession, root: str, pattern: str = FILE_NAME) -> DataFrame:
    raw = read_raw(spark, root, pattern)
    return raw.groupBy("source_file", "source_day").agg(F.count(F.lit(1)).alias("row_count"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that Spark listed, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path)


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each file, read in pieces; null where its store cannot be opened outside Spark."""

    def digest(path: str) -> str | None:
        try:
            store, place = _store(path)
            found = hashlib.sha256()
            with store.open_input_stream(place) as stream:
                while piece := stream.read(PIECE_BYTES):
                    found.update(piece)
            return found.hexdigest()
        except (OSError, ValueError):  # pyarrow's errors are kinds of these
            return None

    for batch in batches:
        yield batch.assign(sha256=[digest(path) for path in batch["path"]])


def manifest(
    spark: SparkSession, root: str, pattern: str = FILE_NAME, min_bytes: int = MIN_BYTES, most_whole: int = MAX_HASHED_BYTES
) -> DataFrame:
    """Per file: day, size, rows, SHA-256 of the bytes and whether it is usable.

    A file is usable with at least ``min_bytes`` bytes, one data row and a hash. A task reads a file of any
    size in pieces of some megabytes. Only in stores that nothing but Spark opens a file is read
    as one value, if it has no more than ``most_whole`` bytes; a larger one has no hash there.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    binary = listing.option("pathGlobFilter", pattern).load(root)
    hashed = binary.select("path", "length").mapInPandas(_digested, "path string, length bigint, sha256 string")
    hashed = settle(hashed, "hashes")
    closed = hashed.where(F.col("sha256").isNull() & (F.col("length") <= most_whole))
    if closed.limit(1).count():
        whole = binary.where(F.col("length") <= most_whole).select("path", F.sha2("content", 256).alias("whole"))
        hashed = hashed.join(whole, "path", "left").select("path", "length", F.coalesce("sha256", "whole").alias("sha256"))
    files = hashed.withColumnRenamed("path", "source_file")
    rows = row_counts(spark, root, pattern).select("source_file", "row_count")
    files = files.join(rows, "source_file", "left")
    count = F.coalesce("row_count", F.lit(0))
    return files.withColumn("source_day", day_in_path(F.col("source_file"))).withColumns(
        {
            "row_count": count,
            "is_valid": (F.col("length") >= min_bytes) & (count > 0) & F.col("sha256").isNotNull(),
        }
    )


def read_processed(spark: SparkSession, folder: str, n_files: int | None = None) -> DataFrame:
    """The processed Parquet table, or the rows of its first ``n_files`` files."""
    if n_files is None:
        try:
            return spark.read.parquet(folder)
        except AnalysisException as error:
            raise FileNotFoundError(f"no Parquet files in {folder}") from error
    first = list_files(spark, folder, "*.parquet").orderBy("path").limit(n_files).collect()
    if not first:
        raise FileNotFoundError(f"no Parquet files in {folder}")
    reader = spark.read.option("basePath", folder)
    return reader.parquet(*[row["path"] for row in first])


def _schemas_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The schema of each file as JSON, from its footer; null where its store cannot be opened outside Spark."""

    def schema(path: str) -> str | None:
        try:
            store, place = _store(path)
            found = pq.read_schema(place, filesystem=store)
        except (OSError, ValueError):
            return None
        told = (found.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
        return told.decode() if told else from_arrow_schema(found, prefer_timestamp_ntz=True).json()

    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "schema": [schema(path) for path in batch["path"]]})


# Numeric types from narrow to wide, as far as each holds all values of those before it.
_WIDER = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()), (T.FloatType(), T.DoubleType()), (T.IntegerType(), T.DoubleType())


def _widened(kinds: Sequence[T.DataType], name: str) -> T.DataType:
    """The narrowest type that holds the values of all ``kinds``."""
    distinct = list(dict.fromkeys(kinds))
    if len(distinct) == 1:
        return distinct[0]
    for line in _WIDER:
        if all(k in line for k in distinct):
            return max(distinct, key=line.index)
    said = ", ".join(k.simpleString() for k in distinct)
    raise ValueError(f"column {name} has types that no common one holds: {said}")


def _partition_keys(path: Column, folder: str) -> Column:
    """Names of the ``key=value`` folders of a path below ``folder``, in order."""
    place = re.escape(re.sub(r"^[a-zA-Z0-9+.-]+:(//[^/]*)?", "", folder.rstrip("/")))
    below = F.regexp_replace(F.regexp_extract(path, f"{place}/(.*)$", 1), "[^/]*$", "")
    return F.regexp_extract_all(below, F.lit("([^/=]+)=[^/]*/"), 1)


def read_common_columns(spark: SparkSession, folder: str, looked_at: int | None = None) -> DataFrame:
    """All Parquet files, with the columns that they have in common, partition columns of folders included.

    The footers of all files are read in tasks, and one row per distinct schema and list of partition folders
    reaches the driver; ``looked_at`` limits the files, for tables known to be alike. A column whose files have numbers
    of several widths gets the widest. Files below folders that not all files have in common are read
    without these. In stores that only Spark opens, the driver asks Spark for the schema of one
    file after the other.
    """
    listed = list_files(spark, folder, "*.parquet").select("path")
    listed = listed.orderBy("path").limit(looked_at) if looked_at else listed
    seen = listed.mapInPandas(_schemas_of, "path string, schema string")
    distinct = seen.groupBy("schema", _partition_keys(F.col("path"), folder).alias("keys"))
    sets = distinct.agg(F.collect_list(F.when(F.col("schema").isNull(), F.col("path"))).alias("closed"), F.min("path").alias("first"))
    found = sorted(sets.collect(), key=lambda r: r["first"])
    if not found:
        raise FileNotFoundError(f"no Parquet files in {folder}")
    schemas = [T.StructType.fromJson(json.loads(r["schema"])) for r in found if r["schema"]]
    schemas += [spark.read.parquet(path).schema for r in found for path in r["closed"]]
    shared = [n for n in schemas[0].names if all(n in s.names for s in schemas)]
    wanted = T.StructType([T.StructField(n, _widened([s[n].dataType for s in schemas], n)) for n in shared])
    keys = found[0]["keys"]
    if keys and all(r["keys"] == keys for r in found):
        # Spark finds the values and types of the partition columns in the folders.
        kinds = spark.read.schema(wanted).parquet(folder).schema
        both = T.StructType(wanted.fields + [f for f in kinds.fields if f.name in keys and f.name not in shared])
        return spark.read.schema(both).parquet(folder)
    return spark.read.schema(wanted).option("recursiveFileLookup", True).parquet(folder)


def read_merchant_reference(spark: SparkSession, path: str) -> DataFrame | None:
    """The merchant reference file, or None when it cannot be read."""
    try:
        found = spark.read.option("header", True).csv(path)
        columns = [c for c in MERCHANT_REFERENCE.names if c in found.columns]
        return found.select(*columns) if columns else None
    except AnalysisException:
        return None
