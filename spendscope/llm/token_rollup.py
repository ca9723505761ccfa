"""Token totals kept up to date by signed changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spendscope.sources.commits import Commits

KEYS = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens"]
_STORED = StructType([StructField(k, StringType()) for k in KEYS] + [StructField(s, LongType()) for s in SUMS])

# The pieces that two versions of a plain tokenizer count.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-2": r"[0-9]{1,3}|[A-Za-z\x{0080}-\x{10FFFF}]+|[^\x20\x09-\x0D0-9A-Za-z\x{0080}-\x{10FFFF}]",
}


def count_pieces(text: Column, version: str) -> Column:
    """Tokens of a text by one of the plain tokenizers; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def count_vocabulary(docs: DataFrame, vocabulary: str, column: str = "n_tokens") -> DataFrame:
    """``docs`` without its text, plus the number of tokens by a tokenizer file (``*.json``); null has none.

    Each task reads the file from ``vocabulary``, which all executors must reach. The columns ``doc_id,
    source, lang`` are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for batch in batches:
            counts = [len(tokenizer.encode(t or "", add_special_tokens=False)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "source", "lang")), pa.array(counts, pa.int64())],
                ["doc_id", "source", "lang", column],
            )

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(
        run, f"doc_id bigint, source string, lang string, {column} bigint"
    )


def inserted(rows: DataFrame, tokens: Column) -> DataFrame:
    """Changes that add documents: ``source, lang, version`` are taken from ``rows``."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def deleted(rows: DataFrame, tokens: Column) -> DataFrame:
    """Changes that take documents out, with the count under which they came in."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-tokens).cast("long").alias("n_tokens"))


def revised(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """Changes that correct a count and leave the number of documents."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (after - before).cast("long").alias("n_tokens"))


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder that all executors share.

    Each batch of changes is summed per key, written aside and published at once. A batch that is committed
    again - a retried job, a replayed stream - changes nothing, whether it would now succeed or fail; a
    batch that broke off is not published and may be tried again. Names of batches ascend. Totals are the sums over
    the published batches, of which young ones are merged, so few files are read however many there were.

    Nulls in a key are a group of their own; null counts count as nothing; repeated rows are repeated
    changes; other columns are not read; no batches or empty ones give no totals.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.published = Commits(spark, self.folder)

    def _stored(self, summed: DataFrame, path: str) -> dict:
        summed.write.parquet(path)
        return {"rows": self.spark.read.parquet(path).count()}

    def _summed(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _STORED)
        stored = self.spark.read.schema(_STORED).parquet(*paths)
        summed = stored.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return summed.where("n_docs != 0 or n_tokens != 0")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Publish one batch; a name that is there already adds nothing. One row per key, so the files stay small."""
        summed = changes.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS])
        changed = summed.where("n_docs != 0 or n_tokens != 0")
        self.published.put(batch, lambda path: self._stored(changed, path))
        self.published.merge(lambda old, path: self._stored(self._summed([c.path for c in old]), path))

    def batches(self) -> list[str]:
        """Names of the published batches."""
        return [name for commit in self.published.live() for name in commit.names]

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens``; keys whose documents are all gone have no row."""
        return self._summed([c.path for c in self.published.live()])
