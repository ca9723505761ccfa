"""Which ids have been seen before, answered from small filters and the few buckets that they point at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.sources.commits import Commits

SEGMENT_BITS = 1 << 15  # of one bitmap, as Spark's bitmap functions have it
BITS_AN_ID = 24
PROBES = 4  # bits of an id in its segment; some 6 in 10,000 unknown ids find all of theirs set
IDS_A_BUCKET = 200_000


def _bucket(hashed: Column, buckets: Column) -> Column:
    return F.pmod(F.shiftright(hashed, 32), buckets)


def _segment(hashed: Column, segments: Column) -> Column:
    return F.pmod(hashed, segments)


def _places(name: str) -> Column:
    """The bits of an id within its segment."""
    hashed = F.xxhash64(F.lit(PROBES), name)
    return F.array(*[F.shiftrightunsigned(hashed, 15 * k).bitwiseAND(SEGMENT_BITS - 1) for k in range(PROBES)])


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place % 8) == 1


class IdIndex:
    """Ids of text, added batch by batch.

    Each batch keeps its distinct ids in hash buckets of some ``IDS_A_BUCKET`` and a filter of ``BITS_AN_ID`` bits per
    id beside them, cut into segments that rows find by hash. A question reads filters, then only buckets in
    which an id may be. Young batches are merged, so their number stays small. Null ids are never seen.
    """

    def __init__(self, spark: SparkSession, folder: str, ids_a_bucket: int = IDS_A_BUCKET):
        self.spark, self.ids_a_bucket = spark, ids_a_bucket
        self.commits = Commits(spark, folder)

    def _write(self, ids: DataFrame, path: str) -> dict:
        distinct = ids.where(F.col("id").isNotNull()).distinct()
        n = distinct.count()
        buckets = max(1, n // self.ids_a_bucket)
        segments = max(1, -(-n * BITS_AN_ID // SEGMENT_BITS))
        placed = distinct.withColumn("bucket", _bucket(F.xxhash64("id"), F.lit(buckets)))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/ids")
        stored = self._ids([path])
        bits = stored.select(_segment(F.xxhash64("id"), F.lit(segments)).alias("segment"), F.explode(_places("id")).alias("place"))
        filters = bits.groupBy("segment").agg(F.bitmap_construct_agg("place").alias("bits"))
        filters.write.parquet(f"{path}/filters")
        return {"rows": n, "buckets": buckets, "segments": segments}

    def add(self, name: str, ids: DataFrame) -> None:
        """Add a batch of ``ids (id)``; a name that is there already adds nothing."""
        self.commits.put(name, lambda path: self._write(ids, path))
        self.commits.merge(lambda old, path: self._write(self._ids([c.path for c in old]), path))

    def _ids(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema("id string").option("recursiveFileLookup", True)
        return reader.parquet(*[f"{path}/ids" for path in paths])

    def seen(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids (id)`` that some batch holds, once each."""
        live = [c for c in self.commits.live() if c.facts["rows"]]
        asked = ids.where(F.col("id").isNotNull()).distinct()
        if not live:
            return asked.limit(0)
        sizes = F.array(*[
            F.struct(F.lit(k).alias("part"), F.lit(c.facts["segments"]).alias("segments"), F.lit(c.facts["buckets"]).alias("buckets"))
            for k, c in enumerate(live)
        ])
        each = asked.select("id", F.xxhash64("id").alias("hashed"), F.explode(sizes).alias("p")).select(
            "id", "p.part", _segment(F.col("hashed"), F.col("p.segments")).alias("segment"),
            _bucket(F.col("hashed"), F.col("p.buckets")).alias("bucket"),
        )
        filters = None
        for k, commit in enumerate(live):
            own = self.spark.read.schema("segment bigint, bits binary").parquet(f"{commit.path}/filters")
            own = own.withColumn("part", F.lit(k))
            filters = own if filters is None else filters.unionByName(own)
        maybe = each.join(filters, ["part", "segment"]).where(F.forall(_places("id"), lambda p: _is_set(F.col("bits"), p)))
        pointed = maybe.groupBy("part", "bucket").agg(F.lit(1)).collect()
        paths = [f"{live[r['part']].path}/ids/bucket={r['bucket']}" for r in pointed]
        if not paths:
            return asked.limit(0)
        opened = self.spark.read.schema("id string").parquet(*sorted(paths))
        return asked.join(opened, "id", "left_semi")
