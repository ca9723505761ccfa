"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_fallback: dict[str, str] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def build_session(app: str = "spendscope", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``master`` is given in tests and benches only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without it; there one temporary folder per
    application stands in.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app_id = spark.sparkContext.applicationId
    if app_id not in _fallback:
        _fallback[app_id] = tempfile.mkdtemp(prefix="spendscope-")
    return _fallback[app_id]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used before."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    held = _scratch.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is settled within the block is deleted when it ends: for jobs that have written their result by then."""
    token = _scratch.set([])
    try:
        yield
    finally:
        held = _scratch.get()
        _scratch.reset(token)
        for path in held or []:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so iterative jobs
    and several passes over one expensive result do not recompute it. It stays for as long as the result may be
    read; a job that ends with a write can run within :func:`scratch`, which deletes it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
