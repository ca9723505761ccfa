"""Batches that count once, the index of ids, and what streams read of their past."""

import pytest
from pyspark.sql import functions as F

from spendscope.session import fresh_path, scratch, settle
from spendscope.sources.commits import Commit, Commits
from spendscope.sources.id_index import IdIndex
from spendscope.streaming import increments
from test_files import deliver, line


def put(table, k, n=1):
    def write(path):
        table.spark.range(n).write.parquet(path)
        return {"rows": n}

    return table.put(f"{k:04d}", write)


def merged(table):
    def write(old, path):
        table.spark.read.parquet(*[c.path for c in old]).coalesce(1).write.parquet(path)
        return {"rows": sum(c.facts["rows"] for c in old)}

    return table.merge(write)


def test_a_batch_counts_once(spark):
    table = Commits(spark, fresh_path(spark, "c"))
    assert not table.live() and not table.holds("0001")
    assert put(table, 1, 3).facts == {"rows": 3}
    assert put(table, 1, 5) is None
    assert [c.facts["rows"] for c in table.live()] == [3]


def test_a_broken_attempt_is_not_read(spark):
    table = Commits(spark, fresh_path(spark, "c"))
    put(table, 1, 3)

    def broken(path):
        spark.range(4, numPartitions=4).select(F.raise_error(F.when(F.col("id") == 3, "x").otherwise("y"))).write.parquet(path)

    def late(path):
        spark.range(9).write.parquet(path)
        raise RuntimeError("after the write")

    for attempt in (broken, late):
        with pytest.raises(Exception):
            table.put("0002", attempt)
        assert [c.facts["rows"] for c in table.live()] == [3]
    assert put(table, 2, 2) and [c.facts["rows"] for c in table.live()] == [3, 2]
    assert table.sweep() >= 1
    assert spark.read.parquet(*[c.path for c in table.live()]).count() == 5


def test_few_commits_are_read_after_many_batches(spark):
    table = Commits(spark, fresh_path(spark, "c"))
    for k in range(50):
        put(table, k)
        merged(table)
        assert len(table.live()) <= 8 + 3
    assert all(table.holds(f"{k:04d}") for k in range(50)) and not table.holds("0050")
    assert put(table, 7) is None
    with pytest.raises(ValueError, match="comes after"):
        table.put("0007b", lambda path: {"rows": 0})
    assert spark.read.parquet(*[c.path for c in table.live()]).count() == 50


def test_scratch_is_gone_after_the_block(spark):
    import os

    with pytest.raises(ValueError), scratch(spark):
        kept = settle(spark.range(3), "scratch-test").inputFiles()[0]
        raise ValueError
    stays = settle(spark.range(3), "stays").inputFiles()[0]
    assert not os.path.exists(os.path.dirname(kept.removeprefix("file://"))) and os.path.exists(stays.removeprefix("file://"))


def ids(spark, *numbers):
    return spark.createDataFrame([(None if n is None else f"id-{n}",) for n in numbers], "id string")


def test_index_knows_exactly_what_was_added(spark):
    index = IdIndex(spark, fresh_path(spark, "i"), ids_a_bucket=100)
    assert index.seen(ids(spark, 1, None)).count() == 0
    index.add("0000", spark.range(5000).select(F.concat(F.lit("id-"), "id").alias("id")))
    index.add("0000", ids(spark, 9999))
    index.add("0001", ids(spark, 7000, 7000, None))
    index.add("0002", ids(spark))
    asked = spark.range(0, 20_000, 3).select(F.concat(F.lit("id-"), "id").alias("id"))
    found = {r["id"] for r in index.seen(asked.union(asked).union(ids(spark, None, 7000))).collect()}
    assert found == {f"id-{n}" for n in range(0, 5000, 3)} | {"id-7000"}


def test_few_repeats_open_few_buckets(spark):
    index = IdIndex(spark, fresh_path(spark, "i"), ids_a_bucket=500)
    index.add("0000", spark.range(50_000).select(F.concat(F.lit("id-"), "id").alias("id")))
    asked = spark.range(50_000, 53_000).select(F.concat(F.lit("id-"), "id").alias("id")).union(ids(spark, 17, 4711))
    found = index.seen(asked)
    assert sorted(r["id"] for r in found.collect()) == ["id-17", "id-4711"]
    opened = [f for f in found.inputFiles() if "/ids/" in f]
    read = spark.read.schema("id string").parquet(*opened).count()
    assert 2 <= read <= 50_000 * 0.2  # of a hundred buckets those of two repeats and of some false hits


def test_merged_index_is_the_same(spark):
    index = IdIndex(spark, fresh_path(spark, "i"), ids_a_bucket=5)
    for k in range(20):
        index.add(f"{k:04d}", ids(spark, *range(10 * k, 10 * k + 10)))
    assert len(index.commits.live()) < 12
    found = {r["id"] for r in index.seen(ids(spark, *range(150, 260))).collect()}
    assert found == {f"id-{n}" for n in range(150, 200)}


def test_three_deliveries_read_little_of_the_past(spark, tmp_path):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    deliver(root, 0, [line(k) for k in range(2000)])
    deliver(root, 1, [line(k) for k in range(1990, 2300)])
    for number, more in ((0, None), (2, [line(5), line(9000)])):
        if more:
            deliver(root, number, more)
        increments.ingest_once_per_id(increments.incoming(spark, str(root), files_per_batch=1), out, progress, 20)
    rows = increments.written(spark, out)
    assert sorted(int(r["transaction_id"]) for r in rows.collect()) == [*range(2300), 9000]
    index = IdIndex(spark, increments.index_part(out), 20)
    opened = [f for f in index.seen(ids(spark).union(spark.createDataFrame([("5",), ("9001",)], "id string"))).inputFiles() if "/ids/" in f]
    assert 0 < spark.read.schema("id string").parquet(*opened).count() < 200


def test_a_batch_without_its_ids_is_completed(spark, tmp_path, monkeypatch):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    deliver(root, 0, [line(1), line(2)])
    stream = increments.incoming(spark, str(root))
    with monkeypatch.context() as patch:
        patch.setattr(IdIndex, "add", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            increments.ingest_once_per_id(stream, out, progress)
    deliver(root, 1, [line(2), line(3)])
    increments.ingest_once_per_id(stream, out, progress)
    assert sorted(r["transaction_id"] for r in increments.written(spark, out).collect()) == ["1", "2", "3"]


def test_late_rows_are_kept_aside_and_counted(spark, tmp_path):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    deliveries = [
        ([line(1, "1.00", "2024-03-01 00:00:00"), line(2, "1.00", "2024-01-01 00:00:00")], 0),
        ([line(3, "1.00", "2024-02-23 00:00:00"), line(3, "1.00", "2024-02-23 00:00:00"), line(1, "2.00", "2024-03-02 00:00:00")], 2),
        ([line(2, "3.00", "2024-02-27 00:00:00"), line(4, "3.00", "2024-02-23 00:00:01"), line(4, "3.00", "2024-02-23 00:00:02")], 0),
    ]
    for number, (lines, late) in enumerate(deliveries):
        deliver(root, number, lines)
        stream = increments.incoming(spark, str(root))
        assert increments.ingest_once_within(stream, out, progress, "7 days") == late
    assert increments.ingest_once_within(stream, out, progress, "7 days") == 0
    assert [r["transaction_id"] for r in increments.late_rows(spark, out).collect()] == ["3", "3"]
    kept = sorted((r["transaction_id"], r["amount"]) for r in increments.once_within(spark, out).collect())
    assert kept == [("1", 1.0), ("2", 1.0), ("2", 3.0), ("4", 3.0)]  # the id 2 of January is forgotten


def test_daily_figures_of_many_batches(spark, tmp_path):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    for k in range(50):
        deliver(root, k, [line(k, "2.00", f"2024-01-{k % 9 + 1:02d} 00:00:00")])
    increments.maintain_daily(increments.incoming(spark, str(root), files_per_batch=1), out, progress)
    assert len(Commits(spark, out).live()) <= 12
    figures = {str(r["date"]): r["transaction_count"] for r in increments.latest_daily(spark, out).collect()}
    assert sum(figures.values()) == 50 and figures["2024-01-01"] == 6


def test_only_batches_in_reach_are_opened(spark):
    """A batch whose newest row is not above the watermark less the lateness holds no repeat in time."""
    days = [Commit(f"{d:02d}", f"{d:02d}", "", {"newest": f"2024-03-{d:02d} 06:00:00", "kept": d % 7}, ()) for d in range(1, 31)]
    reached = increments._within_reach(spark, days, "2024-03-30 06:00:00", "2 days")
    assert [c.first for c in reached] == ["27", "29", "30"]  # 28 kept no row, 26 is just out of reach
    assert len(increments._within_reach(spark, days, "2024-03-30 06:00:00", "1 month")) == 26
