import hashlib

import pytest
from pyspark.sql import functions as F

from spendscope.plans.ingest_queries import day_files
from spendscope.session import fresh_path
from spendscope.sources import files, ingest, sinks
from spendscope.sources.schemas import TRANSACTION_COLUMNS, describe_types, require_columns
from spendscope.streaming import increments

HEADER = ",".join(TRANSACTION_COLUMNS)


def line(number, amount="5.00", stamp="2024-01-02 03:04:05", user="u1"):
    return f"{number},{user},m1, Shop One ,Food,{amount},EUR,France,Paris,True,mobile,ok,{stamp}"


@pytest.fixture
def tree(tmp_path):
    """Daily folders with one file each, as deliveries come."""
    days = {
        "2025-04-07": [line(1), line(2, ""), line(2, "9.00")],
        "2025-04-08": [line(2, "7.00"), line(3, "8.00", "soon")],
        "2025-04-09": [],
    }
    for day, lines in days.items():
        (tmp_path / day).mkdir()
        (tmp_path / day / "transactions.csv").write_text("\n".join([HEADER, *lines]) + "\n")
        (tmp_path / day / "metadata.json").write_text("{}")
    return str(tmp_path)


def test_reads_types_days_and_only_the_named_files(spark, tree):
    rows = files.read_typed(spark, tree).orderBy("source_day", "source_row").collect()
    assert [r["transaction_id"] for r in rows] == ["1", "2", "2", "2", "3"]
    assert rows[1]["amount"] is None and rows[0]["is_online"] is True
    assert rows[4]["timestamp"] is None and rows[0]["timestamp"].hour == 3
    assert [str(r["source_day"]) for r in rows] == ["2025-04-07"] * 3 + ["2025-04-08"] * 2


def test_first_files_and_counts(spark, tree):
    assert files.read_first_files(spark, tree, 1).count() == 3
    assert files.read_first_files(spark, tree, 9).count() == 5
    counts = {str(r["source_day"]): r["row_count"] for r in files.row_counts(spark, tree).collect()}
    assert counts == {"2025-04-07": 3, "2025-04-08": 2}
    with pytest.raises(FileNotFoundError):
        files.read_first_files(spark, tree, 1, "nothing.csv")


def test_manifest(spark, tree):
    found = {str(r["source_day"]): r for r in files.manifest(spark, tree, min_bytes=200).collect()}
    assert {d: r["is_valid"] for d, r in found.items()} == {
        "2025-04-07": True, "2025-04-08": True, "2025-04-09": False,
    }
    with open(f"{tree}/2025-04-07/transactions.csv", "rb") as handle:
        assert found["2025-04-07"]["sha256"] == hashlib.sha256(handle.read()).hexdigest()
    assert not any(r["is_valid"] for r in files.manifest(spark, tree).collect())  # all below 1000 bytes


def test_ingest_keeps_the_first_row_of_an_id_across_files(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    stats = ingest.ingest_files(spark, tree, out).first()
    assert (stats["rows_read"], stats["rows_written"], stats["duplicates_removed"]) == (5, 3, 2)
    assert (stats["missing_amounts"], stats["bad_timestamps"]) == (1, 1)
    rows = {r["transaction_id"]: r for r in files.read_processed(spark, out).collect()}
    assert rows["2"]["missing_amount"] and rows["2"]["amount"] == 0.0
    assert rows["1"]["merchant_name"] == "shop one" and rows["1"]["time_period"] == "night"
    assert rows["3"]["time_period"] == "unknown"


def test_processed_table_errors_and_selection(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_processed(spark, str(tmp_path / "none"))
    out = str(tmp_path / "t")
    spark.range(10).repartition(3).write.parquet(out)
    assert files.read_processed(spark, out).count() == 10
    assert files.read_processed(spark, out, 1).count() < 10


def test_common_columns(spark, tmp_path):
    out = str(tmp_path / "drift")
    spark.range(3).selectExpr("id", "1 as a").coalesce(1).write.parquet(f"{out}/x")
    spark.range(4).selectExpr("id", "2 as b").coalesce(1).write.parquet(f"{out}/y")
    found = files.read_common_columns(spark, out)
    assert found.columns == ["id"] and found.count() == 7


def test_common_columns_of_files_in_one_folder(spark, tmp_path):
    out = str(tmp_path / "flat")
    spark.range(3).selectExpr("id", "1 as a").coalesce(1).write.parquet(out)
    spark.range(4).selectExpr("id", "2 as b").coalesce(1).write.mode("append").parquet(out)
    found = files.read_common_columns(spark, out)
    assert found.columns == ["id"] and found.count() == 7


def test_common_columns_of_partitioned_tables(spark, tmp_path):
    """Partition columns stay where all files have them; numbers get the widest type."""
    out = str(tmp_path / "a=b" / "parts")
    day = "date'2024-01-01' + cast(id as int) as day"
    spark.range(3).selectExpr("cast(id as int) as n", "1 as x", day).write.partitionBy("day").parquet(out)
    spark.range(3, 5).selectExpr("id + 5000000000 as n", "2 as y", day).write.mode("append").partitionBy("day").parquet(out)
    found = files.read_common_columns(spark, out)
    assert dict(found.dtypes) == {"n": "bigint", "day": "date"}
    assert sorted((r["n"], r["day"].day) for r in found.collect()) == [(0, 1), (1, 2), (2, 3), (5000000003, 4), (5000000004, 5)]
    mixed = str(tmp_path / "mixed")
    spark.range(3).selectExpr("id", "id as k").write.partitionBy("k").parquet(f"{mixed}/x")
    spark.range(2).write.parquet(f"{mixed}/y")
    assert files.read_common_columns(spark, mixed).columns == ["id"] and files.read_common_columns(spark, mixed).count() == 5
    clash = str(tmp_path / "clash")
    spark.range(1).selectExpr("id as v").write.parquet(clash)
    spark.range(1).selectExpr("cast(id as string) as v").write.mode("append").parquet(clash)
    with pytest.raises(ValueError, match="column v has types"):
        files.read_common_columns(spark, clash)


def test_hashes_are_those_of_the_bytes_whatever_the_size(spark, tmp_path, tree):
    import pathlib

    (tmp_path / "with space" / "2024-02-01").mkdir(parents=True)
    large = tmp_path / "with space" / "2024-02-01" / "transactions.csv"
    large.write_text(HEADER + "\n" + "\n".join(line(k) for k in range(200_000)) + "\n")
    assert large.stat().st_size > files.PIECE_BYTES
    for root in (tree, str(tmp_path / "with space")):
        found = files.manifest(spark, root, most_whole=10).collect()
        wanted = {hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(root).rglob("transactions.csv")}
        assert {r["sha256"] for r in found} == wanted


def test_an_append_that_is_repeated_counts_once(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.range(10).selectExpr("id", "date'2024-01-01' + cast(id % 3 as int) as date")
    assert [sinks.append_processed(rows, out, n) for n in ("1", "2", "2")] == [10, 10, None]
    found = sinks.read_appended(spark, out)
    assert found.count() == 20 and found.where("date = date'2024-01-01'").count() == 8


def test_merchant_reference_is_optional(spark, tmp_path):
    assert files.read_merchant_reference(spark, str(tmp_path / "absent.csv")) is None
    path = tmp_path / "ref.csv"
    path.write_text("merchant_id,other,merchant_category_detailed\nm1,x,Bakery\n")
    found = files.read_merchant_reference(spark, str(path))
    assert found.collect() == [("m1", "Bakery")]


def test_report_is_one_file(spark, tmp_path):
    out = tmp_path / "report"
    sinks.write_report(spark.range(50).repartition(4), str(out))
    assert len(list(out.glob("*.csv"))) == 1


def test_required_columns_and_types(spark):
    frame = spark.range(1)
    require_columns(frame, ["id"])
    with pytest.raises(ValueError, match="lacks the columns x"):
        require_columns(frame, ["id", "x"])
    assert [(r["column_name"], r["data_type"]) for r in describe_types(frame).collect()] == [("id", "bigint")]


def test_stream_takes_each_file_once(spark, folder):
    root, out, progress = day_files(spark, folder), fresh_path(spark, "t"), fresh_path(spark, "p")
    expected = files.read_raw(spark, root, "*.csv").count()
    for _ in range(2):
        increments.ingest(increments.incoming(spark, root), out, progress)
        assert spark.read.parquet(out).count() == expected


def test_small_batches_give_the_batch_result(spark, tree):
    out, progress = fresh_path(spark, "t"), fresh_path(spark, "p")
    increments.ingest_once_per_id(increments.incoming(spark, tree, files_per_batch=1), out, progress)
    rows = increments.written(spark, out)
    assert sorted(r["transaction_id"] for r in rows.collect()) == ["1", "2", "3"]


def test_repeating_a_batch_changes_nothing(spark, tree):
    """A batch that was written but not committed is run again after a restart."""
    import os

    out, progress = fresh_path(spark, "t"), fresh_path(spark, "p")
    stream = increments.incoming(spark, tree, files_per_batch=1)
    increments.ingest_once_per_id(stream, out, progress)
    before = sorted(map(tuple, increments.written(spark, out).select("transaction_id", "amount").collect()), key=str)
    last = max(int(n) for n in os.listdir(f"{progress}/commits") if n.isdigit())
    os.remove(f"{progress}/commits/{last}")
    os.remove(f"{progress}/commits/.{last}.crc")
    increments.ingest_once_per_id(stream, out, progress)
    after = sorted(map(tuple, increments.written(spark, out).select("transaction_id", "amount").collect()), key=str)
    assert after == before


def deliver(root, number, lines):
    (root / str(number)).mkdir(parents=True)
    (root / str(number) / "transactions.csv").write_text("\n".join([HEADER, *lines]) + "\n")


def test_daily_figures_take_days_that_come_late(spark, tmp_path):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    deliveries = (
        [line(1), line(2)],
        [line(3, "1.00"), line(4, "2.00", "2024-01-03 00:00:00"), line(6, "9.00", "no date")],
        [line(5, "7.00", "2023-11-20 00:00:00")],
    )
    for number, lines in enumerate(deliveries):
        deliver(root, number, lines)
        increments.maintain_daily(increments.incoming(spark, str(root)), out, progress)
    got = {str(r["date"]): (r["transaction_count"], r["transaction_value"]) for r in increments.latest_daily(spark, out).collect()}
    assert got == {"2023-11-20": (1, 7.0), "2024-01-02": (3, 11.0), "2024-01-03": (1, 2.0)}


def test_stream_and_batch_keep_the_same_one_of_differing_repeats(spark, tmp_path):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    deliver(root, 0, [line(1, "10.00", "2024-01-05 00:00:00"), line(2, "3.00"), line(2, "4.00", "2023-01-01 00:00:00")])
    deliver(root, 1, [line(1, "99.00", "2024-01-01 00:00:00")])
    increments.ingest_once_per_id(increments.incoming(spark, str(root)), out, progress)
    kept = {(r["transaction_id"], r["amount"]) for r in increments.written(spark, out).collect()}
    assert kept == {("1", 10.0), ("2", 3.0)}
    ingested = fresh_path(spark, "b")
    ingest.ingest_files(spark, str(root), ingested)
    assert {(r["transaction_id"], r["amount"]) for r in files.read_processed(spark, ingested).collect()} == kept


def test_watermark_drops_repeats_and_keeps_undated_rows(spark, tmp_path):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    deliver(root, 0, [line(1), line(1), line(2), line(3, "1.00", "no date"), line(3, "1.00", "no date")])
    assert increments.ingest_once_within(increments.incoming(spark, str(root)), out, progress) == 0
    assert sorted(r["transaction_id"] for r in increments.once_within(spark, out).collect()) == ["1", "2"]
    undated = increments.written(spark, increments.undated_part(out))
    assert [r["transaction_id"] for r in undated.collect()] == ["3"]


def test_rows_beyond_the_watermark_are_counted(spark, tmp_path):
    root, out, progress = tmp_path / "in", fresh_path(spark, "t"), fresh_path(spark, "p")
    deliver(root, 0, [line(1, "1.00", "2024-03-01 00:00:00")])
    increments.ingest_once_within(increments.incoming(spark, str(root)), out, progress)
    deliver(root, 1, [line(2, "1.00", "2024-01-01 00:00:00")])
    assert increments.ingest_once_within(increments.incoming(spark, str(root)), out, progress) == 1
