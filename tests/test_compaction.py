from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import compaction
from tidemill.operators.compaction import canonical_location, compact, compacted_records, manifest, plan_compaction
from tidemill.runtime import durable

FILES = "file_id bigint, location string, table_name string, field_column smallint, file_name string, size_bytes bigint, row_count bigint, modified timestamp_ntz, removed_at timestamp_ntz"
RECORDS = "file_id bigint, row_index int, record_id bigint, value float"
T0 = dt.datetime(2031, 3, 1)


def file(i, location="s3://b/x", table="t", field=1, name=None, size=100, rows=1, hour=0, removed=None):
    return (i, location, table, field, name or f"part-{i}.parquet", size, rows, T0 + dt.timedelta(hours=hour), removed)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("S3://Bucket//a/./b/", "s3://Bucket/a/b"),
        ("/srv/x/", "file:///srv/x"),
        ("file:///srv/./x", "file:///srv/x"),
        ("srv", "file://srv"),
        ("", "file://"),
        (None, None),
    ],
)
def test_spellings(spark, given, want):
    assert spark.createDataFrame([(given,)], "l string").select(canonical_location(F.col("l")).alias("x")).first()["x"] == want


def test_manifest_leaves_out_what_is_no_data_file(spark):
    files = [
        file(1),
        file(2, name="_part.parquet"),
        file(3, name=".part.parquet"),
        file(4, name="part.parquet.tmp"),
        file(5, rows=0),
        file(6, removed=T0),
        file(8, "S3://b/x/", name="same.parquet"),
        file(7, "s3://b//x", name="same.parquet"),
        file(9, field=None),
        file(10, name=None, size=None),
    ]
    assert sorted(r["file_id"] for r in manifest(spark.createDataFrame(files, FILES)).collect()) == [1, 7, 9]


def test_plan_cuts_the_running_sum(spark):
    files = [file(i, size=40, hour=i // 3) for i in range(1, 11)] + [file(20, size=500), file(21, table="alone"), file(22, table=None), file(23, table=None)]
    plan = {r["file_id"]: r for r in plan_compaction(spark.createDataFrame(files, FILES), small_bytes=200, target_bytes=120).collect()}
    assert [plan[i]["group_index"] for i in range(1, 11)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert plan[20]["group_index"] is None and not plan[20]["rewrite"] and plan[20]["small_files"] == 0
    assert not plan[21]["rewrite"] and plan[21]["small_files"] == 1
    assert plan[22]["rewrite"] and plan[23]["group_index"] == 0


def test_every_record_of_a_live_file_is_there_once(spark, tmp_path):
    files = spark.createDataFrame([file(1), file(2), file(3, size=50_000), file(4, removed=T0), file(5, table="u"), file(6, table="u")], FILES)
    rows = [(1, 0, 10, 1.0), (1, 1, 11, 1.5), (2, 0, 11, 1.5), (2, 1, 12, 2.0), (3, 0, 12, 2.0), (3, 1, 13, None), (4, 0, 14, 4.0), (5, 0, 15, 5.0), (99, 0, 16, 6.0)]
    records = spark.createDataFrame(rows, RECORDS)
    plan = plan_compaction(files)
    found = {r["record_id"]: (r["table_name"], r["group_index"], r["value"]) for r in compacted_records(plan, records).collect()}
    assert found == {10: ("t", 0, 1.0), 11: ("t", 0, 1.5), 12: ("t", None, 2.0), 13: ("t", None, None), 15: ("u", 0, 5.0)}
    report = compact(files, records, str(tmp_path / "out")).orderBy("table_name").collect()
    assert [(r["table_name"], r["files"], r["records_expected"], r["records_written"]) for r in report] == [("t", 2, 2, 2), ("u", 2, 1, 1)]
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["record_id"] for r in written.collect()) == [10, 11, 15]
    assert len(written.inputFiles()) == 2


def test_empty_listing(spark):
    assert plan_compaction(spark.createDataFrame([], FILES)).count() == 0


def test_records_without_id_are_all_kept(spark, tmp_path):
    files = spark.createDataFrame([file(1), file(2), file(3, size=50_000), file(5, table="u"), file(6, table="u")], FILES)
    rows = [(1, 0, None, 1.0), (1, 1, None, 1.0), (1, 1, None, 1.0), (2, 0, None, 1.0), (2, None, None, 2.0), (2, None, None, 2.0), (2, 1, 10, 3.0), (3, 0, None, 4.0), (5, 0, 10, 3.0), (6, 0, None, None)]
    records = spark.createDataFrame(rows, RECORDS)
    plan = plan_compaction(files)
    found = sorted(compacted_records(plan, records).select("file_id", F.coalesce("row_index", F.lit(-1)), F.coalesce("record_id", F.lit(-1))).collect())
    assert found == [(1, 0, -1), (1, 1, -1), (2, -1, -1), (2, -1, -1), (2, 0, -1), (2, 1, 10), (3, 0, -1), (6, 0, -1)]
    assert compacted_records(plan, records.drop("row_index")).count() == 9
    report = compact(files, records, str(tmp_path / "out")).orderBy("table_name").collect()
    assert [(r["table_name"], r["records_expected"], r["records_written"]) for r in report] == [("t", 6, 6), ("u", 1, 1)]


def test_lost_records_are_noticed(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([file(1), file(2)], FILES)
    records = spark.createDataFrame([(1, 0, 10, 1.0), (1, 1, None, 1.5), (2, 0, 11, 1.5)], RECORDS)
    whole = compaction.compacted_records
    for lost in ("record_id IS NULL", "record_id = 11"):
        monkeypatch.setattr(compaction, "compacted_records", lambda p, r, lost=lost: whole(p, r).where(f"NOT coalesce({lost}, false)"))
        with pytest.raises(RuntimeError, match="differ"):
            compact(files, records, str(tmp_path / lost[-2:]))


@pytest.mark.parametrize("few", [True, False])
def test_both_ways_of_joining_give_the_same(spark, monkeypatch, few):
    """Repeated records over many files, ties and records without id, beside a plain ranking of all records."""
    if not few:
        monkeypatch.setattr(compaction, "FEW_FILES", 0)
        monkeypatch.setattr(compaction, "FEW_REPEATS", 0)
    files = spark.createDataFrame([file(i, table="tu"[i % 2], size=50_000 if i % 5 == 0 else 100) for i in range(1, 20)], FILES)
    rows = [(i % 21, i % 7, None if i % 11 == 0 else i * 13 % 60, float(i % 3)) for i in range(300)]
    records = spark.createDataFrame(rows, RECORDS)
    plan = plan_compaction(files)
    at = {r["file_id"]: r["group_index"] for r in plan.collect()}
    best: dict = {}
    for f, row, record, _ in rows:
        if f in at:
            own = ("id", record) if record is not None else (f, row)
            rank = (at[f] is not None, f, row)
            best[own] = min(best.get(own, rank), rank)
    want = sorted((own[1] if own[0] == "id" else -1, rank[1], rank[2]) for own, rank in best.items())
    found = compacted_records(plan, records).select(F.coalesce("record_id", F.lit(-1)), "file_id", "row_index").collect()
    assert sorted(map(tuple, found)) == want


def test_records_are_not_shuffled(spark):
    files = spark.createDataFrame([file(1), file(2), file(3, size=50_000)], FILES)
    records = spark.createDataFrame([(1, 0, 10, 1.0), (2, 0, 10, 1.0), (2, 1, 11, 1.5)], RECORDS)
    plan = compacted_records(durable(plan_compaction(files)), records)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
