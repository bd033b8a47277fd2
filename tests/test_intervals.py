from __future__ import annotations

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators.intervals import IntervalMap, merge_intervals

INTERVALS = st.lists(st.tuples(st.integers(0, 200), st.integers(0, 30)).map(lambda x: (x[0], x[0] + x[1])), max_size=40)


def brute(intervals, tolerance):
    periods: list[list[int]] = []
    for s, e in sorted(intervals):
        if periods and s <= periods[-1][1] + tolerance:
            periods[-1][1] = max(periods[-1][1], e)
        else:
            periods.append([s, e])
    return [tuple(p) for p in periods]


@given(INTERVALS, st.integers(0, 5), st.randoms())
def test_map_equals_brute_force_in_any_order(intervals, tolerance, rng):
    want = brute(intervals, tolerance)
    rng.shuffle(intervals)
    found = IntervalMap(tolerance)
    for s, e in intervals:
        found.insert(s, e)
    assert list(zip(found.starts, found.ends)) == want
    assert found.gaps() == [(a[1], b[0]) for a, b in zip(want, want[1:])]


def moment(us: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


def test_operator_across_blocks_equals_brute_force(spark):
    rng = random.Random(5)
    rows, by = [], {}
    for key, n in (("a", 300), ("b", 40), (None, 60)):
        for _ in range(n):
            s = rng.randrange(0, 20_000)
            e = s + rng.choice([0, 5, 40, 40, 700])
            rows.append((key, 1, moment(s), moment(e), "x"))
            by.setdefault(key, []).append((s, e))
    rows += rows[:50]
    rows += [("a", 1, None, moment(5), "x"), ("a", 1, moment(9), None, "x"), ("a", 1, moment(50), moment(40), "x")]
    df = spark.createDataFrame(rows, "tag string, field_column int, s timestamp_ntz, e timestamp_ntz, kind string").repartition(6)
    found = merge_intervals(df, ["tag", "field_column"], "s", "e", 3, block_us=256, held=64).collect()
    want = set()
    for key, intervals in by.items():
        periods = brute(intervals, 3)
        want |= {(key, "period", a, b) for a, b in periods} | {(key, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])}
    assert len(found) == len(want)
    assert {(r["tag"], r["kind"], r["start_us"], r["end_us"]) for r in found} == want


def test_an_interval_over_many_blocks_swallows_them(spark):
    df = spark.createDataFrame([("a", moment(0), moment(10_000)), ("a", moment(500), moment(600)), ("a", moment(9_000), moment(12_000)), ("a", moment(20_000), moment(20_000))], "k string, s timestamp_ntz, e timestamp_ntz")
    found = merge_intervals(df, ["k"], "s", "e", block_us=100).orderBy("start_us").collect()
    assert [(r["kind"], r["start_us"], r["end_us"]) for r in found] == [("period", 0, 12_000), ("gap", 12_000, 20_000), ("period", 20_000, 20_000)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, s timestamp_ntz, e timestamp_ntz")
    assert merge_intervals(df, ["k"], "s", "e").count() == 0


@settings(max_examples=5, deadline=None)
@given(INTERVALS)
def test_merging_is_associative(intervals):
    whole, left, right = IntervalMap(2), IntervalMap(2), IntervalMap(2)
    for i, (s, e) in enumerate(intervals):
        whole.insert(s, e)
        (left if i % 2 else right).insert(s, e)
    for s, e in zip(right.starts, right.ends):
        left.insert(s, e)
    assert (left.starts, left.ends) == (whole.starts, whole.ends)


def test_stream_keeps_periods_in_state(spark, tmp_path):
    from tidemill.streaming.intervals import stream_intervals

    source = str(tmp_path / "in")
    schema = "k string, s long, e long"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        seen: list = []
        stream = stream_intervals(spark.readStream.schema(schema).parquet(source), ["k"], "s", "e", 2)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(seen)

    assert step([("a", 0, 5), ("a", 20, 30), ("a", 7, 9), ("b", 1, 1), ("b", 5, 3)]) == [("a", "period", 0, 9), ("a", "period", 20, 30), ("b", "period", 1, 1)]
    assert step([("a", 9, 19), ("b", None, 4)]) == [("a", "period", 0, 30), ("a", "replaced", 0, 9), ("a", "replaced", 20, 30)]
    assert step([("a", 1, 2)]) == []


def test_stream_lets_old_periods_go(spark, tmp_path):
    from tidemill.streaming.intervals import stream_intervals

    source = str(tmp_path / "in")
    schema = "k string, s long, e long"
    second = 1_000_000

    def step(rows):
        spark.createDataFrame([(k, a * second, b * second) for k, a, b in rows], schema).coalesce(1).write.mode("append").parquet(source)
        seen: list = []
        timed = spark.readStream.schema(schema).parquet(source).withColumn("at", F.timestamp_micros("e")).withWatermark("at", "100 seconds")
        stream = stream_intervals(timed, ["k"], "s", "e", second, "at")
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return sorted((k, kind, a // second, b // second) for k, kind, a, b in seen), rows

    assert step([("a", 0, 5), ("a", 20, 30), ("a", 6, 9), ("b", 1, 1)])[0] == [("a", "period", 0, 9), ("a", "period", 20, 30), ("b", "period", 1, 1)]
    # The watermark goes to 115 - 100: what ended before it is closed and leaves the state, by itself for b.
    found, left = step([("a", 31, 32), ("c", 110, 115)])
    assert found == [("a", "closed", 0, 9), ("a", "period", 20, 32), ("a", "replaced", 20, 30), ("b", "closed", 1, 1), ("c", "period", 110, 115)] and left == 2
    # Rows before the watermark are dropped; the rest goes on.
    found, left = step([("a", 3, 4), ("a", 18, 19), ("c", 400, 400)])
    assert found == [("a", "closed", 18, 32), ("a", "period", 18, 32), ("a", "replaced", 20, 32), ("c", "closed", 110, 115), ("c", "period", 400, 400)] and left == 1
