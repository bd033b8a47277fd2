from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.quantiles import SIGMA, Sketch, merge_sketches, percentiles, sketch_groups

QS = [0.0001, 0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999]


def rank_errors(sketch, values):
    ordered = np.sort(values)
    n = len(ordered)
    found = []
    for q in QS:
        v = sketch.quantile(q)[0]
        low, high = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
        rank = min(max(math.ceil(q * n), 1), n)
        off = max(low - rank, rank - high, 0) / n
        found.append(off / min(q, 1 - q))
    return np.array(found)


@pytest.mark.parametrize("k", [8, 32])
@pytest.mark.parametrize("shape", ["normal", "sorted", "reversed", "ties", "heavy"])
def test_merged_days_stay_within_the_stated_error(k, shape):
    rng = np.random.default_rng(7)
    n = 200_000
    values = {"normal": rng.normal(size=n), "sorted": np.arange(n, dtype=float), "reversed": np.arange(n, dtype=float)[::-1], "ties": rng.integers(0, 50, n).astype(float), "heavy": rng.pareto(1.1, n)}[shape]
    whole = Sketch(k)
    for day in np.array_split(values, 30):
        own = Sketch(k)
        for part in np.array_split(day, 7):
            own.add(part)
        whole.merge(Sketch.from_bytes(own.to_bytes()))
    assert whole.n == n
    assert (rank_errors(whole, values) <= 3 * SIGMA / k).all()
    assert whole.quantile(0)[0] == values.min() and whole.quantile(1)[0] == values.max()
    assert len(whole.to_bytes()) < 0.1 * 8 * n


def test_error_shrinks_towards_both_ends():
    rng = np.random.default_rng(1)
    values = rng.normal(size=500_000)
    sketch = Sketch(16)
    sketch.add(values)
    errors = rank_errors(sketch, values) * np.minimum(QS, 1 - np.array(QS))
    assert errors[0] == errors[-1] == 0
    assert sketch.rank_error(0.999) < sketch.rank_error(0.5) / 100


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(allow_nan=False, width=32), min_size=1, max_size=100), st.floats(0, 1))
def test_few_values_are_exact(values, q):
    sketch = Sketch(32)
    sketch.add(np.array(values, float))
    back = Sketch.from_bytes(sketch.to_bytes(True))
    want = sorted(values)[min(max(math.ceil(q * len(values)), 1), len(values)) - 1]
    assert back.quantile(q) == (want, want, want) and back.rank_error(q) == 0


def test_bytes_come_back():
    sketch = Sketch(8)
    sketch.add(np.random.default_rng(0).normal(size=10_000))
    assert Sketch.from_bytes(sketch.to_bytes()).to_bytes() == sketch.to_bytes()
    with pytest.raises(ValueError):
        sketch.merge(Sketch(16))
    with pytest.raises(ValueError):
        Sketch(7)


def frame(spark, n=4000):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        tag = [None, "a", "b"][0 if i % 50 == 0 else 1 if i % 3 else 2]
        rows.append((dt.datetime(2031, 3, 1) + dt.timedelta(minutes=i), tag, float(rng.normal()), None if i % 7 == 0 else float("nan") if i % 7 == 1 else float(i)))
    return spark.createDataFrame(rows + rows[:100], "at timestamp_ntz, tag string, x float, n double")


def test_groups_days_and_whole(spark):
    df = frame(spark).repartition(5)
    whole = sketch_groups(df, ["tag"], ["x", "n"])
    counts = {(r["tag"], r["column_name"]): r["n"] for r in whole.collect()}
    pandas = df.dropDuplicates().toPandas()
    for tag in (None, "a", "b"):
        own = pandas[pandas["tag"].isna() if tag is None else pandas["tag"] == tag]
        assert counts[tag, "x"] == len(own) and counts[tag, "n"] == own["n"].notna().sum()
    days = sketch_groups(df.withColumn("day", df["at"].cast("date")), ["tag", "day"], ["x", "n"])
    assert days.count() > 6
    merged = percentiles(merge_sketches(days, ["tag"]), ["tag"], [0.1, 0.5, 0.99]).collect()
    for r in merged:
        own = pandas[pandas["tag"].isna() if r["tag"] is None else pandas["tag"] == r["tag"]][r["column_name"]].dropna().to_numpy()
        rank = np.searchsorted(np.sort(own), r["value"], "right") / len(own)
        assert abs(rank - r["percentile"]) <= r["rank_error"] + 1 / len(own)
        assert r["lower"] <= r["value"] <= r["upper"] and r["n"] == len(own)
    total = percentiles(merge_sketches(days, []), [], [0.5]).where("column_name = 'x'").first()
    assert total["n"] == len(pandas)


def test_two_step_merge_gives_the_same_counts(spark):
    df = frame(spark).repartition(5)
    from tidemill.llm import quantiles

    assert {r["n"] for r in quantiles.sketch_groups(df, [], ["x"], fan_in=1).collect()} == {4000}


def test_empty_all_null_and_clashing_names(spark):
    empty = spark.createDataFrame([], "tag string, x double")
    assert sketch_groups(empty, ["tag"], ["x"]).count() == 0
    nothing = spark.createDataFrame([("a", None), ("b", float("nan"))], "tag string, x double")
    assert sketch_groups(nothing, ["tag"], ["x"]).count() == 0
    clash = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 5)], "column_name string, value double, n int")
    found = sketch_groups(clash.withColumnRenamed("column_name", "the name"), ["the name"], ["value", "n"], dedupe=False)
    assert {(r["the name"], r["column_name"], r["n"]) for r in found.collect()} == {("a", "value", 2), ("a", "n", 2)}
    with pytest.raises(ValueError):
        percentiles(found, ["the name"], [1.5])


def test_infinities_count(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "x double")
    found = percentiles(sketch_groups(df, [], ["x"]), [], [0.0, 0.5, 1.0]).orderBy("percentile").collect()
    assert [r["value"] for r in found] == [float("-inf"), 1.0, float("inf")]
