from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tidemill.llm.mixing import mix_sources

TARGETS = "source string, target_weight double, max_repeats int"


def documents(spark, counts, seed=1):
    rng = random.Random(seed)
    rows, key = [], 0
    for source, n in counts.items():
        for _ in range(n):
            key += 1
            spelt = source if source is None else rng.choice([source, f" {source}", source.upper() + " "])
            rows.append((key, spelt, int(rng.lognormvariate(6, 0.8)) + 1, "x"))
    return spark.createDataFrame(rows, "id long, source string, size long, copies string")


def mixed(spark, counts, targets, **kw):
    found = mix_sources(documents(spark, counts), "id", "source", F.col("size"), spark.createDataFrame(targets, TARGETS), **kw)
    return {r["source"]: r for r in found.report.collect()}, found.copies


def test_targets_are_met_and_caps_kept(spark):
    targets = [("a", 0.3, 2), ("b", 0.4, 6), ("c", 0.3, 1)]
    report, copies = mixed(spark, {"a": 800, "b": 300, "c": 1500, "other": 100, None: 20}, targets)
    largest = copies.agg(F.max("size")).first()[0]
    for source, weight, cap in targets:
        r = report[source]
        assert not r["short"]
        assert abs(r["mixed_size"] - r["target_size"]) <= largest
        assert abs(r["share"] - weight) < 0.02
        own = copies.where(F.col("source") == source)
        assert own.agg(F.max("copies")).first()[0] <= cap and own.agg(F.min("copies")).first()[0] >= 0
        assert own.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == r["mixed_size"]
        assert own.count() == r["records"]
    assert copies.count() == 2600 and copies.where(F.abs(F.col("copies") - F.col("rate")) > 1).count() == 0


def test_rates_are_exponential_in_size(spark):
    _, copies = mixed(spark, {"a": 500, "b": 500}, [("a", 0.2, 3), ("b", 0.8, 3)])
    rows = [(r["size"], math.log(r["rate"])) for r in copies.where("source = 'a'").collect()]
    slopes = [y / x for x, y in rows]
    assert max(slopes) - min(slopes) < 1e-9 and max(slopes) < 0


def test_short_and_missing_sources(spark):
    report, copies = mixed(spark, {"a": 500, "b": 5}, [("a", 0.5, 1), ("B ", 0.3, 2), ("none", 0.2, 9)])
    assert report["B "]["short"] and report["none"]["short"] and not report["a"]["short"]
    assert report["none"]["records"] == 0 and report["none"]["mixed_size"] == 0 and report["none"]["share"] == 0
    assert {r["copies"] for r in copies.where("source = 'b'").collect()} == {2}
    assert report["B "]["mixed_size"] == 2 * report["B "]["size"]


def test_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", 0), (4, None, 7)], "id long, source string, size long")
    found = mix_sources(rows, "id", "source", F.col("size"), targets)
    assert {r["id"]: r["copies"] for r in found.copies.collect()} == {1: 1, 2: 0, 3: 0}
    empty = mix_sources(rows.where("id < 0"), "id", "source", F.col("size"), targets)
    assert empty.copies.count() == 0 and empty.report.first()["share"] is None
    nothing = mix_sources(rows, "id", "source", F.col("size"), targets.where("source = 'x'"))
    assert nothing.copies.count() == 0 and nothing.report.count() == 0
    same = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(100)], "id long, source string, size long")
    even = mix_sources(same, "id", "source", F.col("size"), spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 2)], TARGETS))
    assert {r["source"]: r["mixed_size"] for r in even.report.collect()} == {"a": 250, "b": 750}
