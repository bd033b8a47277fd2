from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemill.operators import rolling
from tidemill.operators.rolling import HIGHEST, LOWEST, SUM, TwoStackQueue, rolling_totals, trailing

DDL = "at timestamp_ntz, a string, b string, x float, y float"


def at(day: int, hour: int = 1) -> dt.datetime:
    return dt.datetime(2031, 3, 1, hour) + dt.timedelta(days=day)


@given(st.lists(st.floats(-1e6, 1e6), max_size=60), st.integers(1, 12))
def test_trailing_equals_brute_force(values, width):
    v = np.array(values, float)
    for monoid, f in ((SUM, math.fsum), (LOWEST, min), (HIGHEST, max)):
        found = trailing(v, width, monoid)
        assert np.allclose(found, [f(values[max(0, i - width + 1) : i + 1]) for i in range(len(values))], rtol=1e-12, atol=1e-6)


@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 7))
def test_two_stack_queue_keeps_order_without_inverse(values, width):
    queue = TwoStackQueue(lambda a, b: a + b, "")
    for i, v in enumerate(values):
        queue.push(str(v))
        if len(queue) > width:
            queue.pop()
        assert queue.value() == "".join(map(str, values[max(0, i - width + 1) : i + 1]))


def test_infinity_leaves_the_window_again():
    v = np.array([1.0, np.inf, 2.0, 3.0, 4.0, 5.0])
    assert trailing(v, 2, SUM).tolist() == [1.0, np.inf, np.inf, 5.0, 7.0, 9.0]


def test_days_without_readings_nulls_and_repeats(spark):
    rows = [
        (at(0), "p", None, 1.0, None),
        (at(0), "p", None, 1.0, None),
        (at(0, 2), "p", None, float("nan"), 2.0),
        (at(3), "p", None, 5.0, 4.0),
        (at(0), "q", "u", float("inf"), None),
        (at(1), "q", "u", None, None),
        (None, "q", "u", 9.0, 9.0),
    ]
    found = rolling_totals(spark.createDataFrame(rows, DDL), ["a", "b"], "at", ["x", "y"], [2]).orderBy("a", "day").collect()
    assert [(r["a"], r["b"], r["day"].day, r["active_days"], r["x_count"], r["x_total"], r["y_total"], r["y_highest"]) for r in found] == [
        ("p", None, 1, 1, 1, 1.0, 2.0, 2.0),
        ("p", None, 2, 1, 1, 1.0, 2.0, 2.0),
        ("p", None, 3, 0, 0, None, None, None),
        ("p", None, 4, 1, 1, 5.0, 4.0, 4.0),
        ("q", "u", 1, 1, 1, float("inf"), None, None),
    ]


def test_empty_table_clashing_names_and_bad_arguments(spark):
    df = spark.createDataFrame([], "at timestamp_ntz, `day` string, window_days int, x float")
    assert rolling_totals(df.withColumnRenamed("day", "the day"), ["the day"], "at", ["x"]).count() == 0
    clash = spark.createDataFrame([(at(0), 7, "z", 1.0)], "at timestamp_ntz, active_days int, other string, x float")
    assert rolling_totals(clash, ["other"], "at", ["x"]).count() == 2
    with pytest.raises(ValueError):
        rolling_totals(clash, ["other"], "at", [])


def test_without_keys_all_rows_are_one_entity(spark):
    df = spark.createDataFrame([(at(0), 1.0), (at(1), 2.0)], "at timestamp_ntz, x double")
    assert [r["x_total"] for r in rolling_totals(df, [], "at", ["x"], [7]).orderBy("day").collect()] == [1.0, 3.0]


def test_pieces_give_the_same_as_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for e, span in enumerate((1, 40, 3000, 7, 900)):
        for day in sorted(rng.choice(span, size=max(1, span // 9), replace=False).tolist()):
            v = float(rng.integers(1, 9))
            rows.append((f"e{e}", day - 500, 2, v, v - 1, v + 1))
    names = ["k", "__day", "__n0", "__s0", "__l0", "__h0"]
    table = pa.table({n: list(c) for n, c in zip(names, zip(*rows))})

    def run():
        found = [r for b in rolling._roll(table, ["k"], ["x"], [7, 30]) for r in b.to_pylist()]
        return sorted(map(str, found)), found

    want, found = run()
    assert len(found) == len(want) and len({(r["k"], r["day"], r["window_days"]) for r in found}) == len(found)
    for days, size in ((11, 200), (100, 100_000)):
        monkeypatch.setattr(rolling, "PIECE_DAYS", days)
        monkeypatch.setattr(rolling, "PIECE_ROWS", size)
        batches = list(rolling._roll(table, ["k"], ["x"], [7, 30]))
        assert len(batches) >= 2 and max(b.num_rows for b in batches) <= days + size
        assert run()[0] == want


def test_a_wrong_date_far_off(spark):
    rows = [(at(0), "p", 1.0), (at(1), "p", 2.0), (at(300_000), "p", 4.0), (at(0), "q", 1.0)]
    found = rolling_totals(spark.createDataFrame(rows, "at timestamp_ntz, a string, x double"), ["a"], "at", ["x"], [7])
    assert found.count() == 300_002
    assert [r["x_total"] for r in found.where("a = 'p' AND active_days > 0").orderBy("day").collect()] == [1.0] + [3.0] * 6 + [2.0] + [4.0]


def test_rows_are_shuffled_once(spark):
    found = rolling_totals(spark.createDataFrame([(at(0), "p", 1.0)], "at timestamp_ntz, a string, x double"), ["a"], "at", ["x"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
