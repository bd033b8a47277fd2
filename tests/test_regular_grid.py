from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

import tidemill.operators.regular_grid as module
from tidemill.operators.regular_grid import TREND, regular_grid, running_median

START = dt.datetime(2031, 3, 1)
SLOT = 600_000_000


def frame(spark, rows):
    return spark.createDataFrame([(k, START + dt.timedelta(seconds=s), v) for k, s, v in rows], "k string, at timestamp_ntz, v double")


def dense_smoother(times, values, r, q, grid, wide):
    """One Kalman smoother as a Gaussian regression over all readings: the answer that blocks must reproduce."""
    knots = np.unique(np.concatenate([times, grid, [0.0]]))
    n = len(knots)
    precision, shift = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    precision[:2, :2] += np.eye(2) / wide
    shift[:2] += np.array([values[0], 0]) / wide
    for i in range(1, n):
        d = knots[i] - knots[i - 1]
        f = np.array([[1, d], [0, 1]])
        noise = np.array([[q * d + TREND * q * d**3 / 3, TREND * q * d * d / 2], [TREND * q * d * d / 2, TREND * q * d]])
        w = np.linalg.inv(noise)
        a, b = slice(2 * i - 2, 2 * i), slice(2 * i, 2 * i + 2)
        precision[a, a] += f.T @ w @ f
        precision[b, b] += w
        precision[a, b] -= f.T @ w
        precision[b, a] -= w @ f
    for t, v in zip(times, values):
        i = 2 * np.searchsorted(knots, t)
        precision[i, i] += 1 / r
        shift[i] += v / r
    covariance = np.linalg.inv(precision)
    mean = covariance @ shift
    at = 2 * np.searchsorted(knots, grid)
    return mean[at], np.sqrt(np.diag(covariance)[at])


def test_smoother_equals_gaussian_regression():
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 300, 200))
    t[100:] += 80
    y = 8 + np.sin(t / 30) + rng.normal(0, 0.1, len(t))
    r, q, wide = 0.01, 0.02, 300.0
    prior = np.array([[y[0], 0.0, wide, 0.0, wide]]).T
    forward, backward = module.smooth(np.array([len(t)]), t, y, np.zeros(1), np.array([r]), np.array([q]), prior, np.zeros((5, 1)), np.array([np.nan]))
    want, _ = dense_smoother(t, y, r, q, t, wide)
    # At a reading: the filtered state, and the information from it on without the reading itself.
    m0, m1, p00, p01, p11 = forward
    e0, e1, j00, j01, j11 = backward
    e0, j00 = e0 - y / r, j00 - 1 / r
    w00, w01, w10, w11 = 1 + p00 * j00 + p01 * j01, p00 * j01 + p01 * j11, p01 * j00 + p11 * j01, 1 + p01 * j01 + p11 * j11
    x0, x1 = m0 + p00 * e0 + p01 * e1, m1 + p01 * e0 + p11 * e1
    assert np.allclose((w11 * x0 - w01 * x1) / (w00 * w11 - w01 * w10), want, atol=1e-6)


def test_blocks_give_the_result_of_one_block(spark):
    rng = np.random.default_rng(4)
    seconds = np.sort(rng.choice(np.arange(0, 3 * 86_400), 400, replace=False))
    seconds = seconds[(seconds < 90_000) | (seconds > 150_000)]
    rows = [("a", int(s), float(8 + np.sin(s / 20_000) + rng.normal(0, 0.1))) for s in seconds]
    # Blocks of fewer readings than it takes to estimate the noise, so that both use the same.
    rows = rows[::20]
    one = regular_grid(frame(spark, rows), ["k"], "at", "v", block_hours=24 * 30).orderBy("slot_us").toPandas()
    many = regular_grid(frame(spark, rows), ["k"], "at", "v", block_hours=6).orderBy("slot_us").toPandas()
    assert len(one) == len(many) > 300
    assert np.allclose(one["value"], many["value"], atol=1e-6) and np.allclose(one["deviation"], many["deviation"], atol=1e-6)


def test_elements_and_scan_equal_the_filter():
    """The state after two blocks from their elements is that of the filter run through both."""
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 50, 60))
    y = rng.normal(5, 1, 60)
    r, q, wide = 0.04, 0.03, 100.0
    cut = 25
    r2, q2 = np.array([r, r]), np.array([q, q])
    start = np.array([0.0, 30.0])
    t[cut:] += 30 - t[cut] + 0.5
    found = module.elements(np.array([cut, 60 - cut]), t, y, start, r2, q2)
    m, p = [y[0], 0.0], [wide, 0.0, wide]
    m, p = module._through(m, p, list(found[0]))
    m, p = module._ahead(m, p, 30.0 - t[cut - 1], q)
    m, p = module._through(m, p, list(found[1]))
    prior = np.array([[y[0], 0.0, wide, 0.0, wide]]).T
    forward, backward = module.smooth(np.array([60]), t, y, np.zeros(1), r2[:1], q2[:1], prior, np.zeros((5, 1)), np.array([np.nan]))
    assert np.allclose([*m, *p], forward[:, -1], rtol=1e-8)
    info = module._back_through((0.0,) * 5, list(found[1]))
    direct = module.back(*backward[:, cut], t[cut] - 30.0, q)
    assert np.allclose(info, direct, rtol=1e-7)


def test_slots_counts_and_flags(spark):
    rows = [("a", 10, 5.0), ("a", 20, 5.2), ("a", 20, 5.2), ("a", 599, float("inf")), ("a", 2400, 5.1), ("a", 1300, None), ("a", 1300, float("nan")), (None, 7200, 1.0)]
    found = regular_grid(frame(spark, rows), ["k"], "at", "v").orderBy("k", "slot_us").collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert [(r["k"], (r["slot_us"] - base) // SLOT, r["readings"], r["missing"]) for r in found] == [(None, 12, 1, False), ("a", 0, 3, False), ("a", 1, 0, True), ("a", 2, 0, True), ("a", 3, 0, True), ("a", 4, 1, False)]
    a = [r for r in found if r["k"] == "a"]
    assert all(4.5 < r["value"] < 5.8 for r in a)
    assert all(r["deviation"] > 0 for r in a)


def test_gap_over_many_blocks_is_filled(spark):
    rows = [("a", 60 * i, 3.0) for i in range(60)] + [("a", 5 * 86_400 + 60 * i, 4.0) for i in range(60)]
    found = regular_grid(frame(spark, rows), ["k"], "at", "v").orderBy("slot_us").toPandas()
    assert len(found) == (5 * 86_400 + 59 * 60) // 600 + 1
    assert found["missing"].sum() == len(found) - 12
    assert found["value"].between(1, 6).all()
    middle = found["deviation"].iloc[len(found) // 2]
    assert middle > 5 * found["deviation"].iloc[0]


def test_a_line_with_a_hole_is_continued(spark):
    rows = [("a", 60 * i, 2 + 0.001 * 60 * i) for i in range(400) if not 150 < i < 200]
    found = regular_grid(frame(spark, rows), ["k"], "at", "v").toPandas()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    want = 2 + 0.001 * (found["slot_us"] - base) / 1e6
    assert np.abs(found["value"] - want).max() < 0.2


def test_outliers_do_not_steer(spark):
    rows = [("a", 60 * i, 5 + 0.01 * (i % 3)) for i in range(200)]
    rows[100] = ("a", 6000, 500.0)
    found = regular_grid(frame(spark, rows), ["k"], "at", "v").toPandas()
    assert found["value"].max() < 6 and found["readings"].sum() == 200


def test_empty_only_infinite_and_bad_arguments(spark):
    assert regular_grid(frame(spark, []), ["k"], "at", "v").count() == 0
    found = regular_grid(frame(spark, [("a", 0, float("inf")), ("a", 700, float("-inf"))]), ["k"], "at", "v").collect()
    assert [(r["missing"], r["value"]) for r in found] == [(False, None), (False, None)]
    with pytest.raises(ValueError):
        regular_grid(frame(spark, []), ["k"], "at", "v", slot_us=7)


def test_running_median():
    v = np.array([1.0, 100.0, 2.0, 3.0, 4.0])
    assert running_median(v, 3).tolist() == [1.0, 2.0, 3.0, 3.0, 4.0]


def test_a_date_far_off_comes_in_pieces(spark):
    rows = [("a", START, 1.0), ("a", START + dt.timedelta(seconds=700), 2.0), ("a", START + dt.timedelta(days=9000), 3.0), ("b", START, 1.0)]
    found = regular_grid(spark.createDataFrame(rows, "k string, t timestamp_ntz, v double"), ["k"], "t", "v")
    assert found.groupBy("k").count().orderBy("k").collect() == [("a", 9000 * 144 + 1), ("b", 1)]
    assert found.where("readings > 0").count() == 4 and found.where("value IS NULL").count() == 0
    assert found.select("k", "slot_us").distinct().count() == 9000 * 144 + 2
