from __future__ import annotations

import datetime as dt

import numpy as np

from tidemill.operators.spikes import Rules, Settings, flag_readings, sizes_of, tail_cutoff, wrap

RULES = {"speed": Rules(0, 60), "heading": Rules(0, 360, 360.0)}
DDL = "source string, at timestamp_ntz, heading float, speed float, extra string"
START = dt.datetime(2031, 3, 1)


def series(n=3000, seed=1, step=300):
    rng = np.random.default_rng(seed)
    t = [START + dt.timedelta(seconds=step * i) for i in range(n)]
    speed = np.round(8 + np.sin(np.arange(n) / 200) * 3 + rng.normal(0, 0.2, n), 2)
    heading = np.round((350 + 15 * np.sin(np.arange(n) / 150) + rng.normal(0, 1.5, n)) % 360, 1)
    return t, speed, heading


def run(spark, t, speed, heading, source="a", block_hours=24):
    rows = [(source, a, None if h is None else float(h), None if s is None else float(s), "x") for a, s, h in zip(t, speed, heading)]
    return flag_readings(spark.createDataFrame(rows, DDL), ["source"], "at", RULES, block_hours=block_hours).collect()


def us(moment):
    return round((moment - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)


def flagged(found, column, kind):
    return {r["timestamp_us"] for r in found if r["column_name"] == column and r["kind"] == kind}


def test_planted_cases_are_found_and_nothing_else(spark):
    t, speed, heading = series()
    spikes = [100, 500, 501, 900, 901, 902, 288, 287]
    for i in spikes:
        speed[i] += 6
    turned = [1500, 1501]
    for i in turned:
        heading[i] = (heading[i] + 120) % 360
    speed[2000:] += 9
    # Two stuck runs: one across the end of a block, one of a value too few.
    speed[280 + 288 : 305 + 288] = speed[279 + 288]
    speed[1200:1218] = 5.55
    impossible = {50: -1.0, 51: 61.0, 52: np.inf}
    for i, v in impossible.items():
        speed[i] = v
    found = run(spark, t, speed, heading)
    assert flagged(found, "speed", "impossible") == {us(t[i]) for i in impossible}
    assert flagged(found, "speed", "stuck") == {us(t[i]) for i in range(279 + 288, 305 + 288)}
    assert flagged(found, "speed", "spike") == {us(t[i]) for i in spikes}
    assert flagged(found, "heading", "spike") == {us(t[i]) for i in turned}
    assert not flagged(found, "heading", "impossible") | flagged(found, "heading", "stuck")


def test_result_does_not_depend_on_blocks(spark):
    t, speed, heading = series(1500, 3)
    for i in (287, 288, 289, 700):
        speed[i] += 8
    want = {(r["timestamp_us"], r["column_name"], r["kind"]) for r in run(spark, t, speed, heading, block_hours=24 * 30)}
    assert {(r["timestamp_us"], r["column_name"], r["kind"]) for r in run(spark, t, speed, heading, block_hours=24)} == want
    assert len(want) == 4


def test_four_in_a_row_and_a_level_that_stays_are_no_spikes(spark):
    t, speed, heading = series(1200, 4)
    speed[300:304] += 7
    speed[600:] += 7
    assert not flagged(run(spark, t, speed, heading), "speed", "spike")


def test_nulls_nan_repeats_and_unknown_sources(spark):
    t, speed, heading = series(600, 5)
    values = [None if i % 10 == 0 else float("nan") if i % 10 == 1 else s for i, s in enumerate(speed)]
    values[305] = speed[305] + 9
    found = run(spark, t + t, values + values, list(heading) * 2, source=None)
    assert flagged(found, "speed", "spike") == {us(t[305])}
    assert len([r for r in found if r["column_name"] == "speed"]) == 1


def test_stuck_run_over_whole_blocks(spark):
    t, speed, heading = series(1500, 6)
    speed[200:1000] = 7.77
    assert flagged(run(spark, t, speed, heading), "speed", "stuck") == {us(a) for a in t[200:1000]}


def test_empty_and_tiny_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [START], [5.0], [5.0]) == []
    assert [r["kind"] for r in run(spark, [START], [-5.0], [5.0])] == ["impossible"]


def test_cutoff_of_a_normal_tail():
    rng = np.random.default_rng(2)
    size = np.abs(rng.normal(0, 1, 400_000))
    cut = tail_cutoff(sizes_of(size), 1.0, Settings().risk)
    assert 4.5 < cut < 8
    # Spikes among the values, of any size, hardly move it; a smaller risk does.
    size[:800] = 10.0 ** rng.uniform(1, 6, 800)
    assert abs(tail_cutoff(sizes_of(size), 1.0, Settings().risk) / cut - 1) < 0.15
    assert tail_cutoff(sizes_of(size), 1.0, 1e-12) > cut


def test_longer_tails_have_higher_cutoffs():
    rng = np.random.default_rng(3)
    laplace, heavy = np.abs(rng.laplace(0, 1, 200_000)), np.abs(rng.standard_t(3, 200_000))
    exact = -np.log(1e-6)
    assert 0.8 * exact < tail_cutoff(sizes_of(laplace), 1.25, 1e-6) < 1.3 * exact
    assert tail_cutoff(sizes_of(heavy), 1.38, 1e-6) > 30


def test_few_values_have_an_exponential_tail():
    assert 9 < tail_cutoff(sizes_of(np.ones(10)), 1.0, 1e-8) < 10
    assert tail_cutoff(sizes_of(np.zeros(0)), 0.0, 1e-8) == 0


def test_the_tail_of_a_source_decides(spark):
    """Two sources with one scatter: what is a spike in the one is an ordinary reading of the other."""
    rng = np.random.default_rng(12)
    n = 12_000
    t = [START + dt.timedelta(seconds=120 * i) for i in range(n)]
    smooth = rng.normal(0, 1, n)
    rough = rng.laplace(0, 1, n)
    rough *= np.abs(smooth).mean() / np.abs(rough).mean()
    rows, spikes = [], range(1000, n - 100, 500)
    for source, noise in (("smooth", smooth), ("rough", rough)):
        noise = noise * 0.2
        for i in spikes:
            noise[i] = 10.5 * 1.2533 * 0.2 * np.abs(smooth).mean()
        rows += [(source, a, 1.0, float(30 + v), "x") for a, v in zip(t, np.round(noise, 3))]
    found = [r for r in flag_readings(spark.createDataFrame(rows, DDL), ["source"], "at", RULES).collect() if r["kind"] == "spike"]
    cut = {r["source"]: r["cutoff"] / r["scatter"] for r in found}
    flags = {s: {r["timestamp_us"] for r in found if r["source"] == s} for s in ("smooth", "rough")}
    assert flags["smooth"] == {us(t[i]) for i in spikes} and 4.5 < cut["smooth"] < 9.5
    assert len(flags["rough"]) < len(flags["smooth"]) / 3


def test_shorter_way_round():
    assert wrap(np.array([350.0, -350.0, 180.0, 10.0]), 360.0).tolist() == [-10.0, 10.0, -180.0, 10.0]


def test_directions_half_a_turn_off_are_found(spark):
    for noise, turn in ((1, 180), (5, 180), (5, 175), (8, 170)):
        rng = np.random.default_rng(noise + turn)
        t, speed, _ = series(3000, 7)
        heading = 350 + 15 * np.sin(np.arange(3000) / 150) + rng.normal(0, noise, 3000)
        # Alone, two and three in a row, and two that are close to each other.
        spikes = [*range(50, 2900, 40), *(i + k for i in range(65, 2900, 320) for k in (0, 1)), *(i + k for i in range(225, 2900, 320) for k in (0, 1, 2)), 1012]
        heading[spikes] += turn
        found = run(spark, t, speed, np.round(heading % 360, 1))
        assert flagged(found, "heading", "spike") == {us(t[i]) for i in spikes}


def test_sources_read_slowly_have_a_scatter(spark):
    for hours, block_hours in ((12, 96), (36, 24), (12, 24)):
        t, speed, heading = series(1200, 8, step=hours * 3600)
        spikes = [100, 400, 401, 700, 701, 702, 1150]
        for i in spikes:
            speed[i] += 8
            heading[i] = (heading[i] + 150) % 360
        speed[900:] += 8
        found = run(spark, t, speed, heading, block_hours=block_hours)
        assert flagged(found, "speed", "spike") == flagged(found, "heading", "spike") == {us(t[i]) for i in spikes}
        assert all(r["scatter"] > 0 for r in found)
