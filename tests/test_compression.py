from __future__ import annotations

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tidemill.compression.segments import MOST_RESIDUALS, coarse, compress, decompress, pack_floats, pack_times, unpack_floats, unpack_times
from tidemill.errors import InvalidArgument
from tidemill.types import CONSTANT, LINEAR, XOR, ErrorBound

FLOATS = st.floats(width=32, allow_nan=True, allow_infinity=True)
BOUNDS = [ErrorBound(), ErrorBound.absolute(1), ErrorBound.absolute(float(np.finfo(np.float32).max)), ErrorBound.percent(5), ErrorBound.percent(100)]
EPOCH = 1_930_000_000_000_000


def round_trip(times, values, bound):
    times, values = np.array(times, np.int64), np.array(values, np.float32)
    segments = compress(times, values, bound)
    at = 0
    for s in segments:
        assert s.first == at
        own = times[at : at + s.n_points]
        step, data = pack_times(own)
        back = unpack_times(int(own[0]), s.n_points, step, data)
        assert (back == own).all()
        found = decompress(s.model_type, back, s.model_points, np.float32(s.first_value), np.float32(s.last_value), s.residuals)
        assert found.tobytes() == s.values.tobytes()
        assert bound.holds(values[at : at + s.n_points], found).all()
        at += s.n_points
    assert at == len(values)
    return segments


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), FLOATS), max_size=80), st.sampled_from(BOUNDS))
@example([(0, 1.0)] * 3, BOUNDS[0])
@example([(1, -0.0), (1, 0.0)] * 9, BOUNDS[0])
def test_any_series_comes_back_within_its_bound(points, bound):
    steps, values = zip(*points) if points else ((), ())
    round_trip(EPOCH + np.cumsum(np.array(steps, np.int64)), values, bound)


@settings(max_examples=60, deadline=None)
@given(st.lists(FLOATS, max_size=50))
def test_floats_come_back_bit_by_bit(values):
    v = np.array(values, np.float32)
    assert unpack_floats(pack_floats(v)).tobytes() == v.tobytes()


def kinds(values, bound=ErrorBound(), times=None):
    n = len(values)
    return [(s.model_type, s.model_points, s.n_points) for s in round_trip(np.arange(n) * 100 + EPOCH if times is None else times, values, bound)]


def test_models_need_eight_points():
    assert kinds([5.0] * 7) == [(XOR, 0, 7)]
    assert kinds([5.0] * 8) == [(CONSTANT, 8, 8)]
    assert kinds([float(3 * i) for i in range(7)]) == [(XOR, 0, 7)]
    assert kinds([float(3 * i) for i in range(8)]) == [(LINEAR, 8, 8)]


def test_constant_wins_ties_and_residuals_go_with_the_model_before():
    rng = np.random.default_rng(0)
    noise = list(rng.normal(size=50))
    assert kinds([5.0] * 20 + noise) == [(CONSTANT, 20, 70)]
    assert kinds(noise + [5.0] * 20) == [(XOR, 0, 50), (CONSTANT, 20, 20)]


def test_more_than_255_residuals_are_a_segment_of_their_own():
    rng = np.random.default_rng(0)
    assert kinds([5.0] * 20 + list(rng.normal(size=MOST_RESIDUALS))) == [(CONSTANT, 20, 20 + MOST_RESIDUALS)]
    assert kinds([5.0] * 20 + list(rng.normal(size=MOST_RESIDUALS + 1))) == [(CONSTANT, 20, 20), (XOR, 0, MOST_RESIDUALS + 1)]


def test_special_values():
    nan, inf = float("nan"), float("inf")
    assert kinds([nan] * 10 + [1.5] * 10) == [(CONSTANT, 10, 10), (CONSTANT, 10, 10)]
    assert kinds([inf] * 9 + [-inf] * 9) == [(CONSTANT, 9, 9), (CONSTANT, 9, 9)]
    assert sum(n for _, _, n in kinds([nan, 1.0, inf] * 10, ErrorBound.percent(5))) == 30


def test_lossy_series_take_less():
    rng = np.random.default_rng(1)
    v = np.cumsum(rng.normal(size=5000)).astype(np.float32) + 500
    size = lambda b: sum(29 + len(s.residuals) for s in round_trip(np.arange(5000) * 1000, v, b))
    assert size(ErrorBound.percent(5)) < size(ErrorBound.percent(1)) < size(ErrorBound())


def test_epoch_times_with_a_small_slope():
    t = EPOCH + np.arange(1000) * 37
    assert kinds((0.001 * np.arange(1000)).astype(np.float32), ErrorBound.absolute(0.01), t)[0][0] in (CONSTANT, LINEAR)


def test_bounds_are_checked():
    for wrong in (0, -1, float("nan"), float("inf")):
        with pytest.raises(InvalidArgument):
            ErrorBound.absolute(wrong)
    for wrong in (0, -1, 100.1, float("nan")):
        with pytest.raises(InvalidArgument):
            ErrorBound.percent(wrong)
    near_zero = ErrorBound.percent(10)
    assert near_zero.holds(np.array([0.0, 1e-30]), np.array([1e-30, 1.05e-30])).tolist() == [False, True]


@pytest.mark.parametrize("bound", [ErrorBound.absolute(0.5), ErrorBound.percent(2)])
def test_values_are_given_again_within_the_bound(bound):
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 8, 17, 500):
        values = (100 + np.cumsum(rng.normal(0, 0.15, n))).astype(np.float32)
        if n > 8:
            values[[2, 5]] = np.nan, np.inf
        found = coarse(values, bound)
        assert len(found) == n and bound.holds(values, found).all()
    assert (found[1:] == found[:-1]).mean() > 0.5
    assert len(pack_floats(found)) < 0.7 * len(pack_floats(values))
    assert coarse(values, ErrorBound.lossless()).tobytes() == values.tobytes()
