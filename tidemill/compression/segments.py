"""Series of points to segments and back: constant and linear models, and a stream of XORed values for the rest."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from tidemill.types import CONSTANT, LINEAR, XOR, ErrorBound

# Bytes that a segment's own columns count for, what a constant and a linear model add at least, the
# bytes per value above which a model isn't kept, and the most trailing values that are kept with a model.
SEGMENT_BYTES = 29
LINEAR_BYTES = 1
VALUE_BYTES = 4
MOST_RESIDUALS = 255
#: Points that a model needs to be kept: 29 / 8 and 30 / 8 bytes a value are at most 4.
LEAST_POINTS = 8
#: Points of one segment at most, so that what one row unfolds to is bounded.
MOST_POINTS = 4096


@dataclass
class Segment:
    """Points first..last of a series: `model_points` of a model, then those in `residuals`."""

    model_type: int
    first: int
    n_points: int
    model_points: int
    first_value: float
    last_value: float
    residuals: bytes
    values: np.ndarray


def pack_floats(values: np.ndarray) -> bytes:
    """Each value XORed with the one before it, equal bytes of all values together, deflated."""
    if not len(values):
        return b""
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32)
    changed = bits.copy()
    changed[1:] ^= bits[:-1]
    return zlib.compress(changed.view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def unpack_floats(data: bytes) -> np.ndarray:
    """The values that pack_floats was given, bit by bit."""
    if not data:
        return np.zeros(0, np.float32)
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    changed = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()
    return np.bitwise_xor.accumulate(changed).view(np.float32)


def pack_times(times: np.ndarray) -> tuple[int | None, bytes | None]:
    """The step of regular times and no bytes; or no step and the deflated changes of the steps of irregular ones."""
    steps = np.diff(times)
    if not len(steps) or (steps == steps[0]).all():
        return (int(steps[0]) if len(steps) else 0), None
    changes = np.diff(steps, prepend=np.int64(0))
    return None, zlib.compress(changes.view(np.uint8).reshape(-1, 8).T.tobytes(), 6)


def unpack_times(start: int, count: int, step: int | None, data: bytes | None) -> np.ndarray:
    if step is not None:
        return start + step * np.arange(count, dtype=np.int64)
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    changes = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()
    return start + np.concatenate([[0], np.cumsum(np.cumsum(changes))])


def coarse(values: np.ndarray, bound: ErrorBound) -> np.ndarray:
    """Values within the bound that take few bytes: the lowest bits are zero, as many as the bound allows, and a value
    is given again where the next ones, up to seven, are within the bound of it. NaN and infinities stay."""
    values = np.asarray(values, np.float32)
    if bound.is_lossless or not len(values):
        return values
    slack = bound.slack(values)
    with np.errstate(all="ignore"):
        unit = np.spacing(np.abs(values)).astype(np.float64)
        drop = np.where(np.isfinite(values) & (values != 0), np.floor(np.log2(np.maximum(slack / unit, 1))), 0)
    drop = np.clip(drop, 0, 23).astype(np.uint32)
    bits = values.view(np.uint32)
    out = (bits >> drop << drop).view(np.float32).copy()
    wrong = ~bound.holds(values, out)
    out[wrong] = values[wrong]
    # Neighbouring runs of 1, 2 and 4 equal values become one if the first value also holds for the second run.
    whole = np.ones(len(out), bool)
    for size in (1, 2, 4):
        n = len(out) // (2 * size) * 2 * size
        first = np.repeat(out[:n].reshape(-1, 2 * size)[:, 0], size)
        second = np.arange(n).reshape(-1, 2 * size)[:, size:].ravel()
        fits = bound.holds(values[second], first).reshape(-1, size).all(axis=1) & whole[: n // size].reshape(-1, 2).all(axis=1)
        out[second] = np.where(np.repeat(fits, size), first, out[second])
        whole = fits
        if not fits.any():
            break
    return out


def line(times: np.ndarray, start: int, end: int, first: float, last: float) -> np.ndarray:
    """The linear model's values; times are taken from its start, so their size doesn't cost precision."""
    if end == start:
        return np.full(len(times), first, np.float32)
    slope = (float(last) - float(first)) / float(end - start)
    return (float(first) + slope * (times - start).astype(np.float64)).astype(np.float32)


class _Fitter:
    """Where models can start, and how far they reach."""

    def __init__(self, times: np.ndarray, values: np.ndarray, bound: ErrorBound) -> None:
        self.t, self.v, self.bound = times, values, bound
        self.slack = bound.slack(values)
        if bound.is_lossless:
            # Aim at half a unit in the last place; what is fitted is held against the values afterwards.
            with np.errstate(all="ignore"):
                self.slack = np.nan_to_num(0.49 * np.spacing(np.abs(values)).astype(np.float64))
        n = len(values)
        finite = np.isfinite(values)
        self.stop = self._until(~finite)
        rising = np.ones(n, bool)
        rising[1:] = times[1:] > times[:-1]
        self.rises = self._until(~rising, 1)
        same = np.zeros(n, bool)
        same[1:] = (values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))
        self.equal = self._until(~same, 1)
        self.finite = finite

    @staticmethod
    def _until(bad: np.ndarray, ahead: int = 0) -> np.ndarray:
        """For each position the next one, from `ahead` positions on, that is bad; the length if there is none."""
        n = len(bad)
        at = np.where(bad, np.arange(n), n)
        following = np.minimum.accumulate(at[::-1])[::-1]
        return np.append(following[ahead:], np.full(ahead, n)) if ahead else following

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions from which a constant, and a linear model, may reach the least number of points."""
        n = len(self.v)
        flat, slope = np.zeros(n, bool), np.zeros(n, bool)
        if n < LEAST_POINTS:
            return flat, slope
        m = n - LEAST_POINTS + 1
        v = sliding_window_view(self.v.astype(np.float64), LEAST_POINTS)
        whole = self.stop[:m] >= np.arange(m) + LEAST_POINTS
        with np.errstate(all="ignore"):
            if self.bound.is_lossless:
                flat[:m] = self.equal[:m] >= np.arange(m) + LEAST_POINTS
            else:
                low, high = v.min(axis=1), v.max(axis=1)
                room = 2 * self.bound.value if not self.bound.relative else (np.abs(low) + np.abs(high)) * self.bound.value / 100
                flat[:m] = (whole & (high - low <= room * 1.001)) | (self.equal[:m] >= np.arange(m) + LEAST_POINTS)
            d = (sliding_window_view(self.t, LEAST_POINTS)[:, 1:] - self.t[:m, None]).astype(np.float64)
            s = sliding_window_view(self.slack, LEAST_POINTS)[:, 1:]
            up, down = (v[:, 1:] + s - v[:, :1]) / d, (v[:, 1:] - s - v[:, :1]) / d
            fits = down.max(axis=1) <= up.min(axis=1) + 1e-12 * np.abs(up).max(axis=1)
        slope[:m] = whole & fits & (self.rises[:m] >= np.arange(m) + LEAST_POINTS)
        return flat, slope

    def constant(self, i: int) -> tuple[int, float]:
        """How many points from i a constant holds for, and its value."""
        run = min(self.equal[i], i + MOST_POINTS) - i
        if self.bound.is_lossless or not self.finite[i]:
            return int(run), float(self.v[i])
        end, size = min(int(self.stop[i]), i + MOST_POINTS), 64
        reach = 0
        while True:
            part = self.v[i : min(i + size, end)]
            mean = (np.cumsum(part, dtype=np.float64) / np.arange(1, len(part) + 1)).astype(np.float32)
            ok = self.bound.holds(np.minimum.accumulate(part), mean) & self.bound.holds(np.maximum.accumulate(part), mean)
            reach = len(part) if ok.all() else int(np.argmin(ok))
            if reach < len(part) or i + size >= end:
                break
            size *= 4
        while reach > 0:
            value = float(np.float32(np.sum(self.v[i : i + reach], dtype=np.float64) / reach))
            if self.bound.holds(self.v[i : i + reach], np.full(reach, value, np.float32)).all():
                return reach, value
            reach //= 2
        return 0, 0.0

    def linear(self, i: int) -> tuple[int, float, float]:
        """How many points from i a line through the first one holds for, and its first and last value."""
        end, size = min(int(self.stop[i]), int(self.rises[i]), i + MOST_POINTS), 64
        v0 = float(self.v[i])
        while True:
            stop = min(i + size, end)
            d = (self.t[i + 1 : stop] - self.t[i]).astype(np.float64)
            v, s = self.v[i + 1 : stop].astype(np.float64), self.slack[i + 1 : stop]
            up, down = np.minimum.accumulate((v + s - v0) / d), np.maximum.accumulate((v - s - v0) / d)
            ok = down <= up
            reach = len(ok) if ok.all() else int(np.argmin(ok))
            if reach < len(ok) or stop >= end:
                break
            size *= 4
        while reach > 0:
            d, v = (self.t[i + 1 : i + 1 + reach] - self.t[i]).astype(np.float64), self.v[i + 1 : i + 1 + reach].astype(np.float64)
            best = float(((v - v0) * d).sum() / (d * d).sum())
            slope = max(float(down[reach - 1]), min(best, float(up[reach - 1])))
            last = float(np.float32(v0 + slope * d[-1]))
            found = line(self.t[i : i + reach + 1], int(self.t[i]), int(self.t[i + reach]), v0, last)
            good = self.bound.holds(self.v[i : i + reach + 1], found)
            if good.all():
                return reach + 1, v0, last
            reach = min(reach // 2, int(np.argmin(good)) - 1) if reach > LEAST_POINTS else 0
        return 0, 0.0, 0.0


def compress(times: np.ndarray, values: np.ndarray, bound: ErrorBound) -> list[Segment]:
    """Segments that hold all points in their order.

    From each point on both models are tried; the one with fewer bytes a value is kept if these are at most four, the
    constant one on a tie. Other points are residuals: up to 255 go with the model before them, more, and those before
    the first model, are a segment of their own. Times may repeat; values may be NaN or infinite.
    """
    times, values = np.asarray(times, np.int64), np.asarray(values, np.float32)
    n = len(values)
    fitter = _Fitter(times, values, bound)
    flat, slope = fitter.starts()
    following = _Fitter._until(flat | slope) if n else np.zeros(0, int)
    out: list[Segment] = []
    held: Segment | None = None
    i = rest = 0

    def flush(until: int) -> None:
        nonlocal held
        left = values[rest:until]
        if held is not None:
            if len(left) <= MOST_RESIDUALS:
                kept = coarse(left, bound)
                held.residuals, held.n_points = pack_floats(kept), held.n_points + len(left)
                held.values = np.concatenate([held.values, kept])
                left = left[:0]
            out.append(held)
            held = None
        for a in range(0, len(left), MOST_POINTS):
            kept = coarse(left[a : a + MOST_POINTS], bound)
            out.append(Segment(XOR, until - len(left) + a, len(kept), 0, float(kept[0]), float(kept[-1]), pack_floats(kept), kept))

    while i < n:
        i = int(following[i])
        if i >= n:
            break
        count, value = fitter.constant(i) if flat[i] else (0, 0.0)
        reach, first, last = fitter.linear(i) if slope[i] else (0, 0.0, 0.0)
        flat_cost = SEGMENT_BYTES / count if count else np.inf
        line_cost = (SEGMENT_BYTES + LINEAR_BYTES) / reach if reach else np.inf
        if min(flat_cost, line_cost) > VALUE_BYTES:
            i += 1
            continue
        flush(i)
        if flat_cost <= line_cost:
            held = Segment(CONSTANT, i, count, count, value, value, b"", np.full(count, value, np.float32))
            i += count
        else:
            made = line(times[i : i + reach], int(times[i]), int(times[i + reach - 1]), first, last)
            held = Segment(LINEAR, i, reach, reach, first, last, b"", made)
            i += reach
        rest = i
    flush(n)
    return out


def decompress(model_type: int, times: np.ndarray, model_points: int, first: float, last: float, residuals: bytes | None) -> np.ndarray:
    """A segment's values at its times."""
    extra = unpack_floats(residuals or b"")
    if model_type == XOR or not model_points:
        return extra
    if model_type == CONSTANT:
        model = np.full(model_points, first, np.float32)
    elif model_type == LINEAR:
        model = line(times[:model_points], int(times[0]), int(times[model_points - 1]), first, last)
    else:
        raise ValueError(f"unknown model type {model_type}")
    return np.concatenate([model, extra]) if len(extra) else model
