"""Irregular readings onto a regular grid by a Kalman smoother with a continuous-time local trend."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.series import HOUR_US, pack_blocks, unpack
from tidemill.runtime import attach, complete_groups, durable, group_starts, quoted, struct_text

#: Variance of the trend's noise relative to that of the level's, per slot.
TREND = 0.01
#: A reading this many robust deviations off the median of its nine neighbours doesn't steer the smoother.
GATE = 8.0
#: Slots that are worked on at once.
PIECE = 500_000


def running_median(values: np.ndarray, width: int = 9) -> np.ndarray:
    """The median of the `width` values around each value, fewer at the ends (there of an odd number)."""
    n, half = len(values), width // 2
    if n < width:
        return np.array([np.median(values[max(0, i - h) : i + h + 1]) for i in range(n) for h in [min(half, i, n - 1 - i)]]) if n else values.copy()
    middle = np.partition(sliding_window_view(values, width), half, axis=1)[:, half]
    head = [np.median(values[: 2 * i + 1]) for i in range(half)]
    tail = [np.median(values[n - 2 * i - 1 :]) for i in range(half)][::-1]
    return np.concatenate([head, middle, tail])


def _steers(values: np.ndarray, limits: tuple[float, float]) -> np.ndarray:
    """Which readings steer the smoother: finite, within the limits and not far off their neighbours."""
    finite = np.isfinite(values) & (values >= limits[0]) & (values <= limits[1])
    off = np.zeros(len(values))
    found = values[finite]
    if len(found) >= 9:
        away = np.abs(found - running_median(found))
        scatter = 1.4826 * np.median(away) or 1.2533 * np.mean(np.minimum(away, np.quantile(away, 0.98)))
        off[finite] = away > GATE * max(scatter, 1e-9)
    return finite & (off == 0)


def _noise(times: np.ndarray, values: list[np.ndarray], limits: tuple[float, float]) -> dict:
    """Variance of a reading about its level, and growth of the level's variance per second, of one block."""
    ok = _steers(values[0], limits)
    t, v = times[ok] / 1e6, values[0][ok]
    near = far = lag = wide = float("nan")
    if len(v) >= 24:
        spread = lambda k: (1.4826 * np.median(np.abs(v[k:] - v[:-k]))) ** 2 or float(np.mean((v[k:] - v[:-k]) ** 2))
        near, far = float(spread(1)), float(spread(8))
        lag, wide = float(np.median(t[1:] - t[:-1])), float(np.median(t[8:] - t[:-8]))
    growth = max(far - near, 0.02 * near) / max(wide - lag, 1e-3) if lag == lag else float("nan")
    noise = max((near - growth * lag) / 2, 0.05 * near) if lag == lag else float("nan")
    return {"__r": noise, "__q": growth}


class Lockstep:
    """Ragged arrays advanced one position at a time, all that still have one at once; the longest come first."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.offsets = (np.cumsum(lengths) - lengths)[self.order]
        self.steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(1, self.steps + 1), side="right")


def elements(lengths: np.ndarray, t: np.ndarray, y: np.ndarray, start: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Per block the effect of its readings as one associative element, 12 numbers a row.

    With the state (level, trend) x at `start`: given the block's readings, the state at the last one is normal with
    mean A x + b and covariance C, and the readings' likelihood in x has information vector e and matrix J.
    Columns: A row by row, b, C (00, 01, 11), e, J (00, 01, 11) -- 14 in all.
    """
    run = Lockstep(lengths)
    n = len(lengths)
    s = np.zeros((14, n))
    s[0] = s[3] = 1.0
    before = start[run.order].astype(float)
    rr, qq = r[run.order], q[run.order]
    for step in range(run.steps):
        m = run.active[step]
        at = run.offsets[:m] + step
        d = t[at] - before[:m]
        before[:m] = t[at]
        a00, a01, a10, a11, b0, b1, c00, c01, c11, e0, e1, j00, j01, j11 = (x[:m] for x in s)
        ql, qs = qq[:m], TREND * qq[:m]
        a00 += d * a10
        a01 += d * a11
        b0 += d * b1
        c00 += d * (2 * c01 + d * c11) + ql * d + qs * d**3 / 3
        c01 += d * c11 + qs * d * d / 2
        c11 += qs * d
        inv = 1 / (c00 + rr[:m])
        g = (y[at] - b0) * inv
        e0 += a00 * g
        e1 += a01 * g
        j00 += a00 * a00 * inv
        j01 += a00 * a01 * inv
        j11 += a01 * a01 * inv
        k0, k1 = c00 * inv, c01 * inv
        b0 += c00 * g
        b1 += c01 * g
        a10 -= k1 * a00
        a11 -= k1 * a01
        a00 *= 1 - k0
        a01 *= 1 - k0
        c11 -= k1 * c01
        c01 *= 1 - k0
        c00 *= 1 - k0
    out = np.empty((n, 14))
    out[run.order] = s.T
    return out


def _ahead(m: list, p: list, d: float, q: float) -> tuple[list, list]:
    return [m[0] + d * m[1], m[1]], [p[0] + d * (2 * p[1] + d * p[2]) + q * d + TREND * q * d**3 / 3, p[1] + d * p[2] + TREND * q * d * d / 2, p[2] + TREND * q * d]


def _through(m: list, p: list, s: list) -> tuple[list, list]:
    """The state after a block from the state before it."""
    a00, a01, a10, a11, b0, b1, c00, c01, c11, e0, e1, j00, j01, j11 = s
    w00, w01 = 1 + p[0] * j00 + p[1] * j01, p[0] * j01 + p[1] * j11
    w10, w11 = p[1] * j00 + p[2] * j01, 1 + p[1] * j01 + p[2] * j11
    det = w00 * w11 - w01 * w10
    x0, x1 = m[0] + p[0] * e0 + p[1] * e1, m[1] + p[1] * e0 + p[2] * e1
    m0, m1 = (w11 * x0 - w01 * x1) / det, (w00 * x1 - w10 * x0) / det
    p00, p01, p11 = (w11 * p[0] - w01 * p[1]) / det, (w11 * p[1] - w01 * p[2]) / det, (w00 * p[2] - w10 * p[1]) / det
    n0, n1 = a00 * p00 + a01 * p01, a00 * p01 + a01 * p11
    o0, o1 = a10 * p00 + a11 * p01, a10 * p01 + a11 * p11
    return [a00 * m0 + a01 * m1 + b0, a10 * m0 + a11 * m1 + b1], [n0 * a00 + n1 * a01 + c00, n0 * a10 + n1 * a11 + c01, o0 * a10 + o1 * a11 + c11]


def back(e0, e1, j00, j01, j11, d, q):
    """Information about the state from information about the state `d` later; numbers or arrays."""
    q00, q01, q11 = q * d + TREND * q * d**3 / 3, TREND * q * d * d / 2, TREND * q * d
    m00, m01 = 1 + j00 * q00 + j01 * q01, j00 * q01 + j01 * q11
    m10, m11 = j01 * q00 + j11 * q01, 1 + j01 * q01 + j11 * q11
    det = m00 * m11 - m01 * m10
    n00, n01, n11 = (m11 * j00 - m01 * j01) / det, (m11 * j01 - m01 * j11) / det, (m00 * j11 - m10 * j01) / det
    u0, u1 = (m11 * e0 - m01 * e1) / det, (m00 * e1 - m10 * e0) / det
    return u0, u1 + d * u0, n00, n01 + d * n00, n11 + d * (2 * n01 + d * n00)


def _back_through(f: tuple, s: list) -> tuple:
    """Information about the state before a block from information about the state after it."""
    a00, a01, a10, a11, b0, b1, c00, c01, c11, e0, e1, j00, j01, j11 = s
    f0, f1, g00, g01, g11 = f
    m00, m01 = 1 + g00 * c00 + g01 * c01, g00 * c01 + g01 * c11
    m10, m11 = g01 * c00 + g11 * c01, 1 + g01 * c01 + g11 * c11
    det = m00 * m11 - m01 * m10
    r0, r1 = f0 - g00 * b0 - g01 * b1, f1 - g01 * b0 - g11 * b1
    u0, u1 = (m11 * r0 - m01 * r1) / det, (m00 * r1 - m10 * r0) / det
    n00, n01, n11 = (m11 * g00 - m01 * g01) / det, (m11 * g01 - m01 * g11) / det, (m00 * g11 - m10 * g01) / det
    return (
        e0 + a00 * u0 + a10 * u1,
        e1 + a01 * u0 + a11 * u1,
        j00 + a00 * (n00 * a00 + n01 * a10) + a10 * (n01 * a00 + n11 * a10),
        j01 + a00 * (n00 * a01 + n01 * a11) + a10 * (n01 * a01 + n11 * a11),
        j11 + a01 * (n00 * a01 + n01 * a11) + a11 * (n01 * a01 + n11 * a11),
    )


def smooth(lengths, t, y, start, r, q, prior, tail, after):
    """Per reading: the filtered state after it (5 rows) and the information from it on (5 rows); see `regular_grid`."""
    run = Lockstep(lengths)
    total = len(t)
    forward, backward = np.zeros((5, total)), np.zeros((5, total))
    rr, qq = r[run.order], q[run.order]
    m0, m1, p00, p01, p11 = (x.copy() for x in prior[:, run.order])
    before = start[run.order].astype(float)
    for step in range(run.steps):
        m = run.active[step]
        at = run.offsets[:m] + step
        d = t[at] - before[:m]
        before[:m] = t[at]
        ql, qs = qq[:m], TREND * qq[:m]
        m0[:m] += d * m1[:m]
        p00[:m] += d * (2 * p01[:m] + d * p11[:m]) + ql * d + qs * d**3 / 3
        p01[:m] += d * p11[:m] + qs * d * d / 2
        p11[:m] += qs * d
        inv = 1 / (p00[:m] + rr[:m])
        g = (y[at] - m0[:m]) * inv
        m0[:m] += p00[:m] * g
        m1[:m] += p01[:m] * g
        k0, k1 = p00[:m] * inv, p01[:m] * inv
        p11[:m] -= k1 * p01[:m]
        p01[:m] *= 1 - k0
        p00[:m] *= 1 - k0
        for row, x in zip(forward, (m0, m1, p00, p01, p11)):
            row[at] = x[:m]
    info = [x.copy() for x in tail[:, run.order]]
    later = after[run.order].astype(float)
    for step in range(run.steps - 1, -1, -1):
        m = run.active[step]
        at = run.offsets[:m] + step
        d = np.where(np.isfinite(later[:m]), later[:m] - t[at], 0.0)
        later[:m] = t[at]
        # The longest blocks come first, so those that join at this step are the last ones of `m`.
        moved = back(*(x[:m] for x in info), d, qq[:m])
        for x, new in zip(info, moved):
            x[:m] = new
        info[0][:m] += y[at] / rr[:m]
        info[2][:m] += 1 / rr[:m]
        for row, x in zip(backward, info):
            row[at] = x[:m]
    return forward, backward


def regular_grid(df: DataFrame, keys: Sequence[str], ts: str, value: str, slot_us: int = 600_000_000, block_hours: int = 12, limits: tuple[float, float] = (-np.inf, np.inf)) -> DataFrame:
    """One row per series and slot, from the slot of its first to that of its last usable reading.

    Columns: the keys, `slot_us` bigint (start of the slot), `readings` int (usable ones in the slot), `missing`
    boolean (none), `value` and `deviation` double: the smoothed level at the start of the slot and its standard
    deviation. Slots are `slot_us` long, start included and end excluded, aligned to 1970-01-01.

    Null and NaN are no readings. Infinities, readings outside `limits` and readings far off their neighbours fill
    their slot but don't steer the smoother. Rows equal in key, time and value count once, further readings at the same time all count. A null
    key is a series of its own; rows without time are ignored; an empty table gives no rows. A series without finite
    reading has null for value and deviation.

    Method: level and trend of a series are a continuous-time random walk with noise variances of its own, taken
    from robust spreads of differences at two lags. The series is cut into blocks of `block_hours`. The effect of a
    block's readings is one element of an associative operation; a scan over the elements (one row per block) gives
    the exact state and later information at each block's edge, from which all blocks are smoothed independently.
    Results are those of one smoother over the whole series; no task holds more than a block of readings.
    """
    keys = list(keys)
    width = block_hours * HOUR_US
    if slot_us < 1 or width % slot_us:
        raise ValueError("slot_us must divide the block")
    good = df.where(F.col(quoted(value)).isNotNull() & ~F.isnan(F.col(quoted(value)).cast("double")))
    names = [f"__k{i}" for i in range(len(keys))]
    blocks = durable(pack_blocks(good, keys, ts, [value], block_hours, lambda t, v: _noise(t, v, limits), "__r double, __q double"))
    weight = F.when(F.col("__r").isNotNull() & ~F.isnan("__r"), F.col("__n").cast("long")).otherwise(F.lit(0).cast("long"))
    whole = Window.partitionBy(*names)

    def median(column: str):
        return F.percentile(F.when(weight > 0, F.col(column)), F.lit(0.5), F.when(weight > 0, F.col("__n")).otherwise(1)).over(whole)

    tuned = blocks.select(*names, "__block", F.coalesce(median("__r"), F.lit(1e-2)).alias("__R"), F.coalesce(median("__q"), F.lit(1e-5)).alias("__Q"))
    key_ddl = struct_text(blocks, names)

    def joined(other: DataFrame) -> DataFrame:
        return attach(blocks.drop("__r", "__q"), other, [*names, "__block"])

    def unpacked(batch: pa.RecordBatch):
        t = [unpack(x, np.int64) for x in batch.column("__t").to_pylist()]
        v = [unpack(x, np.float64) for x in batch.column("__v0").to_pylist()]
        first = np.array([x[0] // slot_us for x in t], np.int64)
        steer = [_steers(x, limits) for x in v]
        lengths = np.array([int(s.sum()) for s in steer], np.int64)
        # Times in slots since the start of the block's first slot.
        at = np.concatenate([(x[s] - f * slot_us) / slot_us for x, s, f in zip(t, steer, first)])
        y = np.concatenate([x[s] for x, s in zip(v, steer)])
        r = np.maximum(batch.column("__R").to_numpy(zero_copy_only=False), 1e-6)
        q = np.maximum(batch.column("__Q").to_numpy(zero_copy_only=False) * (slot_us / 1e6), 1e-7)
        return t, first, lengths, at, y, r, q

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, first, lengths, at, y, r, q = unpacked(batch)
            found = elements(lengths, at, y, np.zeros(len(first)), r, q)
            ends = np.cumsum(lengths)
            last = np.array([at[e - 1] if n else 0.0 for e, n in zip(ends, lengths)])
            guess = np.array([y[e - n] if n else np.nan for e, n in zip(ends, lengths)])
            columns = [*(batch.column(n) for n in [*names, "__block"]), pa.array(first), pa.array(last), pa.array([int(x[-1] // slot_us) for x in t]), pa.array(guess), pa.array(q), pa.array(r), pa.array(list(found), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "__block", "__first", "__last", "__end", "__guess", "__q", "__r", "__element"])

    ddl = ", ".join(filter(None, [key_ddl, "__block bigint, __first bigint, __last double, __end bigint, __guess double, __q double, __r double, __element array<double>"]))
    reduced = joined(tuned).mapInArrow(reduce, ddl)
    placed = reduced.repartition(*names) if names else reduced.repartition(1)
    placed = placed.sortWithinPartitions(*names, "__block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, names, 20_000):
            rows = table.select(["__first", "__last", "__end", "__guess", "__q", "__r", "__element"]).to_pylist()
            starts = group_starts(table, names).tolist() if names else [0]
            states, infos, following = [], [None] * len(rows), [None] * len(rows)
            for a, b in zip(starts, [*starts[1:], len(rows)]):
                guess = next((x["__guess"] for x in rows[a:b] if x["__guess"] == x["__guess"]), None)
                wide = 1e4 * (rows[a]["__r"] + rows[a]["__q"])
                m, p = [guess if guess is not None else float("nan"), 0.0], [wide, 0.0, wide]
                for i in range(a, b):
                    states.append([*m, *p])
                    m, p = _through(m, p, rows[i]["__element"])
                    if i + 1 < b:
                        m, p = _ahead(m, p, rows[i + 1]["__first"] - rows[i]["__first"] - rows[i]["__last"], rows[i]["__q"])
                info = (0.0,) * 5
                for i in range(b - 1, a - 1, -1):
                    infos[i] = list(info)
                    here = info
                    if i + 1 < b:
                        following[i] = rows[i + 1]["__first"]
                        here = back(*info, rows[i + 1]["__first"] - rows[i]["__first"] - rows[i]["__last"], rows[i]["__q"])
                    info = _back_through(here, rows[i]["__element"])
            columns = [*(_flat(table.column(n)) for n in [*names, "__block"]), pa.array(states, pa.list_(pa.float64())), pa.array(infos, pa.list_(pa.float64())), pa.array(following, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "__block", "__state", "__info", "__following"])

    ddl = ", ".join(filter(None, [key_ddl, "__block bigint, __state array<double>, __info array<double>, __following bigint"]))
    edges = placed.mapInArrow(scan, ddl)
    both = attach(edges, tuned, [*names, "__block"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, first, lengths, at, y, r, q = unpacked(batch)
            prior = np.array(batch.column("__state").to_pylist(), float).T
            tail = np.array(batch.column("__info").to_pylist(), float).T
            following = [x for x in batch.column("__following").to_pylist()]
            after = np.array([np.nan if x is None else x - f for x, f in zip(following, first.tolist())], float)
            forward, backward = smooth(lengths, at, y, np.zeros(len(first)), r, q, prior, tail, after)
            slots = np.array([(x if x is not None else int(times[-1] // slot_us) + 1) - f for x, times, f in zip(following, t, first.tolist())], np.int64)
            begins, base = np.cumsum(lengths) - lengths, np.cumsum(slots) - slots
            span = float(slots.max()) + 2
            order = at + np.repeat(np.arange(len(first)), lengths) * span
            which = np.sort(np.concatenate([times // slot_us - f + o for times, f, o in zip(t, first, base)]))
            if not len(at):
                forward, backward, at = np.zeros((5, 1)), np.zeros((5, 1)), np.zeros(1)
            # Slots of a batch in pieces: a date far off makes very many of them.
            for start in range(0, int(slots.sum()), PIECE):
                number = np.arange(start, min(start + PIECE, int(slots.sum())))
                owner = np.searchsorted(base, number, side="right") - 1
                grid = (number - base[owner]).astype(float)
                # Position of the last reading at or before each slot's start, within the block's readings.
                place = np.searchsorted(order, grid + owner * span, side="right")
                past, ahead = place > begins[owner], place < (begins + lengths)[owner]
                low, high = np.clip(place - 1, 0, max(len(at) - 1, 0)), np.clip(place, 0, max(len(at) - 1, 0))
                x0, x1, p00, p01, p11 = (np.where(past, f[low], g[owner]) for f, g in zip(forward, prior))
                d = np.where(past, grid - at[low], grid)
                qq = q[owner]
                x0 = x0 + d * x1
                p00 = p00 + d * (2 * p01 + d * p11) + qq * d + TREND * qq * d**3 / 3
                p01 = p01 + d * p11 + TREND * qq * d * d / 2
                p11 = p11 + TREND * qq * d
                info = [np.where(ahead, f[high], g[owner]) for f, g in zip(backward, tail)]
                e = np.where(ahead, at[high] - grid, np.nan_to_num(after[owner] - grid))
                e0, e1, j00, j01, j11 = back(*info, e, qq)
                w00, w01 = 1 + p00 * j00 + p01 * j01, p00 * j01 + p01 * j11
                w10, w11 = p01 * j00 + p11 * j01, 1 + p01 * j01 + p11 * j11
                det = w00 * w11 - w01 * w10
                level = (w11 * (x0 + p00 * e0 + p01 * e1) - w01 * (x1 + p01 * e0 + p11 * e1)) / det
                variance = (w11 * p00 - w01 * p01) / det
                some = which[np.searchsorted(which, start) : np.searchsorted(which, start + PIECE)]
                readings = np.bincount(some - start, minlength=len(number)).astype(np.int32)
                none = ~np.isfinite(level)
                columns = [*(_flat(batch.column(n).take(pa.array(owner))) for n in names), pa.array(((grid.astype(np.int64) + first[owner]) * slot_us)), pa.array(readings), pa.array(readings == 0), pa.array(level, mask=none), pa.array(np.sqrt(np.maximum(variance, 0)), mask=none)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "slot_us", "readings", "missing", "value", "deviation"])

    ddl = ", ".join(filter(None, [key_ddl, "slot_us bigint, readings int, missing boolean, value double, deviation double"]))
    filled = joined(both).mapInArrow(fill, ddl)
    return filled.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "slot_us", "readings", "missing", "value", "deviation")


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column
