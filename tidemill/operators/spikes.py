"""Implausible readings: impossible values, stuck runs and spikes, against each source's own behaviour."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.regular_grid import running_median
from tidemill.operators.series import HOUR_US, pack, pack_blocks, unpack
from tidemill.runtime import attach, complete_groups, durable, group_starts, struct_text

#: Values kept of each block's edges, for the levels of its neighbours.
EDGE = 16
#: Bins of the residuals' size, PER to a doubling, the first from 2 ** LOWEST.
PER, LOWEST = 8, -20
BINS = 60 * PER
#: The tail that is fitted: sizes above this part of all.
PEAKS = 0.9
#: Where the first fit ends, in scatters; see tail_cutoff.
CORE = 4.0
#: Standard deviation of the tail's shape about 0 (an exponential tail) before its peaks are seen: a few hundred peaks
#: alone would not tell the shape well enough to go on to a small risk.
SHAPE = 0.05
#: Sizes that a fit needs at least.
FEW = 50
#: Values that a scatter needs at least; no more than EDGE.
LEAST = 9


@dataclass(frozen=True)
class Rules:
    """Limits of one column. `period` is that of circular values (360 for degrees), None for others."""

    lowest: float = -np.inf
    highest: float = np.inf
    period: float | None = None


@dataclass(frozen=True)
class Settings:
    """`stuck`: equal values in a row from which on a run is stuck. `longest`: values in a row that may be a spike.

    `risk`: chance of an ordinary reading to lie beyond its source's cutoff. One in a hundred million leaves a table of
    billions of readings with tens of candidates that aren't spikes, before the rule on levels is asked.
    """

    stuck: int = 20
    longest: int = 3
    risk: float = 1e-8


def wrap(difference: np.ndarray, period: float | None) -> np.ndarray:
    """A difference along the shorter way round."""
    if period is None:
        return difference
    return (difference + period / 2) % period - period / 2


def _level(values: np.ndarray, start: int, end: int, period: float | None) -> float:
    """The median of a stretch; of circular values about their mean direction, which a few far off don't turn round."""
    part = values[max(start, 0) : end].tolist()
    about = 0.0
    if period is not None:
        turn = 2 * math.pi / period
        about = math.atan2(sum(math.sin(v * turn) for v in part), sum(math.cos(v * turn) for v in part)) / turn
        part = [(v - about + period / 2) % period - period / 2 for v in part]
    part.sort()
    half = len(part) // 2
    return about + (part[half] if len(part) % 2 else (part[half - 1] + part[half]) / 2)


def running_level(values: np.ndarray, period: float | None, width: int = 9) -> np.ndarray:
    """The running median; of circular values about each window's mean direction.

    Unrolling them to a curve first would hide spikes half a turn off: the steps up and back may wrap to one sign, and
    the spike then is between the values before and those after it.
    """
    if period is None:
        return running_median(values, width)
    n, half = len(values), width // 2
    level = np.empty(n)
    if n >= width:
        windows = sliding_window_view(values, width)
        turns = sliding_window_view(np.exp(2j * np.pi / period * values), width).sum(axis=1)
        about = np.angle(turns) * period / (2 * np.pi)
        level[half : n - half] = about + np.partition(wrap(windows - about[:, None], period), half, axis=1)[:, half]
    for i in range(n) if n < width else [*range(half), *range(n - half, n)]:
        h = min(half, i, n - 1 - i)
        level[i] = _level(values, i - h, i + h + 1, period)
    return level


def _residuals(values: np.ndarray, period: float | None) -> np.ndarray:
    return wrap(values - running_level(values, period), period)


def _spread(values: np.ndarray, hours: np.ndarray, period: float | None, stuck: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Of values and their hours of the day: the scatter about their level, counts of residual sizes, and sums and
    counts of calm residuals by hour. Stuck runs say nothing on sizes and aren't counted."""
    away = _residuals(values, period)
    size = np.abs(away)
    robust = 1.4826 * float(np.median(size))
    # The median of coarse readings is a multiple of their resolution; the mean of clipped sizes isn't.
    scatter = 1.2533 * float(np.mean(np.minimum(size, 6 * robust if robust else np.quantile(size, 0.98))))
    calm = size <= 5 * max(scatter, 1e-9)
    sums = np.concatenate([np.bincount(hours[calm], weights=away[calm], minlength=24), np.bincount(hours[calm], minlength=24)])
    moving = ~_stuck(values, (np.nan, 0), (np.nan, 0), stuck)
    # Readings and their level are rounded: a residual stands for all that are less than the resolution off it, the
    # nearer ones more often, so that the tail of coarse readings has no steps.
    change = np.abs(wrap(np.diff(values), period))
    change = change[change > 0]
    step = float(np.quantile(change, 0.05)) if len(change) else 0.0
    number = np.arange(int(moving.sum()))
    spread = np.abs(away[moving] + step * ((number * 0.7548776662466927) % 1 + (number * 0.5698402909980532) % 1 - 1))
    return scatter, sizes_of(spread), sums


def sizes_of(size: np.ndarray) -> np.ndarray:
    """Counts of sizes by bin."""
    place = np.floor(PER * (np.log2(np.maximum(size, 2.0**LOWEST)) - LOWEST))
    return np.bincount(np.clip(place, 0, BINS - 1).astype(int), minlength=BINS).astype(np.int32)


def _summary(times: np.ndarray, values: list[np.ndarray], rules: list[Rules], stuck: int) -> dict:
    """What the rest of a source has to know of a block, per column; a bounded number of bytes.

    A block of fewer than LEAST values has no scatter of its own; all its values are at its edges, and their hours follow.
    """
    out: dict = {}
    for i, (v, rule) in enumerate(zip(values, rules)):
        good = ~np.isnan(v)
        u = v[good]
        possible = (u >= rule.lowest) & (u <= rule.highest)
        p = u[possible]
        edge = np.flatnonzero(u[1:] != u[:-1]) + 1 if len(u) else np.zeros(0, int)
        head, tail = (int(edge[0]), int(len(u) - edge[-1])) if len(edge) else (len(u), len(u))
        runs = np.array([head, tail, len(u), u[0] if len(u) else np.nan, u[-1] if len(u) else np.nan], float)
        counts, hours, sizes, few = np.zeros(BINS, np.int32), np.zeros(48), np.zeros(3), np.zeros(0)
        hour = (times[good][possible] // HOUR_US % 24).astype(int)
        if len(p) >= LEAST:
            scatter, counts, hours = _spread(p, hour, rule.period, stuck)
            sizes[:] = scatter, len(p), 0
        else:
            few = hour.astype(float)
        out[f"__c{i}"] = pack(np.concatenate([sizes, runs, hours, few]))
        out[f"__h{i}"] = pack(counts)
        out[f"__a{i}"] = pack(p[:EDGE])
        out[f"__z{i}"] = pack(p[-EDGE:])
    return out


def _joined(stats: list[np.ndarray], edges: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values, and their hours, of neighbouring blocks that are too small for a scatter; only where they are enough
    together. A block without values parts nothing."""
    out, held, hours = [], [], []
    for s, values in [*zip(stats, edges), (None, None)]:
        if s is not None and s[1] == 0:
            held.append(values)
            hours.append(s[56:].astype(int))
            continue
        if sum(map(len, held)) >= LEAST:
            out.append((np.concatenate(held), np.concatenate(hours)))
        held, hours = [], []
    return out


def tail_cutoff(counts: np.ndarray, scatter: float, risk: float) -> float:
    """The size that an ordinary residual exceeds with probability `risk`, by peaks over threshold.

    A generalised Pareto distribution is fitted to the excesses over the PEAKS point by penalised maximum likelihood,
    of ordinary sizes only: the first fit sees those up to CORE scatters, each further one those up to the cutoff of
    the one before, as values of a distribution that is cut off there. So the fit grows along an unbroken tail, however
    long, until it ends within its own cutoff, and spikes beyond a gap don't move it, however large or many they are.
    Of fewer than FEW sizes nothing is fitted; the tail then is exponential, with half the scatter as its scale.
    """
    counts = counts.astype(float)
    total = float(counts.sum())
    if scatter <= 0:
        return 0.0
    if total < FEW:
        return scatter * (1.645 + 0.5 * math.log((1 - PEAKS) / risk))
    edges = 2.0 ** (np.arange(BINS + 1) / PER + LOWEST)
    above = np.cumsum(counts[::-1])[::-1]
    start = max(int(np.searchsorted(-above, -(1 - PEAKS) * total, side="right")) - 1, 0)
    shapes = np.linspace(-0.5, 0.9, 29)
    bent = np.where(np.abs(shapes) < 1e-9, 1.0, shapes)[:, None, None]
    stop, cut = int(np.searchsorted(edges, CORE * scatter)), 0.0
    for _ in range(BINS):
        stop = min(max(stop, start + 2), BINS)
        excess, seen = edges[start : stop + 1] - edges[start], counts[start:stop]
        mean = max(float((seen * (excess[1:] + excess[:-1])).sum()) / 2 / max(float(seen.sum()), 1.0), float(excess[1]))
        scales = mean * np.geomspace(0.25, 4, 70)
        ratio = excess[None, None, :] / scales[None, :, None]
        with np.errstate(divide="ignore"):
            beyond = np.where(np.abs(shapes)[:, None, None] < 1e-9, np.exp(-ratio), np.maximum(1 + bent * ratio, 0.0) ** (-1 / bent))
        inside = np.maximum(beyond[:, :, :-1] - beyond[:, :, 1:], 1e-300)
        part = 1 - beyond[:, :, -1]
        fit = (seen * np.log(inside)).sum(axis=2) - seen.sum() * np.log(np.maximum(part, 1e-300)) - 0.5 * (shapes / SHAPE)[:, None] ** 2
        i, j = np.unravel_index(int(np.argmax(fit)), fit.shape)
        shape, scale = float(shapes[i]), float(scales[j])
        peaks = float(seen.sum()) / max(float(part[i, j]), 1e-9)
        odds = risk * (total - above[start] + peaks) / max(peaks, 1.0)
        further = -math.log(odds) if abs(shape) < 1e-9 else (odds**-shape - 1) / shape
        cut = float(edges[start] + scale * further)
        reach = int(np.searchsorted(edges, cut))
        # What lies between this end of the fit and its cutoff is ordinary after all; without any, the fit is done.
        if reach <= stop or not counts[stop:reach].any():
            break
        stop = reach
    return cut


def _carried(rows: list[dict], i: int, rule: Rules, settings: Settings) -> list[dict]:
    """For each block of one source, in order: the cutoffs of the source and what surrounds the block."""
    stats = [unpack(r[f"__c{i}"], np.float64) for r in rows]
    head, tail = [unpack(r[f"__a{i}"], np.float64) for r in rows], [unpack(r[f"__z{i}"], np.float64) for r in rows]
    joined = [(len(v), *_spread(v, h, rule.period, settings.stuck)) for v, h in _joined(stats, head)]
    weight = np.array([s[1] for s in stats] + [j[0] for j in joined])
    scatters = np.array([s[0] for s in stats] + [j[1] for j in joined])
    order = np.argsort(scatters)
    order = order[weight[order] > 0]
    if len(order):
        part = np.cumsum(weight[order])
        scatter = float(scatters[order][np.searchsorted(part, part[-1] / 2)])
    else:
        scatter = 0.0
    hours = sum(s[8:56] for s in stats) + sum(j[3] for j in joined)
    profile = hours[:24] / np.maximum(hours[24:], 1)
    counts = sum(np.asarray(unpack(r[f"__h{i}"], np.int32), np.int64) for r in rows) + sum(j[2].astype(np.int64) for j in joined)
    cut = tail_cutoff(counts, scatter, settings.risk)
    n = len(rows)
    before, after, left, right = [None] * n, [None] * n, [None] * n, [None] * n
    held, run = np.zeros(0), (np.nan, 0.0)
    for k in range(n):
        before[k], left[k] = held, run
        held = np.concatenate([held, tail[k]])[-EDGE:]
        first, last, count, a, z = stats[k][3:8]
        if count:
            run = (z, last + run[1] if last == count and z == run[0] else last)
    held, run = np.zeros(0), (np.nan, 0.0)
    for k in range(n - 1, -1, -1):
        after[k], right[k] = held, run
        held = np.concatenate([head[k], held])[:EDGE]
        first, last, count, a, z = stats[k][3:8]
        if count:
            run = (a, first + run[1] if first == count and a == run[0] else first)
    return [
        {f"__s{i}": pack(np.concatenate([[scatter, cut, *left[k], *right[k]], profile])), f"__b{i}": pack(before[k]), f"__f{i}": pack(after[k])}
        for k in range(n)
    ]


def _levels(curve: np.ndarray, first: np.ndarray, width: int, period: float | None) -> np.ndarray:
    """The medians of `width` values from each of some places on; NaN are no values. Circular ones about their mean
    direction, which a few far off don't turn round."""
    rows = curve[first[:, None] + np.arange(width)]
    about = np.zeros(len(rows))
    if period is not None:
        about = np.angle(np.nansum(np.exp(2j * np.pi / period * rows), axis=1)) * period / (2 * np.pi)
        rows = wrap(rows - about[:, None], period)
    # Sorting puts NaN last.
    count, rows, each = (~np.isnan(rows)).sum(axis=1), np.sort(rows, axis=1), np.arange(len(rows))
    return about + (rows[each, (count - 1) // 2] + rows[each, count // 2]) / 2


def spike_mask(values: np.ndarray, times: np.ndarray, rule: Rules, settings: Settings, scatter: float, cut: float, profile: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of a block's possible values are spikes; `before` and `after` are the values around the block.

    A value beyond the cutoff is one if it, or up to `longest` values with it, are beyond the cutoff from the level of
    the seven, or the three, values before and of those after, while these values and levels agree.
    """
    n, lead = len(values), len(before)
    found = np.zeros(n, bool)
    if scatter <= 0:
        return found
    curve = np.concatenate([before, values, after])
    seasonal = _residuals(curve, rule.period)[lead : lead + n] - profile[(times // HOUR_US % 24).astype(int)]
    candidate = np.flatnonzero(np.abs(seasonal) > cut) + lead
    if not len(candidate):
        return found
    pad = 7
    padded = np.concatenate([np.full(pad, np.nan), curve, np.full(pad, np.nan)])
    gap = lambda a, b: np.abs(wrap(a - b, rule.period))
    for width in (7, 3):
        for run in range(1, settings.longest + 1):
            for back in range(run):
                s = candidate - back
                s = s[(s >= 3) & (s + run + 3 <= len(curve))]
                if not len(s):
                    continue
                low, high = _levels(padded, s + pad - width, width, rule.period), _levels(padded, s + pad + run, width, rule.period)
                part = curve[s[:, None] + np.arange(run)]
                off = np.minimum(gap(part, low[:, None]).min(axis=1), gap(part, high[:, None]).min(axis=1))
                near = np.maximum(gap(curve[s - 1], low), gap(curve[s + run], high))
                hit = (off > cut) & (near < off / 2) & (gap(high, low) < off / 2)
                at = (s[hit][:, None] + np.arange(run)).ravel() - lead
                found[at[(at >= 0) & (at < n)]] = True
    return found


def flag_readings(df: DataFrame, keys: Sequence[str], ts: str, columns: Mapping[str, Rules], settings: Settings = Settings(), block_hours: int = 96) -> DataFrame:
    """The readings of each source that are impossible, stuck or spikes; one row per reading, column and kind.

    Columns: the keys, `timestamp_us` bigint, `column_name` string, `value` double, `kind` string, `scatter` and
    `cutoff` double (the source's usual scatter about its level, and the fitted cutoff of its residuals).

    * impossible: below `lowest` or above `highest`, infinities included;
    * stuck: in a run of at least `stuck` exactly equal values;
    * spike: one of at most `longest` possible values in a row that are further than the source's cutoff off the level
      held just before and just after. So of two sources with the same scatter, one whose readings often stray and one
      whose don't, the first needs a larger deviation.

    Null and NaN are skipped, so values around them are neighbours. Rows equal in key, time and all columns count
    once; ties in time are ordered by value. A null key is a source of its own; rows without time are ignored; an
    empty table gives no rows. A source with fewer than nine possible values has no scatter and no spikes; blocks with
    fewer are put together with such blocks beside them, so how slowly a source is read doesn't matter.

    Method: residuals about the running median, less their mean by hour of the day, per source; a generalised Pareto
    fit to their peaks gives the source's cutoff at a fixed risk. A reading is a spike if it is beyond that cutoff and
    the levels before and after it agree: the rule on levels only tells a spike from a step or a slope. Blocks
    of a source send counts of residual sizes, sums by hour and the values at their edges (a bounded number) to one
    scan per source; a run or spike across blocks is seen from both. No task holds more than a block of readings.
    """
    keys, columns = list(keys), dict(columns)
    rules, fields = list(columns.values()), list(columns)
    names = [f"__k{i}" for i in range(len(keys))]
    per = [f"__{x}{i}" for i in range(len(fields)) for x in "chaz"]
    blocks = durable(pack_blocks(df, keys, ts, fields, block_hours, lambda t, v: _summary(t, v, rules, settings.stuck), ", ".join(f"{c} binary" for c in per)))
    placed = blocks.select(*names, "__block", *per)
    placed = (placed.repartition(*names) if names else placed.repartition(1)).sortWithinPartitions(*names, "__block")
    key_ddl = struct_text(blocks, names)
    sent = [f"__{x}{i}" for i in range(len(fields)) for x in "sbf"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, names, 5_000):
            rows = table.select(per).to_pylist()
            starts = group_starts(table, names).tolist() if names else [0]
            out: dict[str, list] = {c: [] for c in sent}
            for a, b in zip(starts, [*starts[1:], len(rows)]):
                for i, rule in enumerate(rules):
                    for row in _carried(rows[a:b], i, rule, settings):
                        for c, x in row.items():
                            out[c].append(x)
            heads = [pa.concat_arrays(table.column(n).chunks) if table.column(n).num_chunks != 1 else table.column(n).chunk(0) for n in [*names, "__block"]]
            yield pa.RecordBatch.from_arrays([*heads, *(pa.array(out[c], pa.binary()) for c in sent)], names=[*names, "__block", *sent])

    ddl = ", ".join(filter(None, [key_ddl, "__block bigint", *(f"{c} binary" for c in sent)]))
    whole = attach(blocks.drop(*per), placed.mapInArrow(scan, ddl), [*names, "__block"])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {x: [] for x in ("at", "us", "column", "value", "kind", "scatter", "cut")}
            for at, row in enumerate(batch.select(["__t", *(f"__v{i}" for i in range(len(fields))), *sent]).to_pylist()):
                times = unpack(row["__t"], np.int64)
                for i, (field, rule) in enumerate(zip(fields, rules)):
                    v = unpack(row[f"__v{i}"], np.float64)
                    head = unpack(row[f"__s{i}"], np.float64)
                    (scatter, cut, left, left_n, right, right_n), profile = head[:6], head[6:]
                    t, u = times[~np.isnan(v)], v[~np.isnan(v)]
                    possible = (u >= rule.lowest) & (u <= rule.highest)
                    masks = {"impossible": ~possible, "stuck": _stuck(u, (left, left_n), (right, right_n), settings.stuck), "spike": np.zeros(len(u), bool)}
                    masks["spike"][possible] = spike_mask(u[possible], t[possible], rule, settings, scatter, cut, profile, unpack(row[f"__b{i}"], np.float64), unpack(row[f"__f{i}"], np.float64))
                    masks["spike"] &= ~masks["stuck"]
                    for kind, mask in masks.items():
                        hit = np.flatnonzero(mask)
                        if len(hit):
                            for name, part in zip(found, (np.full(len(hit), at), t[hit], [field] * len(hit), u[hit], [kind] * len(hit), np.full(len(hit), scatter), np.full(len(hit), cut))):
                                found[name].extend(part)
            owner = pa.array(found["at"], pa.int64())
            arrays = [*(batch.column(n).take(owner) for n in names), pa.array(found["us"], pa.int64()), pa.array(found["column"], pa.string()), pa.array(found["value"], pa.float64()), pa.array(found["kind"], pa.string()), pa.array(found["scatter"], pa.float64()), pa.array(found["cut"], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "timestamp_us", "column_name", "value", "kind", "scatter", "cutoff"])

    ddl = ", ".join(filter(None, [key_ddl, "timestamp_us bigint, column_name string, value double, kind string, scatter double, cutoff double"]))
    flagged = whole.mapInArrow(flag, ddl)
    return flagged.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "timestamp_us", "column_name", "value", "kind", "scatter", "cutoff")


def _stuck(u: np.ndarray, left: tuple[float, float], right: tuple[float, float], least: int) -> np.ndarray:
    """Members of runs of at least `least` equal values, counted on into the runs around the block."""
    if not len(u):
        return np.zeros(0, bool)
    start = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1])
    length = np.diff(np.append(start, len(u))).astype(float)
    size = length.copy()
    if left[0] == u[0]:
        size[0] += left[1]
    if right[0] == u[-1]:
        size[-1] += right[1]
    return np.repeat(size >= least, length.astype(int))
