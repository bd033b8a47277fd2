"""Percentiles per group from small summaries that can be combined, exact at the ends, with a stated error."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.runtime import codes, group_starts, quoted, struct_text

#: Section size of the compactors if none is named: rank errors of about one percent of the distance to the nearer end.
SECTION = 32
#: One standard deviation of the relative rank error is at most this over the section size (measured by the tests).
SIGMA = 0.131


def _bit(*parts: int) -> int:
    """A bit that looks random, from numbers."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ p) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
    x = (x * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (x >> 33) & 1


class Compactors:
    """Levels of relative compactors that protect the low end: an item of level h stands for 2 ** h values.

    A full level keeps its lowest half or more. Of the rest, as many sections as the trailing ones of its counter
    say are sorted and every other item moves up, so the ends of the rest are compacted less often than its middle.
    """

    __slots__ = ("counters", "k", "levels", "n", "widths")

    def __init__(self, k: int) -> None:
        self.k = k
        self.n = 0
        self.levels: list[list[np.ndarray]] = [[]]
        self.widths = [0]
        self.counters = [0]

    def capacity(self) -> int:
        return 2 * self.k * max(3, math.ceil(math.log2(max(self.n / self.k, 2))))

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.levels[0].append(values)
            self.widths[0] += len(values)
            self._settle()

    def merge(self, other: Compactors) -> None:
        self.n += other.n
        for h, parts in enumerate(other.levels):
            self._reach(h)
            self.levels[h] += parts
            self.widths[h] += other.widths[h]
            self.counters[h] |= other.counters[h]
        self._settle()

    def _reach(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append([])
            self.widths.append(0)
            self.counters.append(0)

    def _settle(self) -> None:
        most = self.capacity()
        h = 0
        while h < len(self.levels):
            if self.widths[h] > most:
                items = np.sort(np.concatenate(self.levels[h]))
                counter = self.counters[h]
                sections = ((~counter & (counter + 1)).bit_length() - 1) + 1
                keep = max(most // 2, most - sections * self.k)
                keep += (len(items) - keep) % 2
                start = keep + _bit(self.n, h, counter, len(items))
                up = items[start::2]
                self.levels[h] = [items[:keep]]
                self.widths[h] = keep
                self.counters[h] = counter + 1
                self._reach(h + 1)
                self.levels[h + 1].append(up)
                self.widths[h + 1] += len(up)
            h += 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Kept values in order and how many values each stands for."""
        values = np.concatenate([np.concatenate(p) if p else np.zeros(0) for p in self.levels])
        weights = np.concatenate([np.full(w, 1 << h, np.int64) for h, w in enumerate(self.widths)])
        order = np.argsort(values, kind="stable")
        return values[order], weights[order]


class Sketch:
    """Two stacks of compactors, one for each end. Few values are kept as they are, and the result is exact."""

    __slots__ = ("few", "high", "k", "low", "n")

    def __init__(self, k: int = SECTION) -> None:
        if k < 4 or k % 2:
            raise ValueError("the section size must be even and at least 4")
        self.k = k
        self.n = 0
        self.few: list[np.ndarray] | None = []
        self.low = self.high = None

    def _open(self) -> None:
        if self.few is not None:
            self.low, self.high = Compactors(self.k), Compactors(self.k)
            few, self.few = self.few, None
            if few:
                values = np.concatenate(few)
                self.low.add(values)
                self.high.add(-values)

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        if self.few is not None and self.n <= 6 * self.k:
            self.few.append(values)
            return
        self._open()
        self.low.add(values)
        self.high.add(-values)

    def merge(self, other: Sketch) -> None:
        if other.k != self.k:
            raise ValueError("sketches of different section sizes can't be merged")
        if other.few is not None:
            for part in other.few:
                self.add(part)
            return
        self.n += other.n
        self._open()
        self.low.merge(other.low)
        self.high.merge(other.high)

    def quantile(self, q: float) -> tuple[float, float, float]:
        """The value at rank ceil(q n), and those at the ends of the stated error about it."""
        error = self.rank_error(q)
        at = lambda p: self._at(min(max(math.ceil(p * self.n), 1), self.n))
        return at(q), at(q - error), at(q + error)

    def rank_error(self, q: float) -> float:
        """Three standard deviations of the rank error at q, as a share of all values; 0 where the result is exact."""
        return 0.0 if self.few is not None else 3 * SIGMA / self.k * min(q, 1 - q)

    def _at(self, rank: int) -> float:
        if self.few is not None:
            return float(np.sort(np.concatenate(self.few))[rank - 1])
        if 2 * rank <= self.n:
            values, weights = self.low.weighted()
            return float(values[min(np.searchsorted(np.cumsum(weights), rank), len(values) - 1)])
        values, weights = self.high.weighted()
        return -float(values[min(np.searchsorted(np.cumsum(weights), self.n - rank + 1), len(values) - 1)])

    def quantiles(self, qs: Sequence[float]) -> list[tuple[float, float, float, float]]:
        """Per q: the value, its lower and upper end, and the rank error."""
        if self.few is not None:
            values = np.sort(np.concatenate(self.few))
            places = [min(max(math.ceil(q * self.n), 1), self.n) - 1 for q in qs]
            return [(float(values[p]),) * 3 + (0.0,) for p in places]
        low, high = [(v, np.cumsum(w)) for v, w in (self.low.weighted(), self.high.weighted())]

        def at(p: float) -> float:
            rank = min(max(math.ceil(p * self.n), 1), self.n)
            values, up = low if 2 * rank <= self.n else high
            rank = rank if 2 * rank <= self.n else self.n - rank + 1
            found = float(values[min(np.searchsorted(up, rank), len(values) - 1)])
            return found if values is low[0] else -found

        return [(at(q), at(q - e), at(q + e), e) for q in qs for e in [self.rank_error(q)]]

    def to_bytes(self, single: bool = False) -> bytes:
        """For storage and shuffles; `single`: the values are of single precision, and so are stored."""
        kind = np.float32 if single else np.float64
        head = struct.pack("<BHQB", 1 if single else 0, self.k, self.n, 0 if self.few is not None else 1)
        if self.few is not None:
            return head + (np.concatenate(self.few) if self.few else np.zeros(0)).astype(kind).tobytes()
        parts = [head]
        for side in (self.low, self.high):
            parts.append(struct.pack("<QB", side.n, len(side.levels)))
            parts.append(struct.pack(f"<{2 * len(side.levels)}Q", *side.widths, *side.counters))
            parts += [np.concatenate(p).astype(kind).tobytes() for p in side.levels if p]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        single, k, n, tall = struct.unpack_from("<BHQB", data)
        kind, at = np.dtype(np.float32 if single else np.float64), struct.calcsize("<BHQB")
        out = cls(k)
        out.n = n
        if not tall:
            values = np.frombuffer(data, kind, offset=at).astype(np.float64)
            out.few = [values] if len(values) else []
            return out
        out.few = None
        for name in ("low", "high"):
            side = Compactors(k)
            side.n, height = struct.unpack_from("<QB", data, at)
            at += struct.calcsize("<QB")
            numbers = struct.unpack_from(f"<{2 * height}Q", data, at)
            at += 16 * height
            side.widths, side.counters, side.levels = list(numbers[:height]), list(numbers[height:]), []
            for width in side.widths:
                side.levels.append([np.frombuffer(data, kind, width, at).astype(np.float64)] if width else [])
                at += width * kind.itemsize
            setattr(out, name, side)
        return out


def sketch_groups(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = SECTION, dedupe: bool = True, held: int = 500_000, fan_in: int = 64) -> DataFrame:
    """A summary per group and column: the keys, `column_name`, `n` bigint and `sketch` binary.

    Null and NaN aren't counted, infinities are. A null key is a group of its own; without keys all rows are one
    group. With `dedupe`, rows equal in every column of `df` count once. A group without usable value has no row; an
    empty table gives no rows.

    Each task summarises what it reads, `held` rows at a time, so a group of any size leaves a task as a few
    thousand numbers; summaries are merged by group, in two steps where there are more than `fan_in` tasks. They are
    merged in an order of their own, not that of their arrival, so the same summaries give the same result again.
    """
    keys, columns = list(keys), list(columns)
    rows = df.dropDuplicates() if dedupe else df
    names = [f"__k{i}" for i in range(len(keys))]
    single = [dict(df.dtypes)[c] == "float" for c in columns]
    rows = rows.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keys, names)], *[F.col(quoted(c)).cast("float" if s else "double").alias(f"__v{i}") for i, (c, s) in enumerate(zip(columns, single))])
    ddl = ", ".join(filter(None, [struct_text(rows, names), "__salt int, column_name string, n bigint, sketch binary"]))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() // fan_in
        part, count = [], 0
        for batch in batches:
            if batch.num_rows:
                part.append(batch)
                count += batch.num_rows
            if count >= held:
                yield from _summaries(pa.Table.from_batches(part).combine_chunks(), names, columns, single, k, salt)
                part, count = [], 0
        if part:
            yield from _summaries(pa.Table.from_batches(part).combine_chunks(), names, columns, single, k, salt)

    partial = rows.mapInArrow(summarise, ddl)
    salted = _merged(partial, [*names, "__salt"]) if df.sparkSession.sparkContext.defaultParallelism > fan_in else partial
    merged = _merged(salted.drop("__salt"), names)
    return merged.select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "column_name", "n", "sketch")


def _summaries(table: pa.Table, names: list[str], columns: list[str], single: list[bool], k: int, salt: int) -> Iterator[pa.RecordBatch]:
    group = np.zeros(table.num_rows, np.int64)
    for n in names:
        code = codes(table.column(n)).astype(np.int64)
        _, group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)
    heads: list[np.ndarray] = []
    out: tuple[list, list, list] = ([], [], [])
    for i, column in enumerate(columns):
        values = table.column(f"__v{i}").cast(pa.float64()).to_numpy()
        good = np.flatnonzero(~np.isnan(values))
        order = good[np.lexsort((values[good], group[good]))]
        if not len(order):
            continue
        v, g = values[order], group[order]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        heads.append(order[start])
        kind = np.float32 if single[i] else np.float64
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(v)]):
            out[0].append(column)
            out[1].append(b - a)
            if b - a <= 6 * k:
                out[2].append(struct.pack("<BHQB", 1 if single[i] else 0, k, b - a, 0) + v[a:b].astype(kind).tobytes())
            else:
                sketch = Sketch(k)
                sketch.add(v[a:b])
                out[2].append(sketch.to_bytes(single[i]))
    if heads:
        at = pa.array(np.concatenate(heads))
        taken = [table.column(n).take(at) for n in names]
        taken = [pa.concat_arrays(t.chunks) for t in taken]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(np.full(len(at), salt, np.int32)), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=[*names, "__salt", "column_name", "n", "sketch"])


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of days, files or finer groups combined to those of `keys` (some of the columns, or none)."""
    names = [f"__k{i}" for i in range(len(keys))]
    renamed = sketches.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keys, names)], "column_name", "n", "sketch")
    return _merged(renamed, names).select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "column_name", "n", "sketch")


def _merged(sketches: DataFrame, names: list[str]) -> DataFrame:
    by = [*names, "column_name"]
    ddl = ", ".join([struct_text(sketches, by), "n bigint, sketch binary"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One summary is open at a time, however many a group has.
        key, held, single, count, types = None, None, False, 0, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[0][i] for r in out], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=[*by, "n", "sketch"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(c).type for c in by]
            table = pa.Table.from_batches([batch])
            starts = group_starts(table, by).tolist()
            blobs = batch.column("sketch")
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                own = tuple(batch.column(c)[a].as_py() for c in by)
                if own != key:
                    if key is not None:
                        out.append((key, *_closed(held, single, count)))
                    key, held, count = own, [], 0
                    if len(out) >= 500:
                        yield flush()
                        out = []
                single = bool(blobs[a].as_py()[0])
                for blob in blobs.slice(a, b - a).to_pylist():
                    held.append(blob)
                    if len(held) >= 64:
                        held = [_closed(held, single, 0)[1]]
        if key is not None:
            out.append((key, *_closed(held, single, count)))
            yield flush()

    return sketches.select(*by, "n", "sketch").repartition(*by).sortWithinPartitions(*by, "n", F.xxhash64("sketch")).mapInArrow(merge, ddl)


def _closed(blobs: list[bytes], single: bool, _: int) -> tuple[int, bytes]:
    if len(blobs) == 1:
        return struct.unpack_from("<BHQB", blobs[0])[2], blobs[0]
    whole = Sketch.from_bytes(blobs[0])
    for blob in blobs[1:]:
        whole.merge(Sketch.from_bytes(blob))
    return whole.n, whole.to_bytes(single)


def percentiles(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """A row per summary and q: the keys, `column_name`, `n`, `percentile`, `value`, `lower`, `upper`, `rank_error`.

    `value` is at rank ceil(q n), up to `rank_error` x n ranks off (three standard deviations; 0 where it is exact);
    `lower` and `upper` are the values at the ends of that range. The error is proportional to the distance from the
    nearer end, so extreme percentiles are the most accurate.
    """
    qs = [float(q) for q in qs]
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("percentiles lie between 0 and 1")
    names = [f"__k{i}" for i in range(len(keys))]
    rows = sketches.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keys, names)], "column_name", "n", "sketch")
    ddl = ", ".join([struct_text(rows, [*names, "column_name", "n"]), "percentile double, value double, lower double, upper double, rank_error double"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.array([x for blob in batch.column("sketch").to_pylist() for x in Sketch.from_bytes(blob).quantiles(qs)], float).reshape(-1, 4)
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(qs)))
            columns = [batch.column(c).take(at) for c in [*names, "column_name", "n"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(qs, batch.num_rows)), *(pa.array(found[:, j].copy()) for j in range(4))], names=[*names, "column_name", "n", "percentile", "value", "lower", "upper", "rank_error"])

    return rows.mapInArrow(read, ddl).select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "column_name", "n", "percentile", "value", "lower", "upper", "rank_error")
