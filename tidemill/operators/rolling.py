"""Totals over trailing periods, one row per entity, calendar day and period length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.runtime import complete_groups, epoch_day, float64, group_starts, int64, quoted, struct_text, usable


@dataclass(frozen=True)
class Monoid:
    """An associative operation with an identity; it needs no inverse."""

    combine: np.ufunc
    identity: float


SUM = Monoid(np.add, 0.0)
LOWEST = Monoid(np.minimum, np.inf)
HIGHEST = Monoid(np.maximum, -np.inf)


class TwoStackQueue:
    """A queue that knows the combination of all it holds, in amortised constant time and without an inverse.

    `push` adds at the back, `pop` removes at the front, `value` combines front to back.
    """

    def __init__(self, combine: Callable[[Any, Any], Any], identity: Any) -> None:
        self._combine, self._identity = combine, identity
        self._front: list[Any] = []
        self._back: list[Any] = []
        self._back_value = identity

    def __len__(self) -> int:
        return len(self._front) + len(self._back)

    def push(self, item: Any) -> None:
        self._back.append(item)
        self._back_value = self._combine(self._back_value, item)

    def pop(self) -> None:
        if not self._front:
            total = self._identity
            while self._back:
                total = self._combine(self._back.pop(), total)
                self._front.append(total)
            self._back_value = self._identity
        self._front.pop()

    def value(self) -> Any:
        return self._combine(self._front[-1] if self._front else self._identity, self._back_value)


def trailing(values: np.ndarray, width: int, monoid: Monoid) -> np.ndarray:
    """For each i the combination of values[i - width + 1 .. i]; positions before 0 count as the identity.

    This is the two-stack queue for a whole array at once. The queue turns its back stack over every `width` items:
    the front stack then is the suffix combinations of the block before, the back stack the prefix combinations of
    the current one, and a window is one of each.
    """
    n = len(values)
    blocks = -(-n // width) if n else 0
    padded = np.full(blocks * width, monoid.identity)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    with np.errstate(invalid="ignore"):
        back = monoid.combine.accumulate(grid, axis=1).ravel()
        front = monoid.combine.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        out = back.copy()
        at = np.arange(width, n)
        at = at[(at + 1) % width != 0]
        out[at] = monoid.combine(front[at - width + 1], back[at])
    return out[:n]


def daily_totals(df: DataFrame, keys: Sequence[str], ts: str, fields: Sequence[str], dedupe: bool = True) -> DataFrame:
    """One row per entity and day that has a row: per field the count, sum, lowest and highest of its usable values.

    Rows are shuffled once, by entity and day: equal rows have the same, so they meet there, and the aggregation needs
    no further shuffle. An entity with a third of all rows is spread over its days. Without `dedupe` the counts are
    combined in the mappers before the shuffle.
    """
    rows = df.where(F.col(quoted(ts)).isNotNull()).withColumn("__day", epoch_day(F.col(quoted(ts))))
    names = [quoted(k) for k in keys]
    if dedupe:
        rows = rows.repartition(*[F.col(n) for n in names], F.col("__day")).dropDuplicates()
    aggregates = []
    for i, field in enumerate(fields):
        value = F.col(quoted(field)).cast("double")
        value = F.when(usable(value), value)
        aggregates += [F.count(value).alias(f"__n{i}"), F.sum(value).alias(f"__s{i}"), F.min(value).alias(f"__l{i}"), F.max(value).alias(f"__h{i}")]
    return rows.groupBy(*names, "__day").agg(*aggregates)


def rolling_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    fields: Sequence[str],
    windows: Sequence[int] = (7, 30),
    dedupe: bool = True,
) -> DataFrame:
    """Totals and averages per entity over the `windows` days that end on each day.

    A row for each entity, each day from its first to its last day with a usable reading, and each window, days
    without readings included: `day` date, `window_days` int, `active_days` int (days of the window with a usable
    reading of any field), then for each field `<field>_count`, `<field>_total`, `<field>_average`, `<field>_lowest`
    and `<field>_highest`. A window without usable values has count 0 and null for the rest.

    Nulls and NaN are no readings; infinities are (the total of both infinities is NaN). A null key is an entity of
    its own. Rows without timestamp are ignored. With `dedupe`, rows equal in every column count once. An empty
    table, or one without usable reading, gives no rows. Columns other than those named may have any name; names
    starting with two underscores are kept free.

    Plan: one shuffle of the rows by entity and day, one of the (entity, day) aggregates by entity, then the monoid
    queue over each sorted partition. An entity's part there is bounded by its days, whatever its number of rows, and
    comes out in pieces: a wrong date far off makes many rows, but never many at once.
    """
    keys, fields, windows = list(keys), list(fields), [int(w) for w in windows]
    if not fields or any(w < 1 for w in windows):
        raise ValueError("rolling_totals needs at least one field and windows of at least one day")
    daily = daily_totals(df, keys, ts, fields, dedupe)
    daily = daily.where(" + ".join(f"__n{i}" for i in range(len(fields))) + " > 0")
    names = [quoted(k) for k in keys]
    placed = daily.repartition(*names) if names else daily.repartition(1)
    placed = placed.sortWithinPartitions(*names, "__day")
    parts = []
    for field in fields:
        parts += [f"{quoted(field + '_count')} bigint", *(f"{quoted(field + '_' + x)} double" for x in ("total", "average", "lowest", "highest"))]
    key_schema = struct_text(df, keys)
    schema = ", ".join(filter(None, [key_schema, "`day` date, `window_days` int, `active_days` int", *parts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, keys, 100_000):
            yield from _roll(table, keys, fields, windows)

    return placed.mapInArrow(run, schema)


#: Days of an entity, and rows of a batch, that are worked on at once.
PIECE_DAYS, PIECE_ROWS = 100_000, 250_000


def _spans(day: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Stretches of at most PIECE_DAYS: their entity, first and last day, and the rows that windows in them reach."""
    first, last = day[starts], day[ends - 1]
    number = (last - first) // PIECE_DAYS + 1
    entity = np.repeat(np.arange(len(starts)), number)
    place = np.arange(len(entity)) - np.repeat(np.cumsum(number) - number, number)
    low = first[entity] + place * PIECE_DAYS
    high = np.minimum(low + PIECE_DAYS - 1, last[entity])
    a, b = starts[entity].copy(), ends[entity].copy()
    for k in np.flatnonzero(number[entity] > 1).tolist():
        own = day[starts[entity[k]] : ends[entity[k]]]
        a[k] = starts[entity[k]] + np.searchsorted(own, low[k] - window + 1)
        b[k] = starts[entity[k]] + np.searchsorted(own, high[k], side="right")
    return entity, low, high, a, b


def _roll(table: pa.Table, keys: list[str], fields: list[str], windows: list[int]) -> Iterator[pa.RecordBatch]:
    starts = group_starts(table, keys)
    ends = np.append(starts[1:], table.num_rows)
    day = int64(table.column("__day"))
    parts = [tuple(float64(table.column(f"__{x}{i}")) for x in "nslh") for i in range(len(fields))]
    for window in windows:
        entity, low, high, a, b = _spans(day, starts, ends, window)
        rows = np.cumsum(high - low + window)
        cuts = np.unique(np.searchsorted(rows, np.arange(PIECE_ROWS, int(rows[-1]) + PIECE_ROWS, PIECE_ROWS), side="left") + 1)
        for x, y in zip([0, *cuts.tolist()], cuts.tolist()):
            if x < len(entity):
                some = slice(x, y)
                yield _window(table, keys, fields, window, starts[entity[some]], low[some], high[some], a[some], b[some], day, parts)


def _window(table: pa.Table, keys: list[str], fields: list[str], window: int, owner: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, day: np.ndarray, parts: list) -> pa.RecordBatch:
    """The rows of some stretches, each from its first to its last day; `owner` is a row of each one's entity."""
    length = high - low + 1
    # Every stretch has window - 1 places before it, for the days that its first windows reach back to.
    offset = np.cumsum(length + window - 1) - length
    size = int(offset[-1] + length[-1])
    count = b - a
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
    at = np.repeat(offset - low, count) + day[rows]
    here = np.repeat(offset - np.cumsum(length) + length, length) + np.arange(int(length.sum()))

    def over(values: np.ndarray, monoid: Monoid) -> np.ndarray:
        dense = np.full(size, monoid.identity)
        dense[at] = np.where(np.isnan(values) & (monoid is not SUM), monoid.identity, values)
        return trailing(dense, window, monoid)[here]

    take = pa.array(np.repeat(owner, length))
    columns: list[Any] = [table.column(k).take(take).combine_chunks() for k in keys]
    columns.append(pa.array((np.repeat(low - (np.cumsum(length) - length), length) + np.arange(len(here))).astype(np.int32)).cast(pa.date32()))
    columns.append(pa.array(np.full(len(here), window, np.int32)))
    columns.append(pa.array(over(np.ones(len(rows)), SUM).astype(np.int32)))
    names = [*keys, "day", "window_days", "active_days"]
    for field, (number, total, lowest, highest) in zip(fields, parts):
        n = over(number[rows], SUM).astype(np.int64)
        none = n == 0
        whole = over(np.where(number > 0, total, 0.0)[rows], SUM)
        columns += [
            pa.array(n),
            pa.array(whole, mask=none),
            pa.array(np.divide(whole, n, out=np.zeros_like(whole), where=~none), mask=none),
            pa.array(over(lowest[rows], LOWEST), mask=none),
            pa.array(over(highest[rows], HIGHEST), mask=none),
        ]
        names += [f"{field}_{x}" for x in ("count", "total", "average", "lowest", "highest")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns], names=names)
