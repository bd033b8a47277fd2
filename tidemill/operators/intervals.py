"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import attach, durable, group_starts, int64, quoted, struct_text

DAY_US = 86_400_000_000


class IntervalMap:
    """Disjoint closed intervals in order. Intervals at most `tolerance` apart are one.

    An insertion finds its overlaps by binary search, replaces them by their union and so updates the gaps, which
    are what lies between neighbours. Insertions commute, hence order and repetition don't matter, and two maps can
    be merged by inserting one into the other.
    """

    __slots__ = ("ends", "starts", "tolerance")

    def __init__(self, tolerance: int = 0) -> None:
        self.tolerance = tolerance
        self.starts: list[int] = []
        self.ends: list[int] = []

    def __len__(self) -> int:
        return len(self.starts)

    def insert(self, start: int, end: int) -> None:
        starts, ends = self.starts, self.ends
        if not starts or start > ends[-1] + self.tolerance:
            starts.append(start)
            ends.append(end)
            return
        low = bisect_left(ends, start - self.tolerance)
        high = bisect_right(starts, end + self.tolerance, low)
        if low < high:
            start, end = min(start, starts[low]), max(end, ends[high - 1])
        starts[low:high] = [start]
        ends[low:high] = [end]

    def within(self, start: int, end: int) -> slice:
        """The places of the intervals that one from start to end would be united with."""
        low = bisect_left(self.ends, start - self.tolerance)
        return slice(low, bisect_right(self.starts, end + self.tolerance, low))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


def _micros(table: pa.RecordBatch, name: str) -> np.ndarray:
    return int64(table.column(name))


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    tolerance_us: int = 0,
    block_us: int = DAY_US,
    held: int = 500_000,
) -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    Columns: the keys, `kind` ('period' or 'gap'), `start_us`, `end_us` bigint (microseconds since 1970-01-01).
    Intervals of an entity belong to one period if they overlap or at most `tolerance_us` lies between them, also by
    way of further intervals; both ends are included. Rows with a null bound or with the end before the start are
    ignored; rows may repeat and come in any order. A null key is an entity of its own. An empty table gives no rows.
    Other columns may have any name.

    Plan: each mapper keeps an ordered interval map per entity and so merges what it has before the shuffle (at most
    `held` intervals, then it passes them on). The merged pieces are shuffled by (entity, block of `block_us` of
    their start) and go through the map of that block; an entity with a third of all rows is spread over its blocks.
    What earlier blocks reach is one running maximum over a row per block, not over the intervals.
    """
    keys = list(keys)
    tolerance = int(tolerance_us)
    if tolerance < 0 or block_us < 1:
        raise ValueError("merge_intervals needs tolerance_us >= 0 and block_us >= 1")
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.col(quoted(start)).alias("__start"), F.col(quoted(end)).alias("__end"))
    rows = rows.where("__start IS NOT NULL AND __end IS NOT NULL AND __start <= __end")
    key_ddl = struct_text(rows, names)
    piece = ", ".join(filter(None, [key_ddl, "__block bigint, __s bigint, __e bigint"]))

    def emit(maps: dict, types: list[pa.DataType]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(len(names) + 2)]
        for key, found in maps.items():
            for i, part in enumerate(key):
                columns[i] += [part] * len(found)
            columns[-2] += found.starts
            columns[-1] += found.ends
        s = np.array(columns[-2], np.int64)
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(s // block_us), pa.array(s), pa.array(columns[-1], pa.int64())], names=[*names, "__block", "__s", "__e"])

    def premerge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple, IntervalMap] = {}
        count, types = 0, []
        for batch in batches:
            types = [batch.column(n).type for n in names]
            columns = [batch.column(n).to_pylist() for n in names]
            for key, s, e in zip(zip(*columns) if names else [()] * batch.num_rows, _micros(batch, "__start").tolist(), _micros(batch, "__end").tolist()):
                found = maps.get(key)
                if found is None:
                    found = maps[key] = IntervalMap(tolerance)
                count -= len(found)
                found.insert(s, e)
                count += len(found)
            if count > held:
                yield emit(maps, types)
                maps, count = {}, 0
        if maps:
            yield emit(maps, types)

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are sorted by key, block and start: one map at a time, passed on when its group ends.
        key, found, types = None, IntervalMap(tolerance), []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(n).type for n in names]
            first = group_starts(pa.Table.from_batches([batch]), [*names, "__block"])
            last = np.append(first[1:], batch.num_rows)
            s, e, block = (_micros(batch, n) for n in ("__s", "__e", "__block"))
            done: dict[tuple, IntervalMap] = {}
            for a, b in zip(first.tolist(), last.tolist()):
                own = (*(batch.column(n)[a].as_py() for n in names), int(block[a]))
                if own != key:
                    if key is not None:
                        done[key] = found
                    key, found = own, IntervalMap(tolerance)
                for x, y in zip(s[a:b].tolist(), e[a:b].tolist()):
                    found.insert(x, y)
            if done:
                yield _of_blocks(done, names, types)
        if key is not None:
            yield _of_blocks({key: found}, names, types)

    pieces = rows.mapInArrow(premerge, piece).repartition(*names, "__block").sortWithinPartitions(*names, "__block", "__s")
    local = durable(pieces.mapInArrow(by_block, piece))

    # The furthest end in earlier blocks decides which local periods only continue an earlier one.
    blocks = local.groupBy(*names, "__block").agg(F.max("__e").alias("__far"))
    in_order = Window.partitionBy(*names).orderBy("__block")
    reach = F.max("__far").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select(*names, "__block", reach.alias("__carry"))
    joined = attach(local, carried, [*names, "__block"])

    within = Window.partitionBy(*names, "__block").orderBy("__s")
    before = F.greatest(F.col("__carry"), F.max("__e").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    marked = joined.withColumn("__before", before).withColumn("__new", F.col("__before").isNull() | (F.col("__s") > F.col("__before") + F.lit(tolerance)))
    # A new period ends where the reach just before the next new one ends: within the block, or in a later block.
    ahead = within.rowsBetween(1, Window.unboundedFollowing)
    marked = marked.withColumn("__next", F.first(F.when(F.col("__new"), F.col("__before")), ignorenulls=True).over(ahead))
    summary = marked.groupBy(*names, "__block").agg(
        F.min(F.when(F.col("__new"), F.struct("__s", "__before"))).getField("__before").alias("__first"),
        F.max(F.greatest("__e", "__before")).alias("__reach"),
    )
    later = in_order.rowsBetween(1, Window.unboundedFollowing)
    closing = summary.select(
        *names,
        "__block",
        F.coalesce(F.first("__first", ignorenulls=True).over(later), F.max("__reach").over(in_order.rowsBetween(0, Window.unboundedFollowing))).alias("__close"),
    )
    final = attach(marked.where("__new"), closing, [*names, "__block"])
    shape = "array<struct<kind:string,start_us:bigint,end_us:bigint>>"
    cases = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("__s").alias("start_us"), F.coalesce("__next", "__close").alias("end_us")),
        F.struct(F.lit("gap").alias("kind"), F.col("__before").alias("start_us"), F.col("__s").alias("end_us")),
    ).cast(shape)
    out = final.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.inline(cases))
    return out.where("start_us IS NOT NULL")


def _of_blocks(done: dict[tuple, IntervalMap], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(len(names) + 3)]
    for key, found in done.items():
        for i, part in enumerate(key):
            columns[i] += [part] * len(found)
        columns[-2] += found.starts
        columns[-1] += found.ends
    kinds = [*types, pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*names, "__block", "__s", "__e"])
