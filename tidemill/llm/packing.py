"""Items of varying size into containers of fixed capacity, little space left over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.runtime import durable, quoted

_BIN = "container bigint, used int, done boolean, pieces array<struct<id:bigint,piece:int,pieces:int,first:bigint,size:int>>"


class BestFit:
    """Open containers by the space left in them. `put` takes the fullest one that has room.

    The sizes of the spaces in use are the bits of one integer, so the best fit is found without a search.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.left: list[int] = []
        self.members: list[list] = []
        self._by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._sizes = 0

    def put(self, size: int, member: object) -> None:
        fitting = self._sizes >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            place = self._by_left[space].pop()
            if not self._by_left[space]:
                self._sizes &= ~(1 << space)
            self.members[place].append(member)
        else:
            space, place = self.capacity, len(self.left)
            self.left.append(0)
            self.members.append([member])
        rest = space - size
        self.left[place] = rest
        if rest:
            self._by_left[rest].append(place)
            self._sizes |= 1 << rest


def pack_containers(df: DataFrame, key: str, size: Column, capacity: int, slack: float = 0.005, held: int = 200_000, rounds: int = 8) -> DataFrame:
    """Which items go into which container: one row per piece of an item.

    Columns: `container` bigint, the key, `piece` int (from 0), `pieces` int (of the item), `first` bigint (where in
    the item the piece starts) and `size` int. Only items larger than `capacity` are split: into pieces of the full
    capacity and a rest that is packed like an item. Items of size 0, or whose size is null or negative, need no
    space and are in no container; a null key is an item like others. The key is a whole number; a repeated key is
    packed as often as it occurs. An empty table gives no rows.

    Method: every partition packs its items by best fit, largest first. Containers with less than `slack` of their
    capacity left, or less than the smallest item needs, are emitted. The others are merged as items of their own in
    a tree: each round brings eight partitions' underfull containers together (at most `held` in one task) and packs
    them by best fit again, until one task holds them all, or a round among tasks of the full size gains less than
    one in a thousand. All tasks sort what they hold, so a task that runs again gives the same containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = durable(df.select(F.col(quoted(key)).cast("bigint").alias("id"), size.cast("bigint").alias("size")).where("size > 0"))
    start = items.agg(F.min("size").alias("least"), F.count("*").alias("n")).first()
    if not start["n"]:
        return items.sparkSession.createDataFrame([], f"container bigint, {quoted(key)} bigint, piece int, pieces int, first bigint, size int")
    enough = max(int(capacity * slack), min(start["least"], capacity) - 1)

    def emit(fit: BestFit, tag: int) -> Iterator[pa.RecordBatch]:
        base = (tag << 48) | (TaskContext.get().partitionId() << 28)
        for a in range(0, len(fit.left), 2_000):
            left = fit.left[a : a + 2_000]
            pieces = [[x for m in ms for x in m] for ms in fit.members[a : a + 2_000]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(a, a + len(left), dtype=np.int64) + base),
                    pa.array([capacity - x for x in left], pa.int32()),
                    pa.array([x <= enough for x in left]),
                    pa.array(pieces, pa.list_(pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("first", pa.int64()), ("size", pa.int32())]))),
                ],
                names=["container", "used", "done", "pieces"],
            )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, rests, count = BestFit(capacity), [], 0
        serial = 0
        for batch in batches:
            for id_, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole, rest = divmod(n, capacity)
                total = whole + (rest > 0)
                for k in range(whole):
                    fit.put(capacity, [(id_, k, total, k * capacity, capacity)])
                if rest:
                    rests.append((-rest, id_ is None, id_ or 0, id_, whole, total, whole * capacity))
            if len(rests) + len(fit.left) >= held:
                yield from _packed(fit, rests, lambda f, s=serial: emit(f, s))
                fit, rests, serial = BestFit(capacity), [], serial + 1
        yield from _packed(fit, rests, lambda f: emit(f, serial))

    def _packed(fit: BestFit, rests: list, out) -> Iterator[pa.RecordBatch]:
        for minus, _, _, id_, k, total, first in sorted(rests, key=lambda x: x[:3]):
            fit.put(-minus, [(id_, k, total, first, -minus)])
        yield from out(fit)

    def merge(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = []
            for batch in batches:
                rows += zip(batch.column("used").to_pylist(), batch.column("container").to_pylist(), batch.column("pieces").to_pylist())
            rows.sort(key=lambda x: (-x[0], x[1]))
            fit = BestFit(capacity)
            for used, _, pieces in rows:
                fit.put(used, [(p["id"], p["piece"], p["pieces"], p["first"], p["size"]) for p in pieces])
            yield from emit(fit, turn << 8)

        return run

    packed = durable(items.mapInArrow(local, _BIN))
    done, open_, tasks = [packed.where("done")], packed.where("NOT done"), items.rdd.getNumPartitions()
    count = open_.count()
    for turn in range(1, rounds + 1):
        if not count:
            break
        least = -(-count // held)
        tasks = max(least, -(-tasks // 8))
        merged = durable(open_.repartition(tasks, F.xxhash64("container", F.lit(turn))).mapInArrow(merge(turn), _BIN))
        before, count = count, merged.count()
        if tasks == 1 or (tasks == least and count > 0.999 * before):
            done.append(merged)
            count = 0
            break
        done.append(merged.where("done"))
        open_, count = merged.where("NOT done"), merged.where("NOT done").count()
    if count:
        done.append(open_)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("container", F.inline("pieces")).select("container", F.col("id").alias(key), "piece", "pieces", "first", "size")
