"""Points to segments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.compression.segments import Segment, compress, pack_times
from tidemill.plans import scan
from tidemill.runtime import arrow_schema, complete_groups, epoch_day, float32, group_starts, int64, quoted
from tidemill.types import ErrorBound, TimeSeriesTable

#: Points of a chunk at most: all fields of a chunk are compressed and put together again as one.
CHUNK_POINTS = 65_536


def to_segments(points: DataFrame, table: TimeSeriesTable) -> DataFrame:
    """The table's segments of `points` (the columns of table.schema).

    Points are put in ranges of (block of scan.BLOCK_DAYS, series): a large series is spread over its blocks, and the files
    that are written hold few blocks each, so that a query over a stretch of time opens few of them. Within a block the
    points are in order of time, and every CHUNK_POINTS of a series are a chunk; no more than that is held at once.
    Late points make chunks of their own, whose times may overlap those of others. Repeated points are kept.
    """
    tags, time = table.tags, table.timestamp
    keys = ["__block", *tags]
    block = F.floor(epoch_day(F.col(quoted(time))) / scan.BLOCK_DAYS)
    order = [F.col(quoted(k)) for k in keys]
    placed = points.withColumn("__block", block).repartitionByRange(*order).sortWithinPartitions(*order, quoted(time))
    schema = table.segment_schema
    empty = points.sparkSession.createDataFrame([], schema)
    fields = arrow_schema(empty, schema.fieldNames())
    numbers = [(f.name, table.index(f.name), f.bound) for f in table.fields]
    load = uuid.uuid4().int & ((1 << 62) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made: list[dict] = []
        count = 0
        for serial, piece in enumerate(chunks(batches, keys)):
            # The number of the load, task and chunk, mixed to one: no two chunks of a table have the same.
            chunk = _chunk_id(load, part, serial)
            names = tuple(piece.column(t)[0].as_py() for t in tags)
            t = int64(piece.column(time))
            for name, number, bound in numbers:
                v = float32(piece.column(name))
                found = compress(t, v, bound)
                made.append(_rows(found, t, chunk, names, number))
                count += len(found)
            if count > 20_000:
                yield _joined(made, fields)
                made, count = [], 0
        if made:
            yield _joined(made, fields)

    return placed.mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Of a partition sorted by `keys`: tables of rows equal in them, at most CHUNK_POINTS each."""
    held: list[pa.Table] = []
    count = 0
    last = None

    def full() -> pa.Table:
        nonlocal held, count
        table = pa.concat_tables(held).combine_chunks()
        held, count = [], 0
        return table

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        starts = group_starts(table, keys).tolist()
        for a, b in zip(starts, [*starts[1:], table.num_rows]):
            key = tuple(table.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield full()
            last = key
            while a < b:
                take = min(b - a, CHUNK_POINTS - count)
                held.append(table.slice(a, take))
                count += take
                a += take
                if count == CHUNK_POINTS:
                    yield full()
    if held:
        yield full()


def _chunk_id(load: int, part: int, serial: int) -> int:
    x = (load ^ (part << 32) ^ serial) & 0xFFFFFFFFFFFFFFFF
    # An odd factor and shifts are one to one, so different inputs stay different within a load.
    x = (x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


def cut(segments: DataFrame, table: TimeSeriesTable, start: datetime | int | None, end: datetime | int | None) -> DataFrame:
    """Of each chunk the points that lie in segments from start to end for every field, as a chunk of its own.

    Segments of these points alone stay as they are. What is left of others is decoded and compressed without loss, so
    values within a bound don't move any further. A chunk without such points gives no segments.
    """
    schema = table.segment_schema
    names = schema.fieldNames()
    fields = arrow_schema(segments.sparkSession.createDataFrame([], schema), names)
    low = scan.micros(start) if start is not None else None
    high = scan.micros(end) if end is not None else None
    numbers = [table.index(f.name) for f in table.fields]
    load = uuid.uuid4().int & ((1 << 62) - 1)
    keys = ["chunk", *table.tags]

    def piece(chunk: list[dict]) -> Iterator[dict]:
        first, last = 0, CHUNK_POINTS
        for number in numbers:
            inside = [r for r in chunk if r["field_column"] == number and (low is None or r["start_us"] >= low) and (high is None or r["end_us"] <= high)]
            first = max([first, min((r["first_point"] for r in inside), default=last)])
            last = min([last, max((r["first_point"] + r["n_points"] for r in inside), default=first)])
        for r in chunk:
            a, b = max(first, r["first_point"]), min(last, r["first_point"] + r["n_points"])
            if a >= b:
                continue
            # Different chunks stay different, and the load keeps them off those copied before.
            own = _chunk_id(load, 0, r["chunk"])
            if b - a == r["n_points"]:
                yield {n: [r[n]] for n in names} | {"chunk": [own], "first_point": [a - first], "size": 1}
                continue
            t, v = scan._decode([r])
            t, v = t[a - r["first_point"] : b - r["first_point"]], v[a - r["first_point"] : b - r["first_point"]]
            yield _rows(compress(t, v, ErrorBound()), t, own, tuple(r[k] for k in table.tags), r["field_column"], a - first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in complete_groups(batches, keys, 5_000):
            found = whole.select(names).to_pylist()
            starts = group_starts(whole, keys).tolist()
            rows = [row for a, b in zip(starts, [*starts[1:], len(found)]) for row in piece(found[a:b])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.column(i) for x in (_joined([r], fields) for r in rows)]) for i in range(len(fields))], names=names)

    order = [quoted(k) for k in keys]
    return segments.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _rows(found: list[Segment], t: np.ndarray, chunk: int, tags: tuple, field: int, shift: int = 0) -> dict:
    """Columns of segments of one chunk and field; one value stands for all of them where they have the same."""
    first = np.array([s.first for s in found], np.int64)
    count = np.array([s.n_points for s in found], np.int64)
    v = np.concatenate([s.values for s in found]).astype(np.float64) if found else np.zeros(0)
    begin = np.cumsum(count) - count
    packed = [pack_times(t[a : a + n]) for a, n in zip(first.tolist(), count.tolist())]
    with np.errstate(invalid="ignore"):
        # Like Spark: NaN is above all other values.
        low = np.fmin.reduceat(v, begin) if found else v
        high = np.maximum.reduceat(v, begin) if found else v
        total = np.add.reduceat(v, begin) if found else v
    return {
        "model_type": [s.model_type for s in found],
        "start_us": t[first],
        "end_us": t[first + count - 1],
        "n_points": count,
        "model_points": [s.model_points for s in found],
        "interval_us": [step for step, _ in packed],
        "times": [data for _, data in packed],
        "min_value": low,
        "max_value": high,
        "sum_value": total,
        "first_value": np.array([s.first_value for s in found], np.float64),
        "last_value": np.array([s.last_value for s in found], np.float64),
        "residuals": [s.residuals or None for s in found],
        "chunk": chunk,
        "first_point": first + shift,
        **{f"tag {i}": x for i, x in enumerate(tags)},
        "field_column": field,
        "size": len(found),
    }


def _joined(parts: list[dict], fields: list[pa.Field]) -> pa.RecordBatch:
    """Columns of several chunks as one batch."""
    arrays = []
    keys = [k for k in parts[0] if k != "size"]
    for key, f in zip(keys, fields):
        pieces = []
        for p in parts:
            x = p[key]
            if isinstance(x, np.ndarray):
                x = pa.array(x).cast(f.type, safe=False)
            elif isinstance(x, list):
                x = pa.array(x, f.type)
            else:
                x = pa.repeat(pa.scalar(x, f.type), p["size"])
            pieces.append(x)
        arrays.append(pa.concat_arrays(pieces))
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
