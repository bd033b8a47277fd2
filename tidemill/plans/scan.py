"""Segments to points, and aggregates that need no points."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.compression.segments import decompress, unpack_times
from tidemill.errors import InvalidArgument
from tidemill.runtime import quoted
from tidemill.types import TimeSeriesTable

_PARTS = ["model_type", "start_us", "n_points", "model_points", "interval_us", "times", "first_value", "last_value", "residuals"]
Range = tuple[datetime | int | None, datetime | int | None]
Values = tuple[float | None, float | None]
#: Segments as they are, or those of fields, times and values that a table gives.
Source = DataFrame | Callable[[Sequence[int], Range, Values], DataFrame]
#: Days of a block, counted from 1970-01-01; all of a chunk lies in one. Files of tables depend on it.
BLOCK_DAYS = 7


def widened(times: Range) -> Range:
    """The times of all blocks that a range touches: a chunk with a point in the range lies in these."""
    width = BLOCK_DAYS * 86_400_000_000
    start, end = times
    return None if start is None else micros(start) // width * width, None if end is None else (micros(end) // width + 1) * width - 1


def micros_literal(value: datetime | int) -> Column:
    """A time without zone, from a datetime or microseconds since 1970-01-01."""
    if isinstance(value, int):
        value = datetime(1970, 1, 1) + timedelta(microseconds=value)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(value: datetime | int) -> int:
    """Microseconds since 1970-01-01."""
    if isinstance(value, int):
        return value
    since = value - datetime(1970, 1, 1)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def in_time(segments: DataFrame, start: datetime | int | None, end: datetime | int | None) -> DataFrame:
    """Segments that may hold points from start to end, both included; reaches Parquet's row groups."""
    if start is not None:
        segments = segments.where(F.col("end_us") >= micros(start))
    if end is not None:
        segments = segments.where(F.col("start_us") <= micros(end))
    return segments


def _decode(parts: list[dict], times_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    times, values = [], []
    for p in parts:
        t = unpack_times(p["start_us"], p["n_points"], p["interval_us"], p["times"])
        times.append(t)
        if not times_only:
            values.append(decompress(p["model_type"], t, p["model_points"], np.float32(p["first_value"]), np.float32(p["last_value"]), p["residuals"]))
    none = np.zeros(0, np.float32)
    return np.concatenate(times) if times else np.zeros(0, np.int64), np.concatenate(values) if values else none


def _lists(times: list[np.ndarray], values: list[list[np.ndarray]]) -> pa.Array:
    """Per row its points as structs of a time and the values of all fields."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in times])]).astype(np.int32)
    joined = pa.array(np.concatenate(times) if times else np.zeros(0, np.int64)).view(pa.timestamp("us"))
    columns = [pa.array(np.concatenate(v) if v else np.zeros(0, np.float32), pa.float32()) for v in values]
    points = pa.StructArray.from_arrays([joined, *columns], names=["t", *(f"v{i}" for i in range(len(columns)))])
    return pa.ListArray.from_arrays(pa.array(offsets), points)


def points(segments: Source, table: TimeSeriesTable, fields: Sequence[str], time_range: Range = (None, None), value_range: Values = (None, None)) -> DataFrame:
    """The points of some stored fields: the timestamp, the tags and the fields, generated ones not included.

    Without a field, the first stored one is read for its times. One field is decoded segment by segment, without a
    shuffle. Several are put together by chunk: segments, not points, are shuffled, and all of a chunk's fields hold
    the same points, so equal timestamps and late data don't matter. Of one field, segments that have no value in
    `value_range` (ends included, NaN above all others) aren't decoded; the values themselves are not filtered.
    """
    wanted = list(fields) or [table.fields[0].name]
    number = [table.index(f) for f in wanted]
    if not isinstance(segments, DataFrame):
        # Several fields need all of a chunk.
        segments = segments(number, time_range if len(number) == 1 else widened(time_range), value_range if fields and len(number) == 1 else (None, None))
    chosen = segments.where(F.col("field_column").isin(number) if len(number) > 1 else F.col("field_column") == number[0])
    tags = [quoted(t) for t in table.tags]
    time = quoted(table.timestamp)
    names = [time, *(quoted(f) for f in wanted)]
    inner = T.StructType([T.StructField("t", T.TimestampNTZType()), *[T.StructField(f"v{i}", T.FloatType()) for i in range(len(wanted))]])
    if len(wanted) == 1:
        # Without predicates between them, segments in the range are all that is decoded.
        chosen = in_time(chosen, *time_range)
        if fields and value_range[0] is not None:
            chosen = chosen.where(F.col("max_value") >= F.lit(value_range[0]))
        if fields and value_range[1] is not None:
            chosen = chosen.where(F.col("min_value") <= F.lit(value_range[1]))
        only_times = not fields

        @F.arrow_udf(T.ArrayType(inner))
        def unfold(*columns: pa.Array) -> pa.Array:
            parts = [dict(zip(_PARTS, row)) for row in zip(*(c.to_pylist() for c in columns))]
            found = [_decode([p], only_times) for p in parts]
            return _lists([t for t, _ in found], [[v if len(v) else np.zeros(len(t), np.float32) for t, v in found]])

        rows = chosen.select(*tags, F.inline(unfold(*[F.col(p) for p in _PARTS])))
    else:
        # A chunk is needed as a whole, and its segments differ by field: chunks are kept if any segment is in range.
        if time_range != (None, None):
            chosen = in_time(chosen, *widened(time_range))
            near = in_time(chosen.where(F.col("field_column") == number[0]), *time_range).select(F.col("chunk").alias("__chunk")).distinct()
            chosen = chosen.join(near, F.col("chunk") == F.col("__chunk"), "left_semi")
        part = F.struct("field_column", "first_point", *_PARTS)
        grouped = chosen.groupBy(*tags, "chunk").agg(F.collect_list(part).alias("__parts"))

        @F.arrow_udf(T.ArrayType(inner))
        def unfold_all(column: pa.Array) -> pa.Array:
            times: list[np.ndarray] = []
            values: list[list[np.ndarray]] = [[] for _ in number]
            flat = column.flatten()
            columns = {f.name: flat.field(i).to_pylist() for i, f in enumerate(flat.type)}
            sizes = np.diff(column.offsets.to_numpy())
            at = 0
            for size in sizes.tolist():
                rows = [{k: v[i] for k, v in columns.items()} for i in range(at, at + size)]
                at += size
                rows.sort(key=lambda r: (r["field_column"], r["first_point"]))
                for k, field in enumerate(number):
                    t, v = _decode([r for r in rows if r["field_column"] == field])
                    values[k].append(v)
                    if not k:
                        times.append(t)
            return _lists(times, values)

        rows = grouped.select(*tags, F.inline(unfold_all("__parts")))
    rows = rows.withColumnsRenamed({"t": table.timestamp} | {f"v{i}": f for i, f in enumerate(wanted)})
    start, end = time_range
    if start is not None:
        rows = rows.where(F.col(time) >= micros_literal(start))
    if end is not None:
        rows = rows.where(F.col(time) <= micros_literal(end))
    return rows.select(*names, *tags) if fields else rows.select(time, *tags)


def view(spark: SparkSession, segments: Source, table: TimeSeriesTable, columns: Sequence[str] | None = None, time_range: Range = (None, None), value_range: Values = (None, None)) -> DataFrame:
    """The table as it is read: the given columns (None: all) in their order, generated ones computed."""
    wanted = [c.name for c in table.columns] if columns is None else list(columns)
    known = {c.name: c for c in table.columns}
    generated = [known[c] for c in wanted if c in known and known[c].expression is not None]
    stored = [f.name for f in table.fields]
    needed = {c for c in wanted if c in stored}
    for g in generated:
        needed |= set(sources(spark, table, g.expression))
    rows = points(segments, table, [f for f in stored if f in needed], time_range, value_range)
    for g in generated:
        rows = rows.withColumn(g.name, F.expr(g.expression).cast("float"))
    return rows.select(*[quoted(c) for c in wanted])


def sources(spark: SparkSession, table: TimeSeriesTable, expression: str) -> list[str]:
    """The stored fields that an expression uses."""
    empty = spark.createDataFrame([], table.schema)
    try:
        analysed = empty.select(F.expr(expression).cast("float").alias("x"))
        used = {a.name() for a in _references(analysed)}
    except Exception as error:
        raise InvalidArgument(f"The expression '{expression}' isn't a scalar expression over stored columns: {str(error).splitlines()[0]}") from None
    return [f.name for f in table.fields if f.name in used]


def _references(df: DataFrame) -> list:
    plan = df._jdf.queryExecution().analyzed()
    # Aggregates, windows and generators add nodes of their own to the plan.
    flat = plan.nodeName() == "Project" and plan.children().apply(0).children().size() == 0
    if not flat or plan.subqueries().size():
        raise ValueError("only scalar functions can be used")
    found, it = [], plan.references().iterator()
    while it.hasNext():
        found.append(it.next())
    return found


AGGREGATES = ("count", "min", "max", "sum", "avg")


def on_segments(function: str, field: int) -> Column:
    """An aggregate of one field over segments; count, sum and avg come from stored counts and sums.

    COUNT gives BIGINT, MIN and MAX FLOAT, SUM and AVG DOUBLE. Without points: 0, and null for the others.
    """
    own = F.col("field_column") == field
    n, total = F.when(own, F.col("n_points").cast("bigint")), F.when(own, F.col("sum_value"))
    if function == "count":
        return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
    if function == "min":
        return F.min(F.when(own, F.col("min_value")))
    if function == "max":
        return F.max(F.when(own, F.col("max_value")))
    if function == "sum":
        return F.sum(total)
    if function == "avg":
        return F.sum(total) / F.sum(n)
    raise InvalidArgument(f"Unknown aggregate '{function}'.")


def aggregate(segments: DataFrame, table: TimeSeriesTable, aggregates: Sequence[tuple[str, str, str]], group_by: Sequence[str] = (), time_range: Range = (None, None), tags: Mapping[str, str] | None = None) -> DataFrame:
    """Aggregates (function, stored field, name) per value of some tags, from the columns of segments.

    With a time range, segments that lie in it as a whole are answered from their columns; only those across an end
    of it are decoded, and both results are put together.
    """
    for tag, value in (tags or {}).items():
        segments = segments.where(F.col(quoted(tag)) == F.lit(value))
    numbers = sorted({table.index(field) for _, field, _ in aggregates})
    segments = segments.where(F.col("field_column").isin(numbers))
    start, end = time_range
    parts = in_time(segments, start, end)
    if start is not None or end is not None:
        inside = F.lit(True)
        if start is not None:
            inside = inside & (F.col("start_us") >= micros(start))
        if end is not None:
            inside = inside & (F.col("end_us") <= micros(end))
        columns = [quoted(t) for t in table.tags] + ["field_column", "n_points", "min_value", "max_value", "sum_value"]
        whole = parts.where(inside).select(*columns)
        for number in numbers:
            name = table.stored[number].name
            cut = points(parts.where(~inside & (F.col("field_column") == number)), table, [name], time_range)
            value = F.col(quoted(name))
            small = cut.groupBy(*[quoted(t) for t in table.tags]).agg(F.count("*").cast("int").alias("n_points"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.sum(value).alias("sum_value"))
            if not table.tags:
                small = small.where("n_points > 0")
            whole = whole.unionByName(small.withColumn("field_column", F.lit(number).cast("smallint")).select(*columns))
        parts = whole
    result = [on_segments(function, table.index(field)).alias(name) for function, field, name in aggregates]
    return parts.groupBy(*[quoted(g) for g in group_by]).agg(*result)
