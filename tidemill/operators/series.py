"""Series cut into blocks of time, each one compact row: the layout that the operators on ordered readings share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.runtime import complete_groups, epoch_day, float64, group_starts, int64, quoted, struct_text

HOUR_US = 3_600_000_000


def pack(values: np.ndarray) -> bytes:
    """An array as bytes; whole numbers as differences."""
    if not len(values):
        return b""
    if values.dtype == np.int64:
        values = np.diff(values, prepend=np.int64(0))
    return zlib.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    """The array that `pack` was given."""
    if not data:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(values) if values.dtype == np.int64 else values


def pack_blocks(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    block_hours: int,
    summary: Callable[[np.ndarray, list[np.ndarray]], dict] | None = None,
    summary_ddl: str = "",
) -> DataFrame:
    """One row per series and block of `block_hours` (a divisor of 24, or a multiple of it) that has a row.

    Columns: the keys, `__block`, `__n`, `__t` (packed microseconds in order), `__v0`... (packed float64, null as
    NaN) and what `summary(times, values)` returns for `summary_ddl`. Rows equal in key, time and all values count
    once; rows without time are ignored. A null key is a series of its own. The shuffle is by (key, block), so that a
    series with a third of all rows is spread over its blocks.
    """
    keys, values = list(keys), list(values)
    if 24 % block_hours and block_hours % 24:
        raise ValueError("block_hours must divide 24 or be a multiple of it")
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.where(F.col(quoted(ts)).isNotNull()).select(
        *[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)],
        F.col(quoted(ts)).alias("__ts"),
        *[F.col(quoted(v)).cast("float" if dict(df.dtypes)[v] == "float" else "double").alias(f"__v{i}") for i, v in enumerate(values)],
    )
    hours = epoch_day(F.col("__ts")) * 24 + (F.hour("__ts") if block_hours < 24 else F.lit(0))
    placed = rows.repartition(*names, F.floor(hours / block_hours)).sortWithinPartitions(*names, "__ts")
    ddl = ", ".join(filter(None, [struct_text(rows, names), "__block bigint, __n int, __t binary", *(f"__v{i} binary" for i in range(len(values))), summary_ddl]))
    width = block_hours * HOUR_US

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(_with_block(batches, width), [*names, "__block"], 100_000):
            starts = group_starts(table, [*names, "__block"])
            t, columns = int64(table.column("__ts")), [float64(table.column(f"__v{i}")) for i in range(len(values))]
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
            order = np.lexsort((*columns[::-1], t, group))
            t, columns, group = t[order], [c[order] for c in columns], group[order]
            new = np.ones(len(t), bool)
            new[1:] = (group[1:] != group[:-1]) | (t[1:] != t[:-1])
            for c in columns:
                new[1:] |= (c[1:] != c[:-1]) & ~(np.isnan(c[1:]) & np.isnan(c[:-1]))
            t, columns, group = t[new], [c[new] for c in columns], group[new]
            first = np.searchsorted(group, np.arange(len(starts)))
            last = np.append(first[1:], len(t))
            out: dict[str, list] = {"__n": [], "__t": [], **{f"__v{i}": [] for i in range(len(values))}}
            extra: dict[str, list] = {}
            for a, b in zip(first.tolist(), last.tolist()):
                parts = [c[a:b] for c in columns]
                out["__n"].append(b - a)
                out["__t"].append(pack(t[a:b]))
                for i, p in enumerate(parts):
                    out[f"__v{i}"].append(pack(p))
                if summary:
                    for k, x in summary(t[a:b], parts).items():
                        extra.setdefault(k, []).append(x)
            heads = [table.column(n).take(pa.array(starts)) for n in [*names, "__block"]]
            heads = [h.combine_chunks() if isinstance(h, pa.ChunkedArray) else h for h in heads]
            heads = [pa.concat_arrays(h.chunks) if isinstance(h, pa.ChunkedArray) else h for h in heads]
            arrays = [pa.array(out["__n"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in out if k != "__n")]
            yield pa.RecordBatch.from_arrays([*heads, *arrays, *(_array(x) for x in extra.values())], names=[*names, "__block", *out, *extra])

    return placed.mapInArrow(run, ddl)


def _array(items: list) -> pa.Array:
    if isinstance(items[0], bytes):
        return pa.array(items, pa.binary())
    if isinstance(items[0], float):
        return pa.array(items, pa.float64())
    return pa.array(items, pa.int64())


def _with_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block = int64(batch.column("__ts")) // width
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=[*batch.schema.names, "__block"])
