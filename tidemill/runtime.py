"""Helpers shared by all operators: cutting lineage, reading sorted partitions group by group."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import InvalidState


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Where neither is set, a temporary one is made if everything runs on this machine (tests, a shell); on a cluster
    executors couldn't see it, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir() or ""
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise InvalidState("Set spark.checkpoint.dir to a folder that all executors share.")
        named = tempfile.mkdtemp(prefix="tidemill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def ship(spark: SparkSession) -> SparkSession:
    """Make the package known to the session's Python workers, wherever they run; once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tidemill_shipped", False):
        return spark
    home = Path(__file__).resolve().parent
    if home.is_dir():
        archive = os.path.join(tempfile.mkdtemp(prefix="tidemill-"), "tidemill.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(home.rglob("*.py")):
                out.write(path, path.relative_to(home.parent))
        context.addPyFile(archive)
    context._tidemill_shipped = True
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Run `df` now, keep its rows in the shared folder and continue from there: a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int) -> DataFrame:
    """A side of a join: sent to all executors if it has at most so many rows, which are counted; otherwise Spark
    shuffles both sides. `df` should be cheap to count: a table, or `durable`."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """From a partition sorted by `keys`: tables of about `rows` rows in which no group is cut.

    Nulls are equal to each other. A group larger than `rows` comes whole in one table.
    """
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
        # A group that fills the table alone waits for as many rows again, so that no row is copied more than twice on average.
        count = table.num_rows - cut if cut else 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integers that are equal where the values are; null is a value of its own."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    return pc.dictionary_encode(array, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of equal neighbouring keys start."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for key in keys:
        code = codes(table.column(key))
        change[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(change)


def int64(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A timestamp or integer column without nulls as int64."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_timestamp(array.type):
        array = array.cast(pa.timestamp("us", tz=array.type.tz)).view(pa.int64())
    return array.cast(pa.int64()).to_numpy(zero_copy_only=False)


def float64(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A numeric column as float64, null as NaN."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.cast(pa.float64()).to_numpy(zero_copy_only=False)


def float32(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A float column without nulls."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.cast(pa.float32()).to_numpy(zero_copy_only=False)


def epoch_day(ts: Column) -> Column:
    """Days since 1970-01-01; for timestamps without zone it depends on no session setting."""
    return F.unix_date(F.to_date(ts))


def usable(value: Column) -> Column:
    """Neither null nor NaN; infinities are usable."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def arrow_schema(df: DataFrame, columns: list[str]) -> list[pa.Field]:
    """The named columns of `df` as Arrow fields."""
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = to_arrow_schema(df.select(*columns).schema)
    return [whole.field(i) for i in range(len(columns))]


def quoted(name: str) -> str:
    """A column name for SQL text and F.col, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def struct_text(df: DataFrame, columns: list[str]) -> str:
    """The named columns as a DDL schema string."""
    types = dict(df.dtypes)
    return ", ".join(f"{quoted(c)} {types[c]}" for c in columns)


def attach(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of the same name, nulls equal; the columns of `left`, then the other ones of `right`."""
    renamed = right.withColumnsRenamed({c: f"{c}__right" for c in on})
    same = [F.col(quoted(c)).eqNullSafe(F.col(quoted(f"{c}__right"))) for c in on]
    return left.join(renamed, same).drop(*[f"{c}__right" for c in on])
