"""Parquet directories into tables and query results into Parquet directories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import InvalidArgument
from tidemill.runtime import quoted

if TYPE_CHECKING:
    from tidemill.engine import DataFolder


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A directory of Parquet files; columns that its folders name (key=value) are strings."""
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        return spark.read.option("basePath", path).option("recursiveFileLookup", "false").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", before)


def import_parquet(folder: DataFolder, table: str, path: str, columns: Mapping[str, str] | None = None, before: Sequence[str] = (), after: Sequence[str] = (), narrow: bool = False) -> None:
    """Write a directory of Parquet files to a table, in one commit.

    `columns`: for columns of the table the column of the files, the same name if not given. Timestamps are cast to
    microseconds without zone and half floats to floats; doubles to floats only with `narrow`. The statements
    `before` and `after` are run by the folder.
    """
    for statement in before:
        folder.sql(statement)
    rows = read_parquet(folder.spark, path)
    wanted = getattr(folder.table(table), "schema")
    chosen = []
    for field in wanted.fields:
        source = (columns or {}).get(field.name, field.name)
        if source not in rows.columns:
            raise InvalidArgument(f"The files have no column '{source}'.")
        kind = rows.schema[source].dataType
        value = F.col(quoted(source))
        if isinstance(field.dataType, T.TimestampNTZType) and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = value.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.FloatType) and isinstance(kind, T.DoubleType):
            if not narrow:
                raise InvalidArgument(f"Column '{source}' is double; it is cast to float only if asked for.")
            value = value.cast("float")
        chosen.append(value.alias(field.name))
    folder.write(table, rows.select(*chosen))
    for statement in after:
        folder.sql(statement)


def export_table(folder: DataFolder, sql: str, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a query's rows as Parquet files, with folders by the values of `partition_by`."""
    writer = folder.read(sql).write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
