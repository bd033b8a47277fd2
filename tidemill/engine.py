"""Data folders: tables of a folder, SQL over them, and the operations that create, fill, copy and maintain them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import dialect
from tidemill.errors import InvalidArgument, InvalidState, Unimplemented
from tidemill.functions import shims
from tidemill.plans import ingest, pushdown, scan
from tidemill.runtime import quoted, shared_dir, ship
from tidemill.storage.files import Files
from tidemill.storage.log import TableLog
from tidemill.types import NormalTable, TimeSeriesTable

Table = NormalTable | TimeSeriesTable
# Schemes of Hadoop's file systems.
HADOOP_SCHEMES = ("hdfs", "viewfs", "s3a", "abfs", "abfss", "gs")
_keywords: dict[str, frozenset[str]] = {}


def keywords(spark: SparkSession) -> frozenset[str]:
    """Words that can't be table names."""
    if "all" not in _keywords:
        # The list that `sql_keywords()` gives; as a query it takes seconds to compile.
        words = spark._jvm.org.apache.spark.sql.catalyst.util.SQLKeywordUtils.keywords().mkString("\n")
        _keywords["all"] = frozenset(words.split("\n"))
    return _keywords["all"]


class DataFolder:
    """A folder of tables. Open it with `open_local`, `open_memory`, `open_s3` or `open_azure`.

    Every read sees the last commits at the time it is planned. Several writers may use one folder.
    """

    def __init__(self, spark: SparkSession, url: str, temporary: bool = False) -> None:
        self.spark = ship(spark)
        self.url, self._temporary = url, temporary
        self.nodes: list[DataFolder] = []
        self.files = Files(spark, url)
        shims.register(spark)

    def __enter__(self) -> DataFolder:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Remove a folder in memory; others stay."""
        if self._temporary:
            self.files.delete("")

    def type(self) -> str:
        return "DataFolder"

    # Catalog

    def tables(self) -> list[str]:
        """Names of all tables, normal ones first, each kind in order."""
        found = self._catalog()
        kinds = [[n for n, t in sorted(found.items()) if isinstance(t, kind)] for kind in (NormalTable, TimeSeriesTable)]
        return kinds[0] + kinds[1]

    def _catalog(self) -> dict[str, Table]:
        names = [n.removesuffix(".json") for n, _ in self.files.list("metadata") if n.endswith(".json")]
        return {n: self.table(n) for n in names}

    def table(self, name: str) -> Table:
        """The metadata of a table."""
        path = f"metadata/{name.lower()}.json"
        if not self.files.exists(path):
            raise InvalidArgument(f"Table with name '{name}' does not exist.")
        data = json.loads(self.files.read(path))
        return (TimeSeriesTable if data["kind"] == "time series" else NormalTable).from_json(data)

    def schema(self, name: str) -> T.StructType:
        """The columns that a table is read with."""
        return self.table(name).query_schema

    def create(self, table: Table) -> None:
        """Create an empty table."""
        if isinstance(table, TimeSeriesTable):
            for g in table.generated:
                scan.sources(self.spark, table, g.expression or "")
        else:
            _check_types(table.schema)
        if not self.files.create(f"metadata/{table.name}.json", json.dumps(table.to_json())):
            raise InvalidArgument(f"Table with name '{table.name}' already exists.")

    def drop(self, name: str) -> None:
        """Remove a table with its data."""
        self.table(name)
        self.files.delete(f"metadata/{name.lower()}.json")
        self.files.delete(f"tables/{name.lower()}")

    def truncate(self, name: str) -> None:
        """Remove all rows of a table; files stay until vacuum."""
        self._log(self.table(name).name).truncate()

    def vacuum(self, name: str | None = None, retain: int = dialect.DEFAULT_RETAIN) -> int:
        """Remove files that no table needs and that are older than `retain` seconds; of all tables without a name."""
        if not 0 <= retain <= dialect.MOST_RETAIN:
            raise InvalidArgument(f"The retention period must be from 0 to {dialect.MOST_RETAIN} seconds.")
        names = [self.table(name).name] if name else self.tables()
        return sum(self._log(n).vacuum(retain) for n in names)

    def _log(self, name: str) -> TableLog:
        return TableLog(self.files, name)

    # Writing

    def write(self, name: str, rows: DataFrame, batches: Iterable[str] = ()) -> bool:
        """Add rows in one commit; False if batches of these ids have all been written before.

        Columns are taken by position and must have the table's types. For a time series table the generated columns
        may be there, in their places, or not. Nulls are refused in columns that can't hold them.
        """
        return self._write(self.table(name), rows, batches) is not None

    def _write(self, table: Table, rows: DataFrame, batches: Iterable[str] = ()) -> str | None:
        """The commit that was made."""
        rows = self._stored(table, rows)
        if isinstance(table, NormalTable):
            return self._log(table.name).append(lambda url: rows.write.option("compression", "zstd").parquet(url), batches)
        return self._append_segments(table, ingest.to_segments(rows, table), batches)

    def _stored(self, table: Table, rows: DataFrame) -> DataFrame:
        if isinstance(table, TimeSeriesTable) and len(rows.columns) == len(table.columns) != len(table.stored):
            rows = rows.toDF(*[c.name for c in table.columns]).select(*[quoted(c.name) for c in table.stored])
        return conform(rows, table.schema)

    def _append_segments(self, table: TimeSeriesTable, segments: DataFrame, batches: Iterable[str] = (), replace: Sequence[str] | None = None, rest: DataFrame | None = None) -> str | None:
        order = ["field_column", *(quoted(t) for t in table.tags), "start_us"]

        def write(url: str) -> None:
            segments.sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy("field_column").parquet(url)

        stage = None if rest is None else lambda url: rest.write.option("compression", "zstd").parquet(url)
        return self._log(table.name).append(write, batches, replace, segments=True, stage=stage)

    def hold(self, name: str, rows: DataFrame, batches: Iterable[str] = ()) -> bool:
        """Keep rows of a time series table for a later `flush`, in one commit; queries don't see them until then.

        For rows that come in many small batches, which would make a segment per batch and series otherwise.
        """
        table = self._time_series(name)
        rows = self._stored(table, rows)
        return self._log(table.name).append(lambda url: rows.write.option("compression", "zstd").parquet(url), batches, waiting=True) is not None

    def held(self, name: str) -> int:
        """How many rows wait for a flush."""
        state = self._log(self._time_series(name).name).state()
        return sum(state.notes[c]["rows"] for c in state.staged)

    def flush(self, name: str, least: int = 1) -> bool:
        """Compress the rows that wait, of series with at least `least` of them; the others go on waiting.

        One commit adds the segments and replaces what waited, so rows are neither lost nor there twice. False if
        there was nothing to do.
        """
        table = self._time_series(name)
        log = self._log(table.name)
        state = log.state()
        if not state.staged:
            return False
        rows = log.staged(table.schema, state)
        rest = None
        if least > 1:
            counts = rows.groupBy(*[F.col(quoted(t)).alias(f"__{i}") for i, t in enumerate(table.tags)]).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
            if not counts.take(1):
                return False
            if table.tags:
                same = [F.col(quoted(t)) == F.col(f"__{i}") for i, t in enumerate(table.tags)]
                rows, rest = rows.join(counts, same, "left_semi"), rows.join(counts, same, "left_anti")
        return self._append_segments(table, ingest.to_segments(rows, table), replace=state.staged, rest=rest) is not None

    def optimize(self, name: str) -> None:
        """Merge a time series table's commits to one.

        Lossless points are compressed again as if they had come at once, which also merges late data. Segments with
        an error bound stay as they are, as their values would need more bytes to be kept exactly and compressing
        them within the bound again would add up; they go to fewer files.
        """
        table = self._time_series(name)
        commits = self._log(table.name).state().commits
        if not commits:
            return
        segments = self.segments(table)
        if all(f.bound.is_lossless for f in table.fields):
            points = scan.points(segments, table, [f.name for f in table.fields])
            segments = ingest.to_segments(points.select(*[quoted(c) for c in table.schema.fieldNames()]), table)
        else:
            # By block of time, then series: files of few blocks, and a large series is spread.
            block = F.floor(F.col("start_us") / (scan.BLOCK_DAYS * 86_400_000_000))
            segments = segments.repartitionByRange("field_column", block, *[F.col(quoted(t)) for t in table.tags])
        self._append_segments(table, segments, replace=commits)

    def segments(self, table: TimeSeriesTable | str, fields: Sequence[int] | None = None, time_range: scan.Range = (None, None), value_range: scan.Values = (None, None), commits: Sequence[str] | None = None) -> DataFrame:
        """The segments of a time series table, as they are stored; without files that have none of some fields, times
        or values."""
        table = self._time_series(table) if isinstance(table, str) else table
        start, end = (None if t is None else scan.micros(t) for t in time_range)
        return self._log(table.name).segments(table.segment_schema, fields, (start, end), value_range, commits)

    def _source(self, table: TimeSeriesTable, tags: Mapping[str, str] | None = None) -> scan.Source:
        def chosen(fields: Sequence[int], times: scan.Range, values: scan.Values) -> DataFrame:
            return _with_tags(self.segments(table, fields, times, values), tags)

        return chosen

    def segment_stats(self, name: str) -> DataFrame:
        """Per field and model: segments, points, those with residuals, regular ones and bytes of payload."""
        table = self._time_series(name)
        stored = {table.index(f.name): f.name for f in table.fields}
        field = F.element_at(F.create_map(*[F.lit(x) for i in stored.items() for x in i]), F.col("field_column").cast("int"))
        model = F.element_at(F.array(F.lit("constant"), F.lit("linear"), F.lit("xor")), F.col("model_type") + 1)
        size = lambda c: F.coalesce(F.length(c), F.lit(0))
        return (
            self.segments(table)
            .groupBy(field.alias("field"), model.alias("model"))
            .agg(
                F.count("*").alias("segments"),
                F.sum("n_points").alias("points"),
                F.count_if((F.col("model_points") > 0) & (F.col("n_points") > F.col("model_points"))).alias("with_residuals"),
                F.count_if(F.col("interval_us").isNotNull()).alias("regular"),
                F.sum(size("times") + size("residuals")).alias("payload_bytes"),
            )
        )

    def _time_series(self, name: str) -> TimeSeriesTable:
        table = self.table(name)
        if not isinstance(table, TimeSeriesTable):
            raise InvalidArgument(f"Table with name '{name}' is not a time series table.")
        return table

    # Reading

    def frame(self, name: str, columns: Sequence[str] | None = None, time_range: scan.Range = (None, None), value_range: scan.Values = (None, None)) -> DataFrame:
        """A table as a DataFrame; only the given columns, and points of the time range, are read.

        `value_range` leaves out segments without values in it if one field is read; other values are not left out.
        """
        table = self.table(name)
        if isinstance(table, NormalTable):
            rows = self._log(table.name).read(table.schema)
            return rows if columns is None else rows.select(*[quoted(c) for c in columns])
        return scan.view(self.spark, self._source(table), table, columns, time_range, value_range)

    def read(self, sql: str) -> DataFrame:
        """The result of a query."""
        statement = dialect.parse(sql, keywords(self.spark))
        if isinstance(statement, dialect.Include):
            return self._include(statement)
        if not isinstance(statement, dialect.Query):
            raise InvalidArgument("Only a query can be read.")
        return pushdown.query(self, statement.sql)

    def sql(self, sql: str) -> DataFrame:
        """Run a statement of the engine's dialect. Statements without result give an empty DataFrame."""
        statement = dialect.parse(sql, keywords(self.spark))
        nothing = self.spark.createDataFrame([], "done boolean")
        match statement:
            case dialect.Query(text):
                return pushdown.query(self, text)
            case dialect.Include():
                return self._include(statement)
            case dialect.Explain(analyze, text):
                plan = pushdown.query(self, text)
                if analyze:
                    plan.write.format("noop").mode("overwrite").save()
                text = plan._jdf.queryExecution().toString() if not analyze else plan._jdf.queryExecution().executedPlan().toString()
                return self.spark.createDataFrame([(text,)], "plan string")
            case dialect.CreateTimeSeriesTable(table):
                self.create(table)
            case dialect.CreateTable(name, columns):
                schema = T.StructType([T.StructField(c, T._parse_datatype_string(f"x {kind}").fields[0].dataType, not required) for c, kind, required in columns])
                self.create(NormalTable(name, schema))
            case dialect.Insert(name, columns, text):
                return self._insert(name, columns, text)
            case dialect.Truncate(names, cluster):
                for folder, found in self._on_nodes(cluster, names):
                    for name in found:
                        folder.truncate(name)
            case dialect.Drop(names):
                for name in [self.table(n).name for n in names]:
                    self.drop(name)
            case dialect.Vacuum(names, retain, cluster):
                for folder, found in self._on_nodes(cluster, names):
                    for name in found or folder.tables():
                        folder.vacuum(name, retain)
        return nothing

    def join(self, *addresses: str) -> DataFolder:
        """Make the folders at these addresses nodes of a cluster with this one, for the CLUSTER forms of statements."""
        self.nodes = [*self.nodes, *(open_url(self.spark, a) for a in addresses)]
        return self

    def _on_nodes(self, cluster: bool, names: Sequence[str]) -> list[tuple[DataFolder, list[str]]]:
        """This folder, or all nodes, with the tables by their names; an error before anything is done if one lacks one."""
        if cluster and not self.nodes:
            raise Unimplemented("A data folder that has joined no other is not part of a cluster.")
        return [(f, [f.table(n).name for n in names]) for f in ([self, *self.nodes] if cluster else [self])]

    def _insert(self, name: str, columns: Sequence[str], text: str) -> DataFrame:
        table = self.table(name)
        rows = pushdown.query(self, text)
        wanted = table.query_schema if len(rows.columns) == len(table.query_schema) or isinstance(table, NormalTable) else table.schema
        if columns:
            if len(columns) != len(rows.columns) or set(columns) - set(wanted.fieldNames()):
                raise InvalidArgument(f"The columns given don't match table '{name}'.")
            rows = rows.toDF(*columns)
            missing = [f.name for f in wanted.fields if f.name not in columns]
            for column in missing:
                rows = rows.withColumn(column, F.lit(None))
            rows = rows.select(*[quoted(f.name) for f in wanted.fields])
        if len(rows.columns) != len(wanted):
            raise InvalidArgument(f"The schema of the rows doesn't match table '{name}'.")
        # Literals and expressions have types of their own; INSERT converts them where no value can be lost in kind.
        plain = rows.toDF(*[f"__c{i}" for i in range(len(wanted))])
        rows = plain.select(*[F.col(f"__c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(wanted.fields)])
        # The query runs once; its rows are counted where they have been written.
        commit = self._write(table, rows)
        return self.spark.createDataFrame([(self._log(table.name).rows(commit or ""),)], "count bigint")

    def _include(self, statement: dialect.Include) -> DataFrame:
        result = pushdown.query(self, statement.sql)
        for address in statement.addresses:
            result = result.union(pushdown.query(open_url(self.spark, address), statement.sql))
        return result

    def read_time_series_table(
        self,
        name: str,
        columns: Sequence[str] | Mapping[str, str | None] | None = None,
        group_by: Sequence[str] = (),
        start: datetime | int | None = None,
        end: datetime | int | None = None,
        tags: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """Points or aggregates of a time series table.

        `columns`: names, or names with an aggregate (`count`, `min`, `max`, `sum`, `avg`, or None). The range
        includes both ends. Aggregates of stored fields are answered from segments, with grouping by tags, and only
        segments across an end of the range are decoded. Results of aggregates are named like `COUNT(field_1)`.
        """
        table = self._time_series(name)
        chosen = dict.fromkeys(columns, None) if columns is not None and not isinstance(columns, Mapping) else dict(columns or {})
        known = set(table.query_schema.fieldNames())
        unknown = [c for c in [*chosen, *group_by, *(tags or {})] if c not in known]
        if unknown:
            raise InvalidArgument(f"Column '{unknown[0]}' does not exist in table '{name}'.")
        bad = [a for a in chosen.values() if a is not None and a.lower() not in scan.AGGREGATES]
        if bad:
            raise InvalidArgument(f"Unknown aggregate '{bad[0]}'.")
        if [t for t in tags or {} if t not in table.tags]:
            raise InvalidArgument("Only tags can be given as tags.")
        aggregates = [(a.lower(), c, f"{a.upper()}({c})") for c, a in chosen.items() if a is not None]
        plain = [c for c, a in chosen.items() if a is None]
        if not aggregates and group_by:
            raise InvalidArgument("Grouping needs an aggregate.")
        stored = {f.name for f in table.fields}
        if aggregates and set(plain) <= set(group_by) <= set(table.tags) and all(c in stored for _, c, _ in aggregates):
            result = scan.aggregate(self.segments(table, None, (start, end)), table, aggregates, group_by, (start, end), tags)
            return result.select(*[quoted(c) for c in plain], *[quoted(n) for _, _, n in aggregates])
        needed = list(dict.fromkeys([*chosen, *group_by, *(tags or {})])) or None
        rows = scan.view(self.spark, self._source(table, tags), table, needed, (start, end))
        for tag, value in (tags or {}).items():
            rows = rows.where(F.col(quoted(tag)) == F.lit(value))
        if not aggregates:
            return rows.select(*[quoted(c) for c in chosen]) if chosen else rows
        if not set(plain) <= set(group_by):
            raise InvalidArgument("Columns without an aggregate must be grouped by.")
        functions = {"count": F.count, "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}
        result = rows.groupBy(*[quoted(g) for g in group_by]).agg(*[functions[f](quoted(c)).alias(n) for f, c, n in aggregates])
        return result.select(*[quoted(c) for c in plain], *[quoted(n) for _, _, n in aggregates])

    # Copying and moving

    def copy(self, sql: str, target: DataFolder, name: str) -> None:
        """Write a query's rows to a normal table of another folder; the schemas must be the same."""
        table = target.table(name)
        if not isinstance(table, NormalTable):
            raise InvalidArgument(f"Table with name '{name}' is not a normal table.")
        target.write(name, self.read(sql))

    def copy_time_series_table(self, name: str, target: DataFolder, target_name: str, start: datetime | int | None = None, end: datetime | int | None = None, tags: Mapping[str, str] | None = None) -> None:
        """Copy the segments that lie in the range as a whole, both ends included.

        A chunk in the range is copied without decoding. Of one across an end, the points go whose segments lie in the
        range for every field, as a chunk of its own: only segments of another field that reach beyond these points
        are decoded, and what is left of them is stored exactly.
        """
        table, other = self._time_series(name), target._time_series(target_name)
        _same_columns(table, other)
        segments = _with_tags(self.segments(table, None, scan.widened((start, end))), tags)
        # All of a chunk's fields must go together.
        if start is not None or end is not None:
            spans = segments.groupBy("chunk").agg(F.min("start_us").alias("__a"), F.max("end_us").alias("__b"))
            inside, near = F.lit(True), F.lit(True)
            if start is not None:
                inside, near = inside & (F.col("__a") >= scan.micros(start)), near & (F.col("__b") >= scan.micros(start))
            if end is not None:
                inside, near = inside & (F.col("__b") <= scan.micros(end)), near & (F.col("__a") <= scan.micros(end))
            across = _of_chunks(segments, spans.where(near & ~inside))
            segments = _of_chunks(segments, spans.where(inside)).unionByName(ingest.cut(across, table, start, end))
        target._append_segments(other, segments.toDF(*other.segment_schema.fieldNames()))

    def move(self, name: str, target: DataFolder, target_name: str) -> None:
        """Move all rows to a table of the same kind and columns in another folder."""
        table, other = self.table(name), target.table(target_name)
        if type(table) is not type(other):
            raise InvalidArgument(f"Tables '{name}' and '{target_name}' are not of the same kind.")
        if isinstance(table, TimeSeriesTable):
            self.flush(name)
        commits = self._log(table.name).state().commits
        # What an interrupted move has brought over before isn't moved again, whatever came since.
        arrived = target._log(other.name).state()
        open_ = [c for c in commits if not arrived.committed(f"move-{c}")]
        if open_ and isinstance(table, TimeSeriesTable):
            _same_columns(table, other)
            rows = self.segments(table, commits=open_).toDF(*other.segment_schema.fieldNames())
            target._append_segments(other, rows, [f"move-{c}" for c in open_])
        elif open_:
            rows = self._log(table.name).read(table.schema, open_)
            target.write(target_name, rows, [f"move-{c}" for c in open_])
        # Rows that came since then stay here.
        moved = set(commits)
        self._log(table.name).commit(lambda s: {"remove": [c for c in s.commits if c in moved]} if moved & set(s.commits) else None)

    # Views for SQL

    def metadata(self, name: str) -> DataFrame:
        """The catalog as tables: normal_table_metadata, time_series_table_metadata, time_series_table_field_columns."""
        found = [t for _, t in sorted(self._catalog().items())]
        series = [t for t in found if isinstance(t, TimeSeriesTable)]
        match name:
            case "normal_table_metadata":
                return self.spark.createDataFrame([(t.name,) for t in found if isinstance(t, NormalTable)], "table_name string")
            case "time_series_table_metadata":
                return self.spark.createDataFrame([(t.name, t.query_schema.json()) for t in series], "table_name string, query_schema string")
            case "time_series_table_field_columns":
                rows = [(t.name, c.name, i, c.bound.value, c.bound.relative, c.expression) for t in series for i, c in enumerate(t.columns) if c.kind.value == "FIELD"]
                return self.spark.createDataFrame(rows, "table_name string, column_name string, column_index int, error_bound_value double, error_bound_is_relative boolean, generated_column_expr string")
        raise InvalidArgument(f"Table with name 'metadata.{name}' does not exist.")


def _with_tags(segments: DataFrame, tags: Mapping[str, str] | None) -> DataFrame:
    for tag, value in (tags or {}).items():
        segments = segments.where(F.col(quoted(tag)) == F.lit(value))
    return segments


def _of_chunks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments of the given chunks."""
    return segments.join(chunks.select(F.col("chunk").alias("__chunk")), F.col("chunk") == F.col("__chunk"), "left_semi")


def _same_columns(a: TimeSeriesTable, b: TimeSeriesTable) -> None:
    if [(c.name, c.kind) for c in a.stored] != [(c.name, c.kind) for c in b.stored]:
        raise InvalidArgument(f"The schemas of tables '{a.name}' and '{b.name}' don't match.")


def _check_types(schema: T.StructType) -> None:
    if not schema.fields:
        raise InvalidArgument("A table must have at least one column.")


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """`rows` with the names of `schema`, if their types are the same by position. A null where none may be is an error."""
    own = rows.schema.fields
    if len(own) != len(schema.fields):
        raise InvalidArgument(f"The rows have {len(own)} columns, the table has {len(schema.fields)}.")
    for a, b in zip(own, schema.fields):
        if _plain(a.dataType) != _plain(b.dataType):
            raise InvalidArgument(f"Column '{a.name}' has type {a.dataType.simpleString()}, the table's '{b.name}' has {b.dataType.simpleString()}.")
    plain = rows.toDF(*[f"__c{i}" for i in range(len(own))])
    columns = []
    for i, (a, b) in enumerate(zip(own, schema.fields)):
        value = F.col(f"__c{i}")
        if a.nullable and not b.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"Invalid Argument Error: Column '{b.name}' can't hold null.")).cast(b.dataType))
        columns.append(value.alias(b.name))
    return plain.select(*columns)


def _plain(kind: T.DataType) -> str:
    return kind.simpleString().replace("varchar", "string")


def open_local(spark: SparkSession, path: str) -> DataFolder:
    """A folder on a path or file:// URL that all executors see."""
    return DataFolder(spark, path)


def open_memory(spark: SparkSession, name: str | None = None) -> DataFolder:
    """A folder that is removed when it is closed. It is kept where all executors see it; `memory://name` is one that
    is open under that name in this application."""
    home = f"{shared_dir(spark)}/memory-{spark.sparkContext.applicationId}-{name or uuid.uuid4().hex}"
    return DataFolder(spark, home, temporary=True)


def open_s3(spark: SparkSession, endpoint: str, bucket: str, access_key: str, secret_key: str) -> DataFolder:
    """A bucket of an S3 store; needs Hadoop's S3A file system on the class path."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in (("endpoint", endpoint), ("access.key", access_key), ("secret.key", secret_key), ("path.style.access", "true")):
        conf.set(f"fs.s3a.bucket.{bucket}.{key}", value)
    return DataFolder(spark, f"s3a://{bucket}")


def open_azure(spark: SparkSession, account: str, key: str, container: str) -> DataFolder:
    """A container of an Azure store; needs Hadoop's ABFS file system on the class path."""
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.azure.account.key.{account}.dfs.core.windows.net", key)
    return DataFolder(spark, f"abfss://{container}@{account}.dfs.core.windows.net")


def open_url(spark: SparkSession, url: str, **options: str) -> DataFolder:
    """A folder by its URL: a path, file://, memory://, s3:// or azureblobstorage:// (with the store's options), or one
    that Hadoop's file systems take as it is."""
    scheme, found, rest = url.partition("://")
    if not found or scheme.lower() == "file":
        return open_local(spark, url if found else url)
    match scheme.lower():
        case "memory":
            return open_memory(spark, rest.strip("/") or None)
        case "s3":
            return open_s3(spark, bucket=rest.strip("/"), **options)
        case "azureblobstorage":
            return open_azure(spark, container=rest.strip("/"), **options)
    if scheme.lower() in HADOOP_SCHEMES:
        return DataFolder(spark, url)
    raise InvalidArgument(f"'{url}' is not the URL of a data folder.")


def connect(*_: object) -> DataFolder:
    raise Unimplemented("There is no server to connect to; open the data folder, or use Spark Connect.")


def check_state(folder: DataFolder) -> None:
    """Raise InvalidState if a table has data without metadata."""
    known = {n.removesuffix(".json") for n, _ in folder.files.list("metadata")}
    lost = [n for n, _ in folder.files.list("tables") if n not in known]
    if lost:
        raise InvalidState(f"Table '{lost[0]}' has data but no metadata.")
