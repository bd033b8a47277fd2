"""Consolidation of many small files into fewer of a good size; the plan is SQL over a frozen manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import attach, durable, quoted, small

#: Files below this size are small.
SMALL_BYTES = 16_384
#: Size that a consolidated file should have.
TARGET_BYTES = 134_217_728
#: Up to so many files (below 100 MB), or repeated records (below 50 MB), are sent to all executors.
FEW_FILES, FEW_REPEATS = 200_000, 500_000


def canonical_location(location: Column) -> Column:
    """The one spelling of a folder: scheme in lower case, `file://` without scheme, no empty, `.` or closing segments."""
    schemed = F.regexp_extract(location, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    has = F.length(schemed) > 0
    path = F.when(has, F.regexp_replace(location, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")).otherwise(location)
    scheme = F.when(has, F.lower(schemed)).otherwise(F.lit("file"))
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    lead = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.when(location.isNotNull(), F.concat(scheme, F.lit("://"), lead, F.array_join(segments, "/")))


def manifest(files: DataFrame) -> DataFrame:
    """The live data files, each once: `file_id` (the smallest), `folder`, `table_name`, `field_column`, `file_name`,
    `size_bytes`, `row_count`, `modified`.

    A data file's name ends in `.parquet` and starts with neither `.` nor `_`; it has rows and isn't removed. Rows
    with a null name, size or count are no data files. A null folder, table or field column is a value of its own.
    """
    name = F.col("file_name")
    data = files.where(name.endswith(".parquet") & ~name.startswith(".") & ~name.startswith("_") & (F.col("row_count") > 0) & F.col("removed_at").isNull() & F.col("size_bytes").isNotNull())
    data = data.withColumn("folder", canonical_location(F.col("location")))
    first = F.min_by(F.struct("size_bytes", "row_count", "modified"), "file_id")
    once = data.groupBy("folder", "table_name", "field_column", "file_name").agg(F.min("file_id").alias("file_id"), first.alias("__first"))
    return once.select("file_id", "folder", "table_name", "field_column", "file_name", "__first.*")


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, spread: Column, name: str, one: str, size: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the group up to and including this one, and `size`: the sum of
    `one` over the group.

    `spread` is a column that never falls along `order`. Sums within a stretch of equal `spread` and sums of whole
    stretches are added, so that a group of any size is shared out over its stretches.
    """
    group = list(group)
    stretched = df.withColumn("__stretch", spread)
    totals = stretched.groupBy(*group, "__stretch").agg(F.sum(value).alias("__total"), F.sum(one).alias("__rows"))
    ahead = Window.partitionBy(*group).orderBy(F.col("__stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("__rows").over(Window.partitionBy(*group)).alias(size)
    offsets = totals.select(*group, "__stretch", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__offset"), whole)
    within = Window.partitionBy(*group, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = attach(stretched, offsets, [*group, "__stretch"])
    return placed.withColumn(name, F.col("__offset") + F.sum(value).over(within)).drop("__stretch", "__offset")


def plan_compaction(files: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Which small files go together: the manifest's columns, then `small_files` (how many small files share folder,
    table and field column), `group_index` (the consolidated file, from 0 per folder, table and field column) and
    `rewrite` boolean.

    Small files are put in order of `modified`, then `file_id`, and the running sum of their bytes is cut at
    multiples of `target_bytes`. Files that aren't small, and a small one without company, stay as they are:
    `rewrite` is false and `group_index` null. Files equal in folder (spelt any way), table, field column and name
    are one. An empty table gives no rows.
    """
    live = durable(manifest(files))
    group = ["folder", "table_name", "field_column"]
    tiny = F.col("size_bytes") < small_bytes
    weighed = live.withColumn("__tiny", F.when(tiny, F.col("size_bytes")).otherwise(0)).withColumn("__one", F.when(tiny, 1).otherwise(0))
    # Stretches of an hour of writing: as many as a folder has hours, however many files it has.
    summed = running_total(weighed, group, [F.col("modified").asc_nulls_first(), "file_id"], "__tiny", F.date_trunc("hour", F.col("modified")), "__bytes", "__one", "__small")
    together = tiny & (F.col("__small") > 1)
    index = F.floor((F.col("__bytes") - F.col("size_bytes")) / F.lit(target_bytes)).cast("long")
    planned = summed.withColumn("small_files", F.when(tiny, F.col("__small")).otherwise(0).cast("long")).withColumn("group_index", F.when(together, index)).withColumn("rewrite", together)
    return planned.drop("__tiny", "__one", "__bytes", "__small")


def _held(plan: DataFrame, records: DataFrame, file_key: str, record_key: str) -> DataFrame:
    """The records of live files with the plan's columns, `__loose` and `__own`: null, or what tells a record without
    id from others. Loose are records that nothing tells from others."""
    target = plan.select(F.col("file_id").alias("__file"), "folder", "table_name", "field_column", "group_index")
    held = records.join(target, records[quoted(file_key)] == target["__file"]).drop("__file")
    row = F.col("row_index") if "row_index" in records.columns else F.lit(None).cast("int")
    nameless = F.col(quoted(record_key)).isNull()
    own = F.when(nameless, F.struct(F.col(quoted(file_key)).alias("file"), row.alias("row")))
    return held.withColumn("__loose", nameless & row.isNull()).withColumn("__own", own)


def compacted_records(plan: DataFrame, records: DataFrame, file_key: str = "file_id", record_key: str = "record_id") -> DataFrame:
    """Every record that a live file holds, once, with the file it belongs to after the rewrite.

    Adds `folder`, `table_name`, `field_column`, `group_index` (null: it stays in its file) to the records' columns.
    A record in several live files comes from the one with the smallest id, one that is not rewritten first, so that
    no copy of it is written beside it. Records of files that aren't live, or of no listed file, are left out.
    Records with a null id are known by their file and `row_index`; where that is null or missing too, all are kept.

    Plan: only ids, file ids and row numbers are shuffled, to find the ids that occur more than once. The records are
    read where they are and joined to the plan's files and to those ids; both are sent to the executors if they are
    few (FEW_FILES, FEW_REPEATS), which is counted first. Records that can't be told apart by file and row, or have no
    id, are ranked; usually there are none.
    """
    plan = plan.select("file_id", "folder", "table_name", "field_column", "group_index")
    row = F.col("row_index") if "row_index" in records.columns else F.lit(None).cast("int")
    target = small(plan.withColumnRenamed("file_id", "__file"), FEW_FILES)
    name = F.col(quoted(record_key))
    keys = records.select(name.alias("__id"), F.col(quoted(file_key)).alias("__in"), row.alias("__row"))
    keys = keys.join(target.select("__file", F.col("group_index").isNotNull().alias("__moved")), F.col("__in") == F.col("__file")).drop("__in")
    named = keys.where(F.col("__id").isNotNull())
    home = F.min(F.struct("__moved", "__file", "__row")).alias("__home")
    repeated = named.groupBy("__id").agg(home, F.count("*").alias("__n")).where("__n > 1")
    repeated = durable(repeated.select(F.col("__id").alias("__again"), F.col("__home.__file").alias("__home"), F.col("__home.__row").alias("__place")))
    again = small(repeated, FEW_REPEATS)
    ties = named.join(again, F.col("__id") == F.col("__again")).where((F.col("__file") == F.col("__home")) & F.col("__row").eqNullSafe(F.col("__place")))
    ties = durable(ties.groupBy("__again").count().where("count > 1").select(F.col("__again").alias("__tie")))
    held = records.join(target, records[quoted(file_key)] == F.col("__file")).drop("__file")
    columns = [quoted(record_key), *[quoted(c) for c in held.columns if c != record_key]]
    both = held.join(again, name == F.col("__again"), "left")
    kept = both.where(name.isNotNull() & (F.col("__again").isNull() | ((F.col(quoted(file_key)) == F.col("__home")) & row.eqNullSafe(F.col("__place")))))
    kept = kept.select(*columns)
    odd = bool(ties.take(1))
    nameless = bool(keys.where(F.col("__id").isNull()).take(1))
    if not odd and not nameless:
        return kept
    ties = small(ties, FEW_REPEATS)
    rest = held.join(ties, name == F.col("__tie"), "left_semi").unionByName(held.where(name.isNull()))
    unnamed = F.when(name.isNull(), F.struct(F.col(quoted(file_key)).alias("file"), row.alias("row")))
    rank = F.row_number().over(Window.partitionBy(quoted(record_key), "__own").orderBy(F.col("group_index").isNotNull(), quoted(file_key), row))
    ranked = rest.withColumn("__own", unnamed).withColumn("__loose", name.isNull() & row.isNull()).withColumn("__rank", rank)
    return kept.join(ties, name == F.col("__tie"), "left_anti").unionByName(ranked.where((F.col("__rank") == 1) | F.col("__loose")).select(*columns))


def expected_counts(plan: DataFrame, records: DataFrame, file_key: str = "file_id", record_key: str = "record_id") -> DataFrame:
    """Distinct records of the source files per consolidated file, `records_expected`: counted from their ids alone,
    whatever compacted_records gives."""
    home = F.min(F.struct(F.col("group_index").isNotNull().alias("rewritten"), F.col(quoted(file_key)).alias("file"))).alias("__home")
    each = _held(plan, records, file_key, record_key).groupBy(quoted(record_key), "__own", "__loose").agg(home, F.count("*").alias("__rows"))
    counts = each.where("__home.rewritten").groupBy(F.col("__home.file").alias("__file")).agg(F.sum(F.when(F.col("__loose"), F.col("__rows")).otherwise(1)).alias("__records"))
    group = ["folder", "table_name", "field_column", "group_index"]
    return counts.join(plan, F.col("__file") == F.col("file_id")).groupBy(*group).agg(F.sum("__records").alias("records_expected"))


def compact(files: DataFrame, records: DataFrame, out: str, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Rewrite the small files under `out` and return the reconciliation, one row per consolidated file.

    Columns: `folder`, `table_name`, `field_column`, `group_index`, `files`, `records_expected`, `records_written`.
    The manifest is frozen first: files that arrive during the rewrite are left for the next one. Raises RuntimeError
    if a group's records, counted in what was written, differ from the distinct ones of the source files, which are
    counted on their own; nothing is removed, so the old files can stay in place until the result has been accepted.
    """
    plan = durable(plan_compaction(files, small_bytes, target_bytes))
    group = ["folder", "table_name", "field_column", "group_index"]
    planned = compacted_records(plan, records).where(F.col("group_index").isNotNull())
    label = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in group[:3]])
    planned.withColumn("__folder", label).withColumn("__group", F.col("group_index")).repartition("__folder", "__group").write.mode("errorifexists").partitionBy("__folder", "__group").parquet(out)
    written = files.sparkSession.read.parquet(out).groupBy(*group).agg(F.count("*").alias("records_written"))
    wanted = expected_counts(plan, records)
    sources = plan.where("rewrite").groupBy(*group).agg(F.count("*").alias("files"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    report = sources.alias("a").join(wanted.alias("b"), on, "full").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in group], "files", "records_expected")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    report = report.alias("a").join(written.alias("b"), on, "full").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in group], "files", F.coalesce("records_expected", F.lit(0)).alias("records_expected"), F.coalesce("records_written", F.lit(0)).alias("records_written"))
    report = durable(report)
    wrong = report.where("records_expected <> records_written").limit(1).count()
    if wrong:
        raise RuntimeError(f"the records written to {out} differ from those of the source files")
    return report
