"""Queries of the general training-data problems (p2 to p6) over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.compaction import compact, compacted_records, plan_compaction
from tidemill.operators.intervals import merge_intervals
from tidemill.operators.regular_grid import regular_grid
from tidemill.operators.rolling import rolling_totals
from tidemill.operators.spikes import Rules, flag_readings
from tidemill.runtime import durable, shared_dir

SERIES = ["tag_1", "tag_2"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def limits(spark: SparkSession, d: str, name: str) -> dict[str, tuple[float, float]]:
    """The physical range of each column of a table; field_limits holds a row for a column."""
    rows = table(spark, d, "field_limits").where(F.col("table_name") == name).collect()
    return {r["column_name"]: (r["lowest"], r["highest"]) for r in rows}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rolled = rolling_totals(table(spark, d, "time_series_table"), SERIES, "timestamp", ["field_1"])
    quiet = rolled.where((F.col("active_days") == 0) & F.col("tag_2").isNotNull())
    return quiet.select("tag_1", "tag_2", F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days")


def p2_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    rolled = rolling_totals(table(spark, d, "time_series_table"), SERIES, "timestamp", ["field_1", "field_2"])
    exact = ["field_1_count", "field_1_lowest", "field_1_highest", "field_2_count", "field_2_lowest", "field_2_highest"]
    rounded = [F.round(c, 3).alias(c) for c in ("field_1_total", "field_1_average", "field_2_total", "field_2_average")]
    return rolled.select(*SERIES, F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days", "active_days", *exact, *rounded)


def _turbine_flags(spark: SparkSession, d: str) -> DataFrame:
    found = limits(spark, d, "wind_turbine")
    rules = {c: Rules(*found[c], 360.0 if c == "wind_direction" else None) for c in ("wind_speed", "wind_direction")}
    return flag_readings(table(spark, d, "wind_turbine"), ["wind_turbine"], "timestamp", rules)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _turbine_flags(spark, d).select("wind_turbine", "timestamp_us", "column_name").distinct()


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    return _turbine_flags(spark, d)


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    """The readings that rules alone tell: impossible and stuck ones."""
    return _turbine_flags(spark, d).where("kind <> 'spike'").select("wind_turbine", "timestamp_us", "column_name", "kind").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    merged = merge_intervals(table(spark, d, "compressed_segments"), ["tag", "field_column"], "start_time", "end_time", 1_000_000)
    return merged.withColumn("field_column", F.col("field_column").cast("int"))


def _turbine_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "wind_turbine"), ["wind_turbine"], "timestamp", "wind_speed", limits=limits(spark, d, "wind_turbine")["wind_speed"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _turbine_grid(spark, d).where("missing").select("wind_turbine", "slot_us")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    return _turbine_grid(spark, d)


def p5_slots(spark: SparkSession, d: str) -> DataFrame:
    return _turbine_grid(spark, d).select("wind_turbine", "slot_us", "readings", "missing")


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """Per turbine: its slots, those filled, whether all have a value, and whether those filled are less certain."""
    missing = F.col("missing")
    sure, unsure = F.avg(F.when(~missing, F.col("deviation"))), F.avg(F.when(missing, F.col("deviation")))
    surer = F.coalesce(sure < unsure, F.lit(True))
    whole = F.bool_and(F.col("value").isNotNull() & (F.col("deviation") > 0))
    return _turbine_grid(spark, d).groupBy("wind_turbine").agg(F.count("*").alias("slots"), F.count_if(missing).alias("filled"), whole.alias("valued"), surer.alias("surer"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return plan_compaction(table(spark, d, "data_folder_files")).where("rewrite").select("file_id")


def p6_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan_compaction(table(spark, d, "data_folder_files")).select("file_id", "folder", "table_name", "field_column", "size_bytes", "small_files", "group_index", "rewrite")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    plan = durable(plan_compaction(table(spark, d, "data_folder_files")))
    records = compacted_records(plan, table(spark, d, "data_folder_records"))
    return records.select("record_id", "tag", "value", "folder", "table_name", "field_column", "group_index")


def p6_rewrite(spark: SparkSession, d: str) -> DataFrame:
    out = f"{shared_dir(spark)}/compacted-{uuid.uuid4().hex}"
    return compact(table(spark, d, "data_folder_files"), table(spark, d, "data_folder_records"), out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p2_found, p2_rolling_totals, p3_found, p3_flags, p3_rules, p4_found, p5_found, p5_grid, p5_slots, p5_filled, p6_found, p6_plan, p6_records, p6_rewrite)
    return {f.__name__: f for f in found}


_ROLL = """
  u AS (SELECT DISTINCT * FROM time_series_table WHERE timestamp IS NOT NULL),
  r AS (SELECT tag_1, tag_2, CAST(timestamp AS DATE) AS day,
          CASE WHEN NOT isnan(field_1) THEN CAST(field_1 AS DOUBLE) END AS a,
          CASE WHEN NOT isnan(field_2) THEN CAST(field_2 AS DOUBLE) END AS b FROM u),
"""

_FILES = r"""
  m AS (SELECT *,
      CASE WHEN regexp_matches(location, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN lower(regexp_extract(location, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) ELSE 'file' END AS scheme,
      regexp_replace(location, '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS path FROM data_folder_files
    WHERE file_name LIKE '%.parquet' AND left(file_name, 1) NOT IN ('.', '_') AND row_count > 0 AND removed_at IS NULL AND size_bytes IS NOT NULL),
  f AS (SELECT *, scheme || '://' || CASE WHEN left(path, 1) = '/' THEN '/' ELSE '' END
      || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '' AND s <> '.'), '/') AS folder FROM m),
  live AS (SELECT folder, table_name, field_column, file_name, min(file_id) AS file_id, min_by(size_bytes, file_id) AS size_bytes, min_by(modified, file_id) AS modified
    FROM f GROUP BY ALL),
  plan AS (SELECT *, count(*) FILTER (WHERE size_bytes < 16384) OVER (PARTITION BY folder, table_name, field_column) AS n,
      sum(CASE WHEN size_bytes < 16384 THEN size_bytes ELSE 0 END) OVER (PARTITION BY folder, table_name, field_column ORDER BY modified NULLS FIRST, file_id) - size_bytes AS ahead
    FROM live),
  planned AS (SELECT file_id, folder, table_name, field_column, size_bytes,
      CASE WHEN size_bytes < 16384 THEN n ELSE 0 END AS small_files,
      CASE WHEN size_bytes < 16384 AND n > 1 THEN CAST(floor(ahead / 134217728) AS BIGINT) END AS group_index,
      size_bytes < 16384 AND n > 1 AS rewrite FROM plan)
"""

_SLOTS = """
  u AS (SELECT DISTINCT timestamp, wind_turbine, wind_speed FROM wind_turbine WHERE wind_speed IS NOT NULL AND NOT isnan(wind_speed)),
  s AS (SELECT wind_turbine, epoch_us(timestamp) // 600000000 AS slot, count(*) AS readings FROM u GROUP BY ALL),
  g AS (SELECT wind_turbine, unnest(range(min(slot), max(slot) + 1)) AS slot FROM s GROUP BY wind_turbine)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
WITH {_ROLL}
  act AS (SELECT DISTINCT tag_1, tag_2, day FROM r WHERE a IS NOT NULL AND tag_2 IS NOT NULL),
  span AS (SELECT tag_1, tag_2, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM act GROUP BY tag_1, tag_2),
  w AS (SELECT * FROM span CROSS JOIN (VALUES (7), (30)) v(window_days))
SELECT w.tag_1, w.tag_2, strftime(w.day, '%Y-%m-%d') AS day, CAST(window_days AS INTEGER) AS window_days FROM w
LEFT JOIN act ON act.tag_1 = w.tag_1 AND act.tag_2 = w.tag_2 AND act.day <= w.day AND act.day > w.day - to_days(CAST(window_days AS INTEGER))
GROUP BY ALL HAVING count(act.day) = 0""",
        "p2_rolling_totals": f"""
WITH {_ROLL}
  dly AS (SELECT tag_1, tag_2, day, count(a) na, sum(a) sa, min(a) la, max(a) ha, count(b) nb, sum(b) sb, min(b) lb, max(b) hb FROM r
    GROUP BY ALL HAVING count(a) + count(b) > 0),
  span AS (SELECT tag_1, tag_2, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM dly GROUP BY tag_1, tag_2),
  w AS (SELECT * FROM span CROSS JOIN (VALUES (7), (30)) v(window_days))
SELECT w.tag_1, w.tag_2, strftime(w.day, '%Y-%m-%d') AS day, CAST(window_days AS INTEGER) AS window_days, CAST(count(x.day) AS INTEGER) AS active_days,
  CAST(coalesce(sum(na), 0) AS BIGINT) AS field_1_count, min(la) AS field_1_lowest, max(ha) AS field_1_highest,
  CAST(coalesce(sum(nb), 0) AS BIGINT) AS field_2_count, min(lb) AS field_2_lowest, max(hb) AS field_2_highest,
  round(sum(sa), 3) AS field_1_total, round(sum(sa) / nullif(sum(na), 0), 3) AS field_1_average,
  round(sum(sb), 3) AS field_2_total, round(sum(sb) / nullif(sum(nb), 0), 3) AS field_2_average
FROM w LEFT JOIN dly x ON x.tag_1 IS NOT DISTINCT FROM w.tag_1 AND x.tag_2 IS NOT DISTINCT FROM w.tag_2
  AND x.day <= w.day AND x.day > w.day - to_days(CAST(window_days AS INTEGER))
GROUP BY w.tag_1, w.tag_2, w.day, window_days""",
        "p3_rules": """
WITH u AS (SELECT DISTINCT wind_turbine, timestamp, CASE WHEN NOT isnan(wind_speed) THEN wind_speed END AS s, CASE WHEN NOT isnan(wind_direction) THEN wind_direction END AS d
    FROM wind_turbine WHERE timestamp IS NOT NULL),
  v AS (SELECT *, 'wind_speed' AS column_name, s AS x FROM u WHERE s IS NOT NULL UNION ALL SELECT *, 'wind_direction', d FROM u WHERE d IS NOT NULL),
  o AS (SELECT *, row_number() OVER w AS i, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS fresh FROM v
    WINDOW w AS (PARTITION BY wind_turbine, column_name ORDER BY timestamp, s NULLS LAST, d NULLS LAST)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY wind_turbine, column_name ORDER BY i) AS run FROM o),
  n AS (SELECT *, count(*) OVER (PARTITION BY wind_turbine, column_name, run) AS length FROM r)
SELECT DISTINCT wind_turbine, epoch_us(timestamp) AS timestamp_us, column_name, 'stuck' AS kind FROM n WHERE length >= 20
UNION ALL SELECT DISTINCT wind_turbine, epoch_us(timestamp), n.column_name, 'impossible' FROM n
JOIN field_limits l ON l.table_name = 'wind_turbine' AND l.column_name = n.column_name WHERE x < lowest OR x > highest""",
        "p4_found": """
WITH i AS (SELECT tag, field_column, epoch_us(start_time) AS s, epoch_us(end_time) AS e FROM compressed_segments WHERE start_time <= end_time),
  b AS (SELECT *, max(e) OVER (PARTITION BY tag, field_column ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY tag, field_column ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM b),
  p AS (SELECT tag, field_column, part, min(s) AS s, max(e) AS e FROM g GROUP BY ALL),
  n AS (SELECT *, lead(s) OVER (PARTITION BY tag, field_column ORDER BY s) AS following FROM p)
SELECT tag, CAST(field_column AS INTEGER) AS field_column, 'period' AS kind, s AS start_us, e AS end_us FROM n
UNION ALL SELECT tag, CAST(field_column AS INTEGER), 'gap', e, following FROM n WHERE following IS NOT NULL""",
        "p5_found": f"""
WITH {_SLOTS}
SELECT g.wind_turbine, g.slot * 600000000 AS slot_us FROM g ANTI JOIN s ON g.wind_turbine IS NOT DISTINCT FROM s.wind_turbine AND g.slot = s.slot""",
        "p5_slots": f"""
WITH {_SLOTS}
SELECT g.wind_turbine, g.slot * 600000000 AS slot_us, CAST(coalesce(readings, 0) AS INTEGER) AS readings, readings IS NULL AS missing
FROM g LEFT JOIN s ON g.wind_turbine IS NOT DISTINCT FROM s.wind_turbine AND g.slot = s.slot""",
        "p5_filled": f"""
WITH {_SLOTS}
SELECT g.wind_turbine, count(*) AS slots, count(*) - count(readings) AS filled, true AS valued, true AS surer
FROM g LEFT JOIN s ON g.wind_turbine IS NOT DISTINCT FROM s.wind_turbine AND g.slot = s.slot GROUP BY g.wind_turbine""",
        "p6_found": f"WITH {_FILES} SELECT file_id FROM planned WHERE rewrite",
        "p6_plan": f"WITH {_FILES} SELECT * FROM planned",
        "p6_records": f"""
WITH {_FILES},
  held AS (SELECT r.*, p.folder, p.table_name, p.field_column, p.group_index FROM data_folder_records r JOIN planned p USING (file_id))
SELECT record_id, tag, value, folder, table_name, field_column, group_index FROM held
QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY group_index IS NOT NULL, file_id, row_index) = 1""",
        "p6_rewrite": f"""
WITH {_FILES},
  held AS (SELECT r.record_id, p.folder, p.table_name, p.field_column, p.group_index FROM data_folder_records r JOIN planned p USING (file_id)
    QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY group_index IS NOT NULL, file_id, row_index) = 1),
  n AS (SELECT folder, table_name, field_column, group_index, count(*) AS c FROM held WHERE group_index IS NOT NULL GROUP BY ALL),
  k AS (SELECT folder, table_name, field_column, group_index, count(*) AS files FROM planned WHERE rewrite GROUP BY ALL)
SELECT k.folder, k.table_name, k.field_column, k.group_index, k.files, coalesce(n.c, 0) AS records_expected, coalesce(n.c, 0) AS records_written
FROM k LEFT JOIN n ON n.folder = k.folder AND n.table_name IS NOT DISTINCT FROM k.table_name AND n.field_column IS NOT DISTINCT FROM k.field_column AND n.group_index = k.group_index""",
    }
