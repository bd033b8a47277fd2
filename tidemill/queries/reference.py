"""Queries of the engine's own operators over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.dialect import tokenize
from tidemill.engine import DataFolder
from tidemill.functions import shims
from tidemill.plans import scan
from tidemill.runtime import shared_dir
from tidemill.sources import bulk
from tidemill.streaming import ingest as stream

Run = Callable[[SparkSession, str], DataFrame]

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
_folders: dict[tuple[str, str], DataFolder] = {}


def new_folder(spark: SparkSession) -> DataFolder:
    return DataFolder(spark, f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}")


def events(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value").cast("float")
    return spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", value.alias("value"), (F.col("value") * 2).cast("float").alias("twice")).where("ts IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL")


def folder(spark: SparkSession, d: str) -> DataFolder:
    """The test tables as tables of a data folder; made once for a session and directory."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _folders:
        made = new_folder(spark)
        made.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD, twice FIELD, total FIELD AS (value + twice))")
        made.sql("CREATE TIME SERIES TABLE lossy(ts TIMESTAMP, event_type TAG, near FIELD(0.5), part FIELD(5%))")
        made.sql("CREATE TIME SERIES TABLE daily(day TIMESTAMP, status TAG, total FIELD)")
        made.sql("CREATE TIME SERIES TABLE nothing(ts TIMESTAMP, value FIELD)")
        made.sql("CREATE TABLE labels_of(event_type TEXT, label INT)")
        rows = events(spark, d)
        made.write("points", rows)
        made.write("lossy", rows.select("ts", "event_type", "value", "value"))
        orders = spark.read.parquet(f"{d}/orders.parquet").where("o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL")
        made.write("daily", orders.groupBy("o_orderdate", "o_orderstatus").agg(F.count("*").cast("float")))
        made.sql("INSERT INTO labels_of VALUES ('click', 1), ('view', 2), ('purchase', 3), ('none', 4)")
        _folders[key] = made
    return _folders[key]


def on_folder(sql: str) -> Run:
    return lambda spark, d: folder(spark, d).sql(sql)


def relational(sql: str) -> Run:
    """A query over the plain tables."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        shims.register(spark)
        words = {t.text.lower() for t in tokenize(sql)}
        for name in _TABLES:
            if name in words:
                spark.read.parquet(f"{d}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(shims.rewrite(sql))

    return run


# Operations of a data folder


def ts_segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return folder(spark, d).segment_stats("points")


def ts_agg_time_range(spark: SparkSession, d: str) -> DataFrame:
    found = folder(spark, d).read_time_series_table("points", {"event_type": None, "value": "count", "twice": "max"}, ["event_type"], datetime(2024, 1, 5), datetime(2024, 1, 20, 7, 30))
    return found.select("event_type", F.col("COUNT(value)").alias("n"), F.col("MAX(twice)").cast("double").alias("top"))


def ts_lossy_within_bound(spark: SparkSession, d: str) -> DataFrame:
    f = folder(spark, d)
    real = f.frame("points", ["ts", "event_type", "value"])
    both = f.frame("lossy").join(real, ["ts", "event_type"])
    off = F.abs(F.col("value").cast("double") - F.col("near"))
    share = F.abs(F.col("value").cast("double") - F.col("part")) * 100
    return both.agg(F.count("*").alias("points"), F.count_if(off > 0.5).alias("near_wrong"), F.count_if(share > 5 * F.abs("value")).alias("part_wrong"))


def ts_optimize(spark: SparkSession, d: str) -> DataFrame:
    f = new_folder(spark)
    f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
    rows = events(spark, d).select("ts", "event_type", "value")
    for half in (0, 1):
        f.write("points", rows.where(F.pmod(F.minute("ts"), F.lit(2)) == half))
    f.optimize("points")
    return f.sql("SELECT event_type, COUNT(value) AS n, MIN(value) AS low, MAX(value) AS top FROM points GROUP BY event_type").select("event_type", "n", F.col("low").cast("double").alias("low"), F.col("top").cast("double").alias("top"))


def ddl_create_insert_select(spark: SparkSession, d: str) -> DataFrame:
    f = new_folder(spark)
    f.sql("CREATE TABLE people(id INT, name TEXT, height SMALLINT)")
    f.sql("INSERT INTO people VALUES (1, 'Ada', 160), (2, 'Ben', 170)")
    f.sql("INSERT INTO people (name, id) SELECT 'Cy', 3")
    return f.sql("SELECT id, name, height FROM people")


def ddl_truncate(spark: SparkSession, d: str) -> DataFrame:
    f = new_folder(spark)
    f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
    f.write("points", events(spark, d).select("ts", "event_type", "value"))
    f.sql("TRUNCATE points")
    return f.sql("SELECT COUNT(value) AS n FROM points")


def ddl_drop(spark: SparkSession, d: str) -> DataFrame:
    f = new_folder(spark)
    f.sql("CREATE TABLE one(id INT)")
    f.sql("CREATE TABLE two(id INT)")
    f.sql("DROP TABLE one")
    return f.spark.createDataFrame([(n,) for n in f.tables()], "name string")


def ddl_vacuum(spark: SparkSession, d: str) -> DataFrame:
    f = new_folder(spark)
    f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
    rows = events(spark, d).select("ts", "event_type", "value")
    f.write("points", rows)
    f.sql("TRUNCATE points")
    f.write("points", rows)
    f.sql("VACUUM points RETAIN 0")
    left = len(f.files.list("tables/points/data"))
    return f.sql("SELECT COUNT(value) AS n FROM points").select("n", F.lit(left).alias("commits"))


def include_union(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for half in (0, 1):
        f = new_folder(spark)
        f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
        f.write("points", events(spark, d).select("ts", "event_type", "value").where(F.pmod(F.minute("ts"), F.lit(2)) == half))
        parts.append(f)
    return parts[0].sql(f"INCLUDE '{parts[1].url}' SELECT ts, event_type, value FROM points").select("ts", "event_type", F.col("value").cast("double").alias("value"))


def copy_move(spark: SparkSession, d: str) -> DataFrame:
    source, target = folder(spark, d), new_folder(spark)
    target.sql("CREATE TIME SERIES TABLE kept(ts TIMESTAMP, event_type TAG, value FIELD, twice FIELD, total FIELD AS (value + twice))")
    target.sql("CREATE TIME SERIES TABLE moved(ts TIMESTAMP, event_type TAG, value FIELD, twice FIELD, total FIELD AS (value + twice))")
    target.sql("CREATE TABLE plain(event_type TEXT, n BIGINT)")
    source.copy_time_series_table("points", target, "kept", tags={"event_type": "click"})
    target.move("kept", target, "moved")
    source.copy("SELECT event_type, COUNT(value) AS n FROM points GROUP BY event_type", target, "plain")
    counts = [("kept", target.frame("kept").count()), ("moved", target.frame("moved").count()), ("plain", target.sql("SELECT sum(n) AS n FROM plain").first()["n"])]
    return spark.createDataFrame(counts, "name string, n bigint")


def copy_range(spark: SparkSession, d: str) -> DataFrame:
    """Copies of a range, of a table with one field and of one with two: points, and whether all copied segments lie in it.

    The range ends outside the data, so that all segments lie in it; `copied_part` cuts through chunks."""
    source, target = folder(spark, d), new_folder(spark)
    parts = []
    for name, fields in (("one", "value FIELD"), ("two", "value FIELD, twice FIELD")):
        for f in (source, target):
            if name not in f.tables():
                f.sql(f"CREATE TIME SERIES TABLE {name}(ts TIMESTAMP, event_type TAG, {fields})")
        if not source.segments(name).take(1):
            rows = events(spark, d)
            source.write(name, rows if name == "two" else rows.drop("twice"))
        source.copy_time_series_table(name, target, name, datetime(2023, 12, 31), datetime(2024, 2, 15))
        spans = target.segments(name).agg((F.min("start_us") >= scan.micros(datetime(2023, 12, 31))) & (F.max("end_us") <= scan.micros(datetime(2024, 2, 15))))
        parts.append((name, target.frame(name).count(), spans.first()[0]))
    return spark.createDataFrame(parts, "field string, n bigint, whole boolean")


def copied_part(spark: SparkSession, d: str) -> DataFrame:
    """A copy whose range cuts chunks: exactly the points that lie in segments of the range for both fields."""
    source, target = folder(spark, d), new_folder(spark)
    target.sql("CREATE TIME SERIES TABLE part(ts TIMESTAMP, event_type TAG, value FIELD, twice FIELD)")
    low, high = datetime(2024, 1, 5), datetime(2024, 1, 20, 7, 30)
    source.copy_time_series_table("points", target, "part", low, high)
    found = target.frame("part").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    inside = source.segments("points").where((F.col("start_us") >= scan.micros(low)) & (F.col("end_us") <= scan.micros(high)))
    least = inside.where(F.col("field_column") == source.table("points").index("value")).agg(F.sum("n_points").alias("m"))
    return found.join(least).select(((F.col("n") > 0) & (F.col("n") <= F.col("m"))).alias("some"), (F.col("a") >= F.lit(low).cast("timestamp_ntz")).alias("after"), (F.col("b") <= F.lit(high).cast("timestamp_ntz")).alias("before"))


def insert_series(spark: SparkSession, d: str) -> DataFrame:
    f = new_folder(spark)
    f.sql("CREATE TIME SERIES TABLE chosen(ts TIMESTAMP, event_type TAG, value FIELD)")
    f.sql("CREATE TABLE plain(ts TIMESTAMP, event_type TEXT, value REAL)")
    f.write("plain", events(spark, d).drop("twice"))
    f.sql("INSERT INTO chosen SELECT ts, event_type, value FROM plain WHERE value > 50")
    return f.sql("SELECT event_type, COUNT(value) AS n, MAX(value) AS top FROM chosen GROUP BY event_type").select("event_type", "n", F.col("top").cast("double").alias("top"))


def late_and_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Every point twice, the second time late and out of order: all are kept."""
    f = new_folder(spark)
    f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
    rows = events(spark, d).drop("twice")
    f.write("points", rows.orderBy(F.col("ts").desc()))
    f.write("points", rows)
    return f.sql("SELECT event_type, COUNT(*) AS n, ROUND(SUM(CAST(value AS DOUBLE)), 1) AS total FROM points GROUP BY event_type")


def stream_small_batches(spark: SparkSession, d: str) -> DataFrame:
    """A stream in eight batches: rows wait until there are enough, so segments don't come from single batches."""
    f = new_folder(spark)
    f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events(spark, d).drop("twice").repartition(8).write.parquet(f"{base}/in")
    source = spark.readStream.schema("ts timestamp_ntz, event_type string, value float").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream.start(source, f, "points", f"{base}/checkpoint", hold=1 << 30).awaitTermination()
    f.flush("points")
    # A chunk for each series and week.
    weeks = F.floor(F.unix_date(F.to_date("ts")) / 7)
    wanted = f.frame("points").select("event_type", weeks).distinct().count()
    few = f.segments("points").select("chunk").distinct().count() <= wanted
    found = f.sql("SELECT event_type, COUNT(value) AS n, MAX(value) AS top FROM points GROUP BY event_type")
    return found.select("event_type", "n", F.col("top").cast("double").alias("top"), F.lit(few).alias("few"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    f = new_folder(spark)
    f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events(spark, d).select("ts", "event_type", "value").repartition(4).write.parquet(f"{base}/in")
    source = spark.readStream.schema("ts timestamp_ntz, event_type string, value float").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    for _ in range(2):
        # The second run finds everything committed.
        stream.start(source, f, "points", f"{base}/checkpoint").awaitTermination()
    return f.sql("SELECT event_type, COUNT(value) AS n, MAX(value) AS top FROM points GROUP BY event_type").select("event_type", "n", F.col("top").cast("double").alias("top"))


def stream_transfer(spark: SparkSession, d: str) -> DataFrame:
    edge, cloud = new_folder(spark), new_folder(spark)
    for f in (edge, cloud):
        f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
    edge.write("points", events(spark, d).select("ts", "event_type", "value"))
    stream.transfer(edge, cloud, "points", least_bytes=1)
    return spark.createDataFrame([("edge", edge.frame("points").count()), ("cloud", cloud.frame("points").count())], "folder string, n bigint")


def bulk_import_export(spark: SparkSession, d: str) -> DataFrame:
    f = new_folder(spark)
    out = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    bulk.export_table(folder(spark, d), "SELECT ts, event_type, value FROM points", out, ["event_type"])
    f.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, event_type TAG, value FIELD)")
    bulk.import_parquet(f, "points", out, {"ts": "ts", "event_type": "event_type", "value": "value"})
    return f.sql("SELECT event_type, COUNT(value) AS n, MIN(value) AS low FROM points GROUP BY event_type").select("event_type", "n", F.col("low").cast("double").alias("low"))


def ts_grouped_by_hour(spark: SparkSession, d: str) -> DataFrame:
    rows = folder(spark, d).frame("points", ["ts", "value"])
    return rows.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.max("value").cast("double").alias("top"))


def ts_two_paths(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates from segments beside those from points, as differences."""
    f = folder(spark, d)
    table = f.table("points")
    fast = scan.aggregate(f.segments("points"), table, [("count", "value", "n"), ("min", "value", "a"), ("max", "value", "b"), ("sum", "value", "s")]).toDF("n1", "a1", "b1", "s1")
    slow = f.frame("points", ["value"]).agg(F.count("value"), F.min("value"), F.max("value"), F.sum("value")).toDF("n2", "a2", "b2", "s2")
    close = F.abs(F.col("s1") - F.col("s2")) <= 1e-5 * F.abs("s2")
    return fast.join(slow).select((F.col("n1") - F.col("n2")).alias("n"), (F.col("a1") == F.col("a2")).alias("low"), (F.col("b1") == F.col("b2")).alias("top"), close.alias("total"))


_EVENTS = "(SELECT ts, event_type, CAST(value AS FLOAT) AS value, CAST(value * 2 AS FLOAT) AS twice FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL) p"
_D = "CAST({} AS DOUBLE)"

#: Name, the engine's SQL, DuckDB's; both over the same points.
_FOLDER_SQL: dict[str, tuple[str, str]] = {
    "ts_scan_single_field": ("SELECT ts, event_type, CAST(value AS DOUBLE) AS value FROM points", f"SELECT ts, event_type, CAST(value AS DOUBLE) AS value FROM {_EVENTS}"),
    "ts_scan_multi_field": ("SELECT ts, event_type, CAST(value AS DOUBLE) AS value, CAST(twice AS DOUBLE) AS twice FROM points", f"SELECT ts, event_type, CAST(value AS DOUBLE) AS value, CAST(twice AS DOUBLE) AS twice FROM {_EVENTS}"),
    "ts_scan_timestamp_only": ("SELECT ts FROM points", f"SELECT ts FROM {_EVENTS}"),
    "ts_projection_order": ("SELECT CAST(twice AS DOUBLE) AS twice, event_type, ts FROM points", f"SELECT CAST(twice AS DOUBLE) AS twice, event_type, ts FROM {_EVENTS}"),
    "ts_tag_filter": ("SELECT ts, CAST(value AS DOUBLE) AS value FROM points WHERE event_type = 'click'", f"SELECT ts, CAST(value AS DOUBLE) AS value FROM {_EVENTS} WHERE event_type = 'click'"),
    "ts_time_gt": ("SELECT ts FROM points WHERE ts > TIMESTAMP '2024-01-10 12:00:00'", f"SELECT ts FROM {_EVENTS} WHERE ts > TIMESTAMP '2024-01-10 12:00:00'"),
    "ts_time_ge": ("SELECT ts FROM points WHERE ts >= TIMESTAMP '2024-01-10 12:00:00'", f"SELECT ts FROM {_EVENTS} WHERE ts >= TIMESTAMP '2024-01-10 12:00:00'"),
    "ts_time_lt": ("SELECT ts FROM points WHERE ts < TIMESTAMP '2024-01-10 12:00:00'", f"SELECT ts FROM {_EVENTS} WHERE ts < TIMESTAMP '2024-01-10 12:00:00'"),
    "ts_time_le": ("SELECT ts FROM points WHERE ts <= TIMESTAMP '2024-01-10 12:00:00'", f"SELECT ts FROM {_EVENTS} WHERE ts <= TIMESTAMP '2024-01-10 12:00:00'"),
    "ts_time_eq": ("SELECT ts, event_type FROM points WHERE ts = (SELECT min(ts) FROM points)", f"SELECT ts, event_type FROM {_EVENTS} WHERE ts = (SELECT min(ts) FROM events)"),
    "ts_time_eq_literal": (
        "SELECT day, status, CAST(total AS BIGINT) AS total FROM daily WHERE day = TIMESTAMP '1995-03-01 00:00:00'",
        "SELECT o_orderdate AS day, o_orderstatus AS status, count(*) AS total FROM orders WHERE o_orderdate = TIMESTAMP '1995-03-01 00:00:00' AND o_orderstatus IS NOT NULL GROUP BY ALL",
    ),
    "ts_sub_scalar": (
        "SELECT COUNT(*) AS n FROM points WHERE ts >= TIMESTAMP '2024-01-20' AND value > (SELECT AVG(value) FROM points)",
        f"WITH e AS (SELECT * FROM {_EVENTS}) SELECT count(*) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-20' AND value > (SELECT avg(CAST(value AS DOUBLE)) FROM e)",
    ),
    "ts_sub_value": (
        "SELECT COUNT(*) AS n FROM points WHERE value > 150 AND (SELECT MIN(value) FROM points) < 100",
        f"WITH e AS (SELECT * FROM {_EVENTS}) SELECT count(*) AS n FROM e WHERE value > 150 AND (SELECT min(value) FROM e) < 100",
    ),
    "ts_sub_exists": (
        "SELECT COUNT(*) AS n FROM points WHERE ts > TIMESTAMP '2024-01-20' AND EXISTS (SELECT 1 FROM points WHERE ts < TIMESTAMP '2024-01-02')",
        f"WITH e AS (SELECT * FROM {_EVENTS}) SELECT count(*) AS n FROM e WHERE ts > TIMESTAMP '2024-01-20' AND EXISTS (SELECT 1 FROM e WHERE ts < TIMESTAMP '2024-01-02')",
    ),
    "ts_sub_select_list": (
        "SELECT (SELECT MIN(ts) FROM points) AS first, COUNT(*) AS n FROM points WHERE ts > TIMESTAMP '2024-01-20'",
        f"WITH e AS (SELECT * FROM {_EVENTS}) SELECT (SELECT min(ts) FROM e) AS first, count(*) AS n FROM e WHERE ts > TIMESTAMP '2024-01-20'",
    ),
    "ts_sub_cte": (
        "WITH late AS (SELECT event_type, value FROM points WHERE ts > TIMESTAMP '2024-01-25'), early AS (SELECT event_type, MAX(value) AS top FROM points WHERE ts < TIMESTAMP '2024-01-05' GROUP BY event_type) SELECT event_type, COUNT(*) AS n FROM late JOIN early USING (event_type) WHERE value > top - 5 OR value > (SELECT AVG(value) FROM points) GROUP BY event_type",
        f"WITH e AS (SELECT * FROM {_EVENTS}), late AS (SELECT event_type, value FROM e WHERE ts > TIMESTAMP '2024-01-25'), early AS (SELECT event_type, max(value) AS top FROM e WHERE ts < TIMESTAMP '2024-01-05' GROUP BY event_type) SELECT event_type, count(*) AS n FROM late JOIN early USING (event_type) WHERE value > CAST(top AS FLOAT) - 5 OR value > (SELECT avg(CAST(value AS DOUBLE)) FROM e) GROUP BY event_type",
    ),
    "ts_sub_union": (
        "SELECT 'late' AS part, COUNT(*) AS n FROM points WHERE ts >= TIMESTAMP '2024-01-29' UNION ALL SELECT 'small', COUNT(*) FROM points WHERE value < 10",
        f"WITH e AS (SELECT * FROM {_EVENTS}) SELECT 'late' AS part, count(*) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-29' UNION ALL SELECT 'small', count(*) FROM e WHERE value < 10",
    ),
    "ts_time_between": (
        "SELECT ts, CAST(value AS DOUBLE) AS value FROM points WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'",
        f"SELECT ts, CAST(value AS DOUBLE) AS value FROM {_EVENTS} WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'",
    ),
    "ts_time_literal_left": (
        "SELECT ts FROM points WHERE TIMESTAMP '2024-01-05' < ts AND TIMESTAMP '2024-01-06' >= ts",
        f"SELECT ts FROM {_EVENTS} WHERE TIMESTAMP '2024-01-05' < ts AND TIMESTAMP '2024-01-06' >= ts",
    ),
    "ts_time_or": (
        "SELECT ts FROM points WHERE ts < TIMESTAMP '2024-01-03' OR ts > TIMESTAMP '2024-01-28'",
        f"SELECT ts FROM {_EVENTS} WHERE ts < TIMESTAMP '2024-01-03' OR ts > TIMESTAMP '2024-01-28'",
    ),
    "ts_field_filter": ("SELECT ts, CAST(value AS DOUBLE) AS value FROM points WHERE value > 100", f"SELECT ts, CAST(value AS DOUBLE) AS value FROM {_EVENTS} WHERE value > 100"),
    "ts_generated_column": ("SELECT ts, event_type, ROUND(CAST(total AS DOUBLE), 2) AS total FROM points", f"SELECT ts, event_type, round(CAST(value + twice AS DOUBLE), 2) AS total FROM {_EVENTS}"),
    "ts_generated_filter": ("SELECT ts FROM points WHERE total > 300", f"SELECT ts FROM {_EVENTS} WHERE CAST(value + twice AS FLOAT) > 300"),
    "ts_count": ("SELECT COUNT(value) AS n FROM points", f"SELECT count(value) AS n FROM {_EVENTS}"),
    "ts_count_star": ("SELECT COUNT(*) AS n FROM points", f"SELECT count(*) AS n FROM {_EVENTS}"),
    "ts_min": ("SELECT CAST(MIN(value) AS DOUBLE) AS x FROM points", f"SELECT CAST(min(value) AS DOUBLE) AS x FROM {_EVENTS}"),
    "ts_max": ("SELECT CAST(MAX(value) AS DOUBLE) AS x FROM points", f"SELECT CAST(max(value) AS DOUBLE) AS x FROM {_EVENTS}"),
    "ts_sum": ("SELECT ROUND(SUM(value), 2) AS x FROM points", f"SELECT round(sum(CAST(value AS DOUBLE)), 2) AS x FROM {_EVENTS}"),
    "ts_avg": ("SELECT ROUND(AVG(value), 4) AS x FROM points", f"SELECT round(avg(CAST(value AS DOUBLE)), 4) AS x FROM {_EVENTS}"),
    "ts_sum_expression": ("SELECT ROUND(SUM(value * 2), 1) AS x FROM points", f"SELECT round(sum(CAST(value * 2 AS DOUBLE)), 1) AS x FROM {_EVENTS}"),
    "ts_count_distinct": ("SELECT COUNT(DISTINCT value) AS n FROM points", f"SELECT count(DISTINCT value) AS n FROM {_EVENTS}"),
    "ts_agg_empty": ("SELECT COUNT(value) AS n, CAST(MIN(value) AS DOUBLE) AS low, SUM(value) AS total, AVG(value) AS middle FROM nothing", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS middle"),
    "ts_irregular_daily": ("SELECT day, status, CAST(total AS BIGINT) AS total FROM daily", "SELECT o_orderdate AS day, o_orderstatus AS status, count(*) AS total FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY ALL"),
    "ts_limit_topk": ("SELECT ts, CAST(value AS DOUBLE) AS value FROM points ORDER BY value DESC, ts LIMIT 10", f"SELECT ts, CAST(value AS DOUBLE) AS value FROM {_EVENTS} ORDER BY value DESC, ts LIMIT 10"),
    "ts_join_dimension": (
        "SELECT label, COUNT(*) AS n, ROUND(SUM(CAST(value AS DOUBLE)), 2) AS total FROM points JOIN labels_of USING (event_type) GROUP BY label",
        f"SELECT label, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 2) AS total FROM {_EVENTS} JOIN (VALUES ('click', 1), ('view', 2), ('purchase', 3), ('none', 4)) l(event_type, label) USING (event_type) GROUP BY label",
    ),
    "ts_self_join_whole": (
        "SELECT a.event_type, COUNT(*) AS n FROM points a JOIN points b ON a.event_type = b.event_type AND a.ts = b.ts GROUP BY a.event_type",
        f"WITH e AS (SELECT * FROM {_EVENTS}) SELECT a.event_type, count(*) AS n FROM e a JOIN e b ON a.event_type = b.event_type AND a.ts = b.ts GROUP BY a.event_type",
    ),
    "metadata_tables": ("SELECT table_name, column_name, error_bound_is_relative AS is_relative FROM metadata.time_series_table_field_columns WHERE table_name = 'lossy'", "SELECT * FROM (VALUES ('lossy', 'near', false), ('lossy', 'part', true)) t(table_name, column_name, is_relative)"),
}

#: Queries over plain tables: the engine's SQL, and DuckDB's where it differs.
_PLAIN_SQL: dict[str, tuple[str, str | None]] = {
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", None),
    "join_left": ("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey", None),
    "join_right": ("SELECT c_custkey, COUNT(o_orderkey) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey", None),
    "join_full": ("SELECT n_nationkey, COUNT(s_suppkey) AS n FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0 GROUP BY n_nationkey", None),
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey"),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_using": ("SELECT n_nationkey, COUNT(*) AS n FROM (SELECT s_nationkey AS n_nationkey FROM supplier) s JOIN nation USING (n_nationkey) GROUP BY n_nationkey", None),
    "join_natural": ("SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r", None),
    "join_range": ("SELECT p_size, COUNT(*) AS n FROM (SELECT DISTINCT p_size FROM part) p JOIN nation ON n_nationkey BETWEEN p_size - 1 AND p_size + 1 GROUP BY p_size", None),
    "join_lateral": ("SELECT n_name, top FROM nation, LATERAL (SELECT max(s_acctbal) AS top FROM supplier WHERE s_nationkey = n_nationkey) s", None),
    "join_unnest": ("SELECT n_nationkey, x FROM nation, UNNEST(generate_series(1, n_regionkey + 1)) AS u(x)", "SELECT n_nationkey, unnest(generate_series(1, n_regionkey + 1)) AS x FROM nation"),
    "join_cross_unnest": ("SELECT n_nationkey, x FROM nation CROSS JOIN UNNEST([n_regionkey, 7]) AS u(x)", "SELECT n_nationkey, unnest([n_regionkey, 7]) AS x FROM nation"),
    "join_right_semi": ("SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "join_right_anti": ("SELECT c_custkey FROM orders RIGHT ANTI JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000"),
    "join_merge": ("SELECT /*+ MERGE(customer) */ o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_broadcast": ("SELECT /*+ BROADCAST(nation) */ c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "agg_distinct": ("SELECT COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_returnflag) AS flags FROM lineitem", None),
    "agg_grouping_sets": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "agg_cube": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5", None),
    "agg_filter": ("SELECT COUNT(*) FILTER (WHERE l_quantity > 25) AS big, ROUND(SUM(l_discount) FILTER (WHERE l_returnflag = 'R'), 2) AS discount FROM lineitem", None),
    "agg_all": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL", None),
    "agg_stats": (
        "SELECT l_returnflag, ROUND(var_samp(l_quantity), 4) AS vs, ROUND(var_pop(l_quantity), 4) AS vp, ROUND(stddev_samp(l_quantity), 4) AS ss, ROUND(stddev_pop(l_quantity), 4) AS sp, ROUND(covar_samp(l_quantity, l_discount), 4) AS cs, ROUND(covar_pop(l_quantity, l_discount), 4) AS cp, ROUND(corr(l_quantity, l_extendedprice), 4) AS c FROM lineitem GROUP BY l_returnflag",
        None,
    ),
    "agg_regression": (
        "SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 3) AS slope, ROUND(regr_intercept(l_extendedprice, l_quantity), 1) AS base, regr_count(l_extendedprice, l_quantity) AS n, ROUND(regr_r2(l_extendedprice, l_quantity), 5) AS r2, ROUND(regr_avgx(l_extendedprice, l_quantity), 3) AS ax FROM lineitem",
        None,
    ),
    "agg_bool_bit": ("SELECT bool_and(l_quantity > 0) AS every_one, bool_or(l_quantity > 49) AS any_one, bit_and(l_linenumber) AS a, bit_or(l_linenumber) AS o, bit_xor(l_linenumber) AS x FROM lineitem", None),
    "agg_median": ("SELECT l_returnflag, ROUND(median(l_quantity), 3) AS middle, ROUND(percentile_cont(l_extendedprice, 0.9), 2) AS high FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(median(l_quantity), 3) AS middle, round(quantile_cont(l_extendedprice, 0.9), 2) AS high FROM lineitem GROUP BY l_returnflag"),
    "agg_array_ordered": (
        "SELECT n_regionkey, array_join(array_agg(n_name ORDER BY n_nationkey DESC), ',') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_array_mixed": (
        "SELECT n_regionkey, array_join(array_agg(n_name ORDER BY n_nationkey % 2 DESC, n_name ASC), ',') AS names, nth_value(n_name, 2 ORDER BY n_name DESC) AS second FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey % 2 DESC, n_name ASC) AS names, (list(n_name ORDER BY n_name DESC))[2] AS second FROM nation GROUP BY n_regionkey",
    ),
    "agg_string": ("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "agg_approx_distinct": ("SELECT abs(approx_distinct(o_custkey) - COUNT(DISTINCT o_custkey)) <= 0.1 * COUNT(DISTINCT o_custkey) AS near, COUNT(*) AS n FROM orders", "SELECT true AS near, count(*) AS n FROM orders"),
    "agg_approx_percentile": (
        "SELECT l_returnflag, approx_percentile_cont(l_quantity, 0.5) BETWEEN percentile_cont(l_quantity, 0.48) AND percentile_cont(l_quantity, 0.52) AS middle, approx_median(l_quantity) BETWEEN percentile_cont(l_quantity, 0.48) AND percentile_cont(l_quantity, 0.52) AS median, approx_percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) BETWEEN percentile_cont(l_quantity, 0.88) AND percentile_cont(l_quantity, 0.92) AS high, approx_percentile_cont_with_weight(l_quantity, l_linenumber, 0.5) IS NOT NULL AS weighted FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, true AS middle, true AS median, true AS high, true AS weighted FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_first_last": ("SELECT o_custkey, first_value(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last_value(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY o_custkey"),
    "win_rank": (
        "SELECT s_suppkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ROUND(percent_rank() OVER w, 6) AS pr, ROUND(cume_dist() OVER w, 6) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)",
        None,
    ),
    "win_ntile": ("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quarter FROM customer", None),
    "win_lag_lead": ("SELECT o_orderkey, lag(o_orderkey) OVER w AS a, lead(o_orderkey, 2) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "win_first_last_nth": (
        "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        None,
    ),
    "win_ignore_nulls": (
        "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM orders",
        "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM orders",
    ),
    "win_rows_frame": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM orders", None),
    "win_range_frame": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS n FROM orders", None),
    "win_groups_frame": (
        "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part",
        "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part",
    ),
    "win_agg_over": ("SELECT s_suppkey, ROUND(SUM(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS total, MAX(s_acctbal) OVER () AS top FROM supplier", None),
    "qualify_cte": (
        "WITH top AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) <= 2) SELECT o_custkey, COUNT(*) AS n FROM top WHERE o_orderkey IN (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) > 1) GROUP BY o_custkey",
        None,
    ),
    "qualify_rewrite": ("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", None),
    "set_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "set_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "set_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "set_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", None),
    "set_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "set_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "sort_nulls": ("SELECT n, k FROM (SELECT o_orderkey AS n, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey END AS k FROM orders) t ORDER BY k ASC NULLS LAST, n DESC LIMIT 50", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", None),
    "values_rows": ("SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) t(a, b)", None),
    "sub_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
    "sub_correlated": ("SELECT o_orderkey FROM orders a WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)", None),
    "sub_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", None),
    "sub_in": ("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    "sub_not_in": ("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    "cte": ("WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey FROM big WHERE t > 500000", None),
    "cte_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", None),
    "pred_misc": (
        "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (11, 12, 13) THEN 'middle' ELSE 'large' END AS size, p_name ILIKE '%A%' AS has_a, p_brand IS DISTINCT FROM 'Brand#11' AS other, CAST(p_retailprice AS INT) IS NOT NULL AS priced FROM part",
        None,
    ),
    "pred_similar": ("SELECT p_partkey, p_brand SIMILAR TO 'Brand.%' AS dot, p_name ~* 'A' AS a FROM part WHERE p_brand SIMILAR TO 'Brand#[1-3][1-5]' AND p_brand ~ '#'", "SELECT p_partkey, false AS dot, regexp_matches(p_name, 'A', 'i') AS a FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3][1-5]')"),
    "pred_cast_sign": ("SELECT o_orderkey::STRING AS k, '7'::INT + 1 AS n FROM orders", "SELECT o_orderkey::VARCHAR AS k, '7'::INT + 1 AS n FROM orders"),
    "fn_math": (
        "SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_size, 6) AS l, ROUND(sqrt(p_retailprice), 4) AS q, ROUND(ln(p_retailprice), 4) AS ln, ROUND(log10(p_retailprice), 4) AS lg, floor(p_retailprice) AS fl, ceil(p_retailprice) AS ce, signum(p_size - 25) AS sg, ROUND(power(p_size, 2), 1) AS pw, ROUND(atan2(p_size, 3), 5) AS at, ROUND(degrees(1), 4) AS dg, ROUND(radians(p_size), 5) AS ra, iszero(p_size - 7) AS z, trunc(p_retailprice, 1) AS tr, trunc(-p_retailprice) AS tn, ROUND(log(p_retailprice), 4) AS lo, ROUND(cbrt(p_size), 5) AS cb FROM part",
        "SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_size, 6) AS l, round(sqrt(p_retailprice), 4) AS q, round(ln(p_retailprice), 4) AS ln, round(log10(p_retailprice), 4) AS lg, CAST(floor(p_retailprice) AS BIGINT) AS fl, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(sign(p_size - 25) AS DOUBLE) AS sg, round(power(p_size, 2), 1) AS pw, round(atan2(p_size, 3), 5) AS at, round(degrees(1), 4) AS dg, round(radians(p_size), 5) AS ra, p_size = 7 AS z, floor(p_retailprice * 10) / 10 AS tr, -floor(p_retailprice) AS tn, round(log10(p_retailprice), 4) AS lo, round(cbrt(p_size), 5) AS cb FROM part",
    ),
    "fn_string": (
        "SELECT n_nationkey, upper(n_name) AS u, initcap(lower(n_name)) AS i, left(n_name, 2) AS l, right(n_name, 2) AS r, lpad(n_name, 12, '.') AS lp, repeat('ab', 2) AS rp, replace(n_name, 'A', 'a') AS re, reverse(n_name) AS rv, strpos(n_name, 'N') AS sp, substr(n_name, 2, 3) AS ss, split_part('a-b-c', '-', 2) AS pt, starts_with(n_name, 'N') AS st, ends_with(n_name, '1') AS en, to_hex(n_nationkey) AS hx, btrim('  x ') AS tr, translate(n_name, 'N', 'M') AS tl, levenshtein(n_name, 'NATION') AS lv, char_length(n_name) AS n, concat_ws('-', n_name, 'z') AS cw, ascii(n_name) AS ac FROM nation",
        "SELECT n_nationkey, upper(n_name) AS u, upper(n_name[1]) || lower(substr(n_name, 2)) AS i, left(n_name, 2) AS l, right(n_name, 2) AS r, lpad(n_name, 12, '.') AS lp, repeat('ab', 2) AS rp, replace(n_name, 'A', 'a') AS re, reverse(n_name) AS rv, strpos(n_name, 'N') AS sp, substr(n_name, 2, 3) AS ss, split_part('a-b-c', '-', 2) AS pt, starts_with(n_name, 'N') AS st, ends_with(n_name, '1') AS en, lower(to_hex(n_nationkey)) AS hx, trim('  x ') AS tr, translate(n_name, 'N', 'M') AS tl, levenshtein(n_name, 'NATION') AS lv, length(n_name) AS n, concat_ws('-', n_name, 'z') AS cw, ascii(n_name) AS ac FROM nation",
    ),
    "fn_regex": (
        "SELECT p_partkey, regexp_like(p_brand, '#1') AS l, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS r, regexp_replace(p_brand, '[0-9]', 'x') AS f, regexp_replace(p_brand, '([a-z]+)#(.)', '\\2-\\1') AS b, regexp_match(p_brand, '#([0-9])([0-9])')[1] AS m, regexp_count(p_brand, '[0-9]') AS c, regexp_instr(p_brand, '#') AS i FROM part",
        "SELECT p_partkey, regexp_matches(p_brand, '#1') AS l, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS r, regexp_replace(p_brand, '[0-9]', 'x') AS f, regexp_replace(p_brand, '([a-z]+)#(.)', '\\2-\\1') AS b, nullif(regexp_extract(p_brand, '#([0-9])([0-9])', 1), '') AS m, CAST(len(regexp_extract_all(p_brand, '[0-9]')) AS INTEGER) AS c, CAST(strpos(p_brand, '#') AS INTEGER) AS i FROM part",
    ),
    "fn_date": (
        "SELECT o_orderkey, date_part('year', o_orderdate) AS y, date_trunc('month', o_orderdate) AS m, CAST(make_date(2024, 2, 29) AS STRING) AS d, datediff(o_orderdate, DATE '1992-01-01') AS n, to_char(o_orderdate, '%Y-%m-%d') AS t, to_char(o_orderdate, '%d.%m.%y %H:%M, day %j') AS u, CAST(to_date('17/05/2024', '%d/%m/%Y') AS STRING) AS p, date_part('epoch', o_orderdate) AS ep, date_part('dow', o_orderdate) AS dw, extract(doy FROM o_orderdate) AS dy, o_orderdate + INTERVAL '1' DAY AS later FROM orders",
        "SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(make_date(2024, 2, 29) AS VARCHAR) AS d, CAST(date_diff('day', DATE '1992-01-01', o_orderdate) AS INTEGER) AS n, strftime(o_orderdate, '%Y-%m-%d') AS t, strftime(o_orderdate, '%d.%m.%y %H:%M, day %j') AS u, '2024-05-17' AS p, date_part('epoch', o_orderdate) AS ep, CAST(date_part('dow', o_orderdate) AS INTEGER) AS dw, CAST(date_part('doy', o_orderdate) AS INTEGER) AS dy, o_orderdate + INTERVAL 1 DAY AS later FROM orders",
    ),
    "fn_date_bin": ("SELECT date_bin(INTERVAL '15 minutes', ts) AS slot, COUNT(*) AS n FROM events GROUP BY ALL", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01 00:00:00') AS slot, count(*) AS n FROM events GROUP BY ALL"),
    "fn_array": (
        "SELECT n_nationkey, array_length(make_array(1, 2, n_nationkey)) AS n, array_has(make_array(1, 2), n_nationkey) AS h, array_to_string(array_sort(make_array(n_name, 'B', 'A')), '+') AS s, array_to_string(array_distinct(make_array('a', 'b', 'a')), '') AS d, array_position(make_array('x', 'y'), 'y') AS p, array_to_string(string_to_array('a.b', '.'), '|') AS w, array_max(make_array(3, n_regionkey)) AS m, array_length(flatten(make_array(make_array(1), make_array(2, 3)))) AS f FROM nation",
        "SELECT n_nationkey, CAST(3 AS INTEGER) AS n, list_contains([1, 2], n_nationkey) AS h, array_to_string(list_sort([n_name, 'B', 'A']), '+') AS s, 'ab' AS d, CAST(2 AS BIGINT) AS p, array_to_string(string_split('a.b', '.'), '|') AS w, greatest(3, n_regionkey) AS m, CAST(3 AS INTEGER) AS f FROM nation",
    ),
    "fn_array_more": (
        "SELECT n_nationkey, array_has_all([1, 2, n_regionkey], [2, 3]) AS ha, array_to_string(array_slice(['a', 'b', n_name, 'd'], 2, 3), ',') AS sl, array_to_string(array_pop_back(['a', n_name, 'b']), ',') AS pb, array_to_string(array_pop_front(['a', n_name]), ',') AS pf, array_length(array_positions([1, n_regionkey, 1], 1)) AS ps, array_to_string(array_resize([n_name], 3, 'z'), ',') AS rs, array_length(range(0, n_nationkey, 3)) AS rg, array_to_string(array_remove(['x', n_name, 'x'], 'x'), ',') AS rm, array_to_string(array_replace_all(['x', n_name, 'x'], 'x', 'y'), ',') AS rp, array_distance([1.0, n_regionkey], [4.0, n_regionkey + 4]) AS di, [n_nationkey, 5][1] AS br FROM nation",
        "SELECT n_nationkey, n_regionkey = 3 AS ha, 'b,' || n_name AS sl, 'a,' || n_name AS pb, n_name AS pf, CAST(CASE WHEN n_regionkey = 1 THEN 3 ELSE 2 END AS INTEGER) AS ps, n_name || ',z,z' AS rs, CAST(len(range(0, n_nationkey, 3)) AS INTEGER) AS rg, n_name || ',x' AS rm, 'y,' || n_name || ',y' AS rp, 5.0::DOUBLE AS di, n_nationkey AS br FROM nation",
    ),
    "fn_map": (
        "SELECT n_nationkey, element_at(map(['a', 'b'], [n_nationkey, 2]), 'a') AS a, array_join(map_keys(MAP {'a': 1, 'b': 2}), ',') AS k, get_field(named_struct('y', n_name), 'y') AS y, named_struct('x', n_regionkey).x AS x, element_at(map_from_arrays(array('p'), array(n_name)), 'p') AS p FROM nation",
        "SELECT n_nationkey, n_nationkey AS a, 'a,b' AS k, n_name AS y, n_regionkey AS x, n_name AS p FROM nation",
    ),
    "fn_conditional": ("SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), -1) AS c, greatest(n_nationkey, n_regionkey, 5) AS g, least(n_nationkey, 3) AS l, nvl(NULL, n_name) AS v, nvl2(n_name, 1, 2) AS w FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), -1) AS c, greatest(n_nationkey, n_regionkey, 5) AS g, least(n_nationkey, 3) AS l, n_name AS v, 1 AS w FROM nation"),
    "fn_hash": ("SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, digest(n_name, 'sha256') AS g, arrow_cast(n_regionkey, 'Int64') AS ac, hex(encode(n_name, 'utf-8')) AS h FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, sha256(n_name) AS g, CAST(n_regionkey AS BIGINT) AS ac, hex(encode(n_name)) AS h FROM nation"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "fn_concat_nulls": ("SELECT n_nationkey, concat(nullif(n_name, n_name), 'x', n_regionkey) AS c FROM nation", "SELECT n_nationkey, concat(nullif(n_name, n_name), 'x', n_regionkey) AS c FROM nation"),
    "tpch_pricing": (
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS discount, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    ),
}

_OPERATIONS: dict[str, tuple[Run, str | None]] = {
    "ts_segment_stats": (ts_segment_stats, None),
    "ts_segment_points": (lambda spark, d: folder(spark, d).segment_stats("points").groupBy("field").agg(F.sum("points").alias("points"), F.bool_and(F.col("payload_bytes") > 0).alias("stored")), f"SELECT unnest(['value', 'twice']) AS field, count(*) AS points, true AS stored FROM {_EVENTS}"),
    "copy_range": (copy_range, f"SELECT field, count(*) AS n, true AS whole FROM {_EVENTS}, (VALUES ('one'), ('two')) f(field) WHERE ts BETWEEN TIMESTAMP '2023-12-31' AND TIMESTAMP '2024-02-15' GROUP BY field"),
    "copied_part": (copied_part, "SELECT true AS some, true AS after, true AS before"),
    "insert_series": (insert_series, f"SELECT event_type, count(*) AS n, CAST(max(value) AS DOUBLE) AS top FROM {_EVENTS} WHERE value > 50 GROUP BY event_type"),
    "late_and_repeated": (late_and_repeated, f"SELECT event_type, 2 * count(*) AS n, round(2 * sum(CAST(value AS DOUBLE)), 1) AS total FROM {_EVENTS} GROUP BY event_type"),
    "stream_small_batches": (stream_small_batches, f"SELECT event_type, count(*) AS n, CAST(max(value) AS DOUBLE) AS top, true AS few FROM {_EVENTS} GROUP BY event_type"),
    "ts_agg_by_tag": (
        lambda spark, d: folder(spark, d).sql("SELECT event_type, COUNT(value) AS n, MIN(value) AS low, MAX(twice) AS top FROM points GROUP BY event_type").select("event_type", "n", F.col("low").cast("double").alias("low"), F.col("top").cast("double").alias("top")),
        f"SELECT event_type, count(value) AS n, CAST(min(value) AS DOUBLE) AS low, CAST(max(twice) AS DOUBLE) AS top FROM {_EVENTS} GROUP BY event_type",
    ),
    "ts_agg_time_range": (ts_agg_time_range, f"SELECT event_type, count(value) AS n, CAST(max(twice) AS DOUBLE) AS top FROM {_EVENTS} WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 07:30:00' GROUP BY event_type"),
    "ts_lossy_within_bound": (ts_lossy_within_bound, f"SELECT count(*) AS points, CAST(0 AS BIGINT) AS near_wrong, CAST(0 AS BIGINT) AS part_wrong FROM {_EVENTS}"),
    "ts_two_paths": (ts_two_paths, "SELECT CAST(0 AS BIGINT) AS n, true AS low, true AS top, true AS total"),
    "ts_grouped_by_hour": (ts_grouped_by_hour, f"SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, CAST(max(value) AS DOUBLE) AS top FROM {_EVENTS} GROUP BY ALL"),
    "ts_optimize": (ts_optimize, f"SELECT event_type, count(*) AS n, CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS top FROM {_EVENTS} GROUP BY event_type"),
    "ddl_create_insert_select": (ddl_create_insert_select, "SELECT * FROM (VALUES (1, 'Ada', CAST(160 AS SMALLINT)), (2, 'Ben', 170), (3, 'Cy', NULL)) t(id, name, height)"),
    "ddl_truncate": (ddl_truncate, "SELECT CAST(0 AS BIGINT) AS n"),
    "ddl_drop": (ddl_drop, "SELECT 'two' AS name"),
    "ddl_vacuum": (ddl_vacuum, f"SELECT count(*) AS n, CAST(1 AS INTEGER) AS commits FROM {_EVENTS}"),
    "include_union": (include_union, f"SELECT ts, event_type, CAST(value AS DOUBLE) AS value FROM {_EVENTS}"),
    "copy_move": (copy_move, f"SELECT 'kept' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'moved', count(*) FROM {_EVENTS} WHERE event_type = 'click' UNION ALL SELECT 'plain', count(*) FROM {_EVENTS}"),
    "stream_ingest": (stream_ingest, f"SELECT event_type, count(*) AS n, CAST(max(value) AS DOUBLE) AS top FROM {_EVENTS} GROUP BY event_type"),
    "stream_transfer": (stream_transfer, f"SELECT 'edge' AS folder, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'cloud', count(*) FROM {_EVENTS}"),
    "bulk_import_export": (bulk_import_export, f"SELECT event_type, count(*) AS n, CAST(min(value) AS DOUBLE) AS low FROM {_EVENTS} GROUP BY event_type"),
}


def queries() -> dict[str, Run]:
    found = {name: on_folder(sql) for name, (sql, _) in _FOLDER_SQL.items()}
    found |= {name: run for name, (run, _) in _OPERATIONS.items()}
    return found | {name: relational(sql) for name, (sql, _) in _PLAIN_SQL.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, (_, sql) in _FOLDER_SQL.items()}
    found |= {name: sql for name, (_, sql) in _OPERATIONS.items() if sql}
    return found | {name: own or sql for name, (sql, own) in _PLAIN_SQL.items()}
