from __future__ import annotations

import datetime as dt
import json
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from tidemill.engine import connect, open_local, open_memory, open_url
from tidemill.errors import InvalidArgument, InvalidState, Unimplemented
from tidemill.plans import pushdown, scan
from tidemill.storage import log as storage_log
from tidemill.storage.files import Files
from tidemill.types import Column, ErrorBound, Kind, TimeSeriesTable

DDL = "CREATE TIME SERIES TABLE series(timestamp TIMESTAMP, tag_1 TAG, tag_2 TAG, field_1 FIELD, field_2 FIELD, both FIELD AS (field_1 + field_2))"
ROWS = [(100, "tag_x", "tag_a", 37.0, 24.0), (100, "tag_y", "tag_b", 73.0, 56.0), (200, "tag_x", "tag_a", 38.0, 25.0), (200, "tag_y", "tag_b", 72.0, 55.0), (300, "tag_x", "tag_a", 39.0, 26.0), (300, "tag_y", "tag_b", 71.0, 54.0)]
SCHEMA = "timestamp timestamp_ntz, tag_1 string, tag_2 string, field_1 float, field_2 float"


def at(us):
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


def points(spark, rows=ROWS):
    return spark.createDataFrame([(at(r[0]), *r[1:]) for r in rows], SCHEMA)


@pytest.fixture
def folder(spark):
    with open_memory(spark) as made:
        made.sql(DDL)
        made.write("series", points(spark))
        yield made


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_write_and_read_back(folder, spark):
    want = sorted((at(r[0]), *r[1:], r[3] + r[4]) for r in ROWS)
    assert rows_of(folder.frame("series")) == want
    assert rows_of(folder.sql("SELECT * FROM series")) == want
    assert folder.sql("SELECT both, tag_2, timestamp FROM series").columns == ["both", "tag_2", "timestamp"]
    assert folder.schema("series").fieldNames() == ["timestamp", "tag_1", "tag_2", "field_1", "field_2", "both"]
    assert folder.tables() == ["series"] and folder.type() == "DataFolder"


def test_aggregates_of_groups(folder):
    found = folder.read_time_series_table("series", {"tag_1": None, "field_1": "count", "field_2": "sum"}, ["tag_1"])
    assert rows_of(found) == [("tag_x", 3, 75.0), ("tag_y", 3, 165.0)]
    assert found.dtypes == [("tag_1", "string"), ("COUNT(field_1)", "bigint"), ("SUM(field_2)", "double")]
    query = "SELECT tag_1, COUNT(field_1), MIN(field_1), MAX(field_1), SUM(field_2), AVG(field_2) FROM series GROUP BY tag_1"
    found = folder.sql(query)
    assert rows_of(found) == [("tag_x", 3, 37.0, 39.0, 75.0, 25.0), ("tag_y", 3, 71.0, 73.0, 165.0, 55.0)]
    assert [t for _, t in found.dtypes][1:] == ["bigint", "float", "float", "double", "double"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simple_aggregates_decode_nothing(folder):
    for sql in ("SELECT SUM(field_1) FROM series", "SELECT count(*) AS n FROM series", "SELECT tag_1, max(field_1) FROM series WHERE tag_2 = 'tag_a' GROUP BY tag_1"):
        assert pushdown.from_segments(folder, sql) is not None
        assert "ArrowEvalPython" not in plan(folder.sql(sql))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT SUM(field_1 * 2) FROM series",
        "SELECT COUNT(DISTINCT field_1) FROM series",
        "SELECT SUM(both) FROM series",
        "SELECT SUM(field_1) FROM series WHERE field_1 > 1",
        "SELECT SUM(field_1) FROM series WHERE tag_1 = 'a' OR tag_2 = 'b'",
        "SELECT SUM(field_1) FROM series HAVING SUM(field_1) > 1",
        "SELECT SUM(field_1) FROM series LIMIT 0",
        "SELECT SUM(field_1), field_2 FROM series GROUP BY field_2",
        "SELECT SUM(a.field_1) FROM series a",
        "SELECT SUM(field_1) FROM series, series b",
        "SELECT SUM(field_1) FILTER (WHERE field_1 > 0) FROM series",
        "SELECT SUM(field_1) OVER () FROM series",
        "SELECT tag_1, SUM(field_1) FROM series",
    ],
)
def test_all_else_is_left_alone(folder, sql):
    assert pushdown.from_segments(folder, sql) is None


def test_both_ways_give_the_same(folder, spark):
    fast = folder.sql("SELECT COUNT(field_1) AS n, MIN(field_1) AS a, MAX(field_1) AS b, SUM(field_1) AS s, AVG(field_1) AS m FROM series").first()
    slow = folder.sql("SELECT COUNT(field_1) AS n, MIN(field_1) AS a, MAX(field_1) AS b, SUM(field_1) AS s, AVG(field_1) AS m FROM series WHERE timestamp >= 0::TIMESTAMP OR true").first()
    assert tuple(fast) == tuple(slow)


def test_range_decodes_only_segments_across_its_ends(folder, spark):
    found = folder.read_time_series_table("series", {"field_1": "count", "field_2": "avg"}, (), 100, 200)
    assert tuple(found.first()) == (4, 40.0)
    assert tuple(folder.read_time_series_table("series", {"field_1": "count"}, (), at(150), at(250), {"tag_1": "tag_y"}).first()) == (1,)
    assert rows_of(folder.read_time_series_table("series", ["field_1"], (), 300, None, {"tag_1": "tag_x"})) == [(39.0,)]
    assert rows_of(folder.read_time_series_table("series", {"tag_1": None, "both": "max"}, ["tag_1"])) == [("tag_x", 65.0), ("tag_y", 129.0)]
    assert folder.sql("SELECT count(field_1) AS n FROM series WHERE timestamp > '1970-01-01 00:00:00.0001' AND timestamp < '1970-01-01 00:00:00.0003'").first()["n"] == 2


def test_time_predicates_reach_segments(folder):
    found = folder.sql("SELECT timestamp, field_1 FROM series WHERE timestamp > TIMESTAMP '1970-01-01 00:00:00.0001' AND TIMESTAMP '1970-01-01 00:00:00.0003' > timestamp AND tag_1 = 'tag_x'")
    assert rows_of(found) == [(at(200), 38.0)]
    text = plan(found)
    assert "PartitionFilters: [" in text and "(field_column" in text
    assert "GreaterThanOrEqual(end_us,100)" in text and "LessThanOrEqual(start_us,300)" in text and "EqualTo(tag_1,tag_x)" in text
    assert folder.sql("SELECT field_1 FROM series WHERE timestamp = TIMESTAMP '1970-01-01 00:00:00.0002' AND tag_1 = 'tag_y'").first()[0] == 72.0
    whole = folder.sql("SELECT a.field_1 FROM series a JOIN series b USING (timestamp, tag_1) WHERE a.timestamp < TIMESTAMP '1970-01-01 00:00:00.0002'")
    assert whole.count() == 2


def test_late_repeated_and_equal_points_are_kept(folder, spark):
    late = [(150, "tag_x", "tag_a", 1.0, 2.0), (150, "tag_x", "tag_a", 1.0, 2.0), (100, "tag_x", "tag_a", 5.0, 6.0)]
    folder.write("series", points(spark, late))
    found = rows_of(folder.sql("SELECT timestamp, field_1, field_2 FROM series WHERE tag_1 = 'tag_x'"))
    assert found == sorted([(at(100), 37.0, 24.0), (at(100), 5.0, 6.0), (at(150), 1.0, 2.0), (at(150), 1.0, 2.0), (at(200), 38.0, 25.0), (at(300), 39.0, 26.0)])
    before = rows_of(folder.frame("series"))
    folder.optimize("series")
    assert rows_of(folder.frame("series")) == before
    assert folder.segments("series").count() == 4


def test_segments_within_a_bound_are_merged_as_they_are(spark):
    with open_memory(spark) as folder:
        folder.sql("CREATE TIME SERIES TABLE s(t TIMESTAMP, k TAG, a FIELD(10%), b FIELD)")
        rows = spark.range(600).select(F.timestamp_seconds("id").cast("timestamp_ntz"), F.concat(F.lit("k"), F.col("id") % 2), (F.col("id") * 1.5 + F.rand(1)).cast("float"), F.col("id").cast("float"))
        for half in (0, 1):
            folder.write("s", rows.where(F.floor(F.col("id") / 300) == half))
        before, stats = rows_of(folder.frame("s")), rows_of(folder.segment_stats("s"))
        folder.optimize("s")
        assert rows_of(folder.frame("s")) == before and rows_of(folder.segment_stats("s")) == stats
        assert len(folder._log("s").state().commits) == 1 and folder.vacuum("s", 0) == 2


def test_fields_stay_together_over_chunks(spark):
    with open_memory(spark) as folder:
        folder.sql("CREATE TIME SERIES TABLE s(t TIMESTAMP, a FIELD, b FIELD(1%), k TAG)")
        n = 150_000
        rows = spark.range(n).select(F.timestamp_seconds("id").cast("timestamp_ntz"), F.sin(F.col("id") / 50).cast("float"), (F.floor(F.col("id") / 1000) * 10).cast("float"), F.lit("x"))
        folder.write("s", rows)
        found = folder.frame("s")
        wrong = found.where((F.abs(F.col("a") - F.sin(F.unix_seconds(F.col("t").cast("timestamp")) / 50)) > 1e-6) | (F.abs(F.col("b") - F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / 1000) * 10) > F.col("b") * 0.011))
        assert found.count() == n and wrong.count() == 0
        assert {r["model"] for r in folder.segment_stats("s").collect()} >= {"constant", "xor"}


def test_empty_table(spark):
    with open_memory(spark) as folder:
        folder.sql(DDL)
        assert folder.frame("series").count() == 0
        assert tuple(folder.sql("SELECT COUNT(field_1), MIN(field_1), MAX(field_1), SUM(field_1), AVG(field_1) FROM series").first()) == (0, None, None, None, None)
        folder.write("series", points(spark, []))
        assert folder.frame("series").count() == 0


def test_schemas_must_match(folder, spark):
    wrong = spark.createDataFrame([(at(1), "a", 1.0)], "timestamp timestamp_ntz, tag string, field float")
    with pytest.raises(InvalidArgument):
        folder.write("series", wrong)
    with pytest.raises(InvalidArgument):
        folder.write("series", points(spark).withColumn("field_1", F.col("field_1").cast("double")))
    assert folder.write("series", points(spark).toDF("a", "b", "c", "d", "e"))
    assert folder.write("series", points(spark).withColumn("both", F.lit(0.0).cast("float")))
    with pytest.raises(Exception, match="can't hold null"):
        folder.write("series", points(spark, [(1, None, "b", 1.0, 1.0)]))
    assert folder.frame("series").count() == 18


def test_missing_and_existing_tables(folder, spark):
    for call in (lambda: folder.table("none"), lambda: folder.drop("none"), lambda: folder.truncate("none"), lambda: folder.vacuum("none"), lambda: folder.sql("DROP TABLE series, none"), lambda: folder.read_time_series_table("none")):
        with pytest.raises(InvalidArgument, match="does not exist"):
            call()
    with pytest.raises(InvalidArgument, match="already exists"):
        folder.sql(DDL)
    assert folder.frame("series").count() == 6


def test_generated_columns_are_checked(spark):
    with open_memory(spark) as folder:
        for wrong in ("field_3 + 1", "sum(field_1)", "(SELECT 1)", "row_number() OVER (ORDER BY field_1)", "twice + 1"):
            with pytest.raises(InvalidArgument):
                folder.sql(f"CREATE TIME SERIES TABLE g(timestamp TIMESTAMP, field_1 FIELD, twice FIELD AS (field_1 * 2), x FIELD AS ({wrong}))")
        folder.sql("CREATE TIME SERIES TABLE g(timestamp TIMESTAMP, c FIELD AS (37), field_1 FIELD, s FIELD AS (SIN(field_1 * PI() / 180)))")
        folder.sql("INSERT INTO g VALUES (TIMESTAMP '2024-01-01 00:00:00', 90.0)")
        folder.sql("INSERT INTO g VALUES (TIMESTAMP '2024-01-01 00:00:01', 0.0, 30.0, 0.0)")
        assert rows_of(folder.sql("SELECT c, field_1, ROUND(s, 3) FROM g")) == [(37.0, 30.0, 0.5), (37.0, 90.0, 1.0)]
        assert folder.sql("SELECT count(*) AS n FROM g WHERE s > 0.9").first()["n"] == 1


def test_commits_are_whole_or_not_at_all(folder, spark):
    broken = points(spark).withColumn("field_1", F.raise_error(F.lit("broken")).cast("float"))
    with pytest.raises(Exception, match="broken"):
        folder.write("series", broken)
    assert folder.frame("series").count() == 6
    assert len(folder.files.list("tables/series/data")) == 1


def test_batches_are_written_once(folder, spark):
    assert folder.write("series", points(spark), ["q:1"])
    assert not folder.write("series", points(spark), ["q:1"])
    for i in range(12):
        assert folder.write("series", points(spark, ROWS[:1]), [f"r:{i}"])
    assert not folder.write("series", points(spark), ["q:1", "r:3"])
    assert folder.frame("series").count() == 24
    log = folder._log("series")
    assert any(".snapshot." in n for n, _ in folder.files.list("tables/series/log/0000000000"))
    # Of a stream only the highest number is kept.
    assert log.state().streams == {"q": 1, "r": 11} and not log.state().others


def test_writers_meet(folder, spark):
    log = folder._log("series")
    version = log.state().version + 1
    assert folder.files.create(log._path(version), json.dumps({"add": [], "batches": ["other"]}))
    assert folder.write("series", points(spark), ["mine"])
    assert log.state().others == {"other", "mine"} and log.state().version == version + 1
    commits = log.state().commits
    folder.truncate("series")
    with pytest.raises(InvalidState):
        folder._append_segments(folder.table("series"), folder.segments("series"), replace=commits)


def test_a_stalled_writer_loses_no_commit(folder, spark, monkeypatch):
    """A version is there whole or not at all, however long its writer takes; what was reported as done stays."""
    log = folder._log("series")
    held = threading.Event()
    write = Files._write

    def slow(self, path, text):
        write(self, path, text)
        if "stalled" in text:
            held.wait(60)

    monkeypatch.setattr(Files, "_write", slow)
    before = log.state()
    done = []
    other = threading.Thread(target=lambda: done.append(log.commit(lambda s: {"add": [], "batches": ["stalled"]})))
    other.start()
    for i in range(9):
        log.commit(lambda s, i=i: {"add": [f"c{i}"]})
    assert log.state().commits == before.commits + [f"c{i}" for i in range(9)] and not log.state().others
    held.set()
    other.join()
    assert log.state().others == {"stalled"} and log.state().version == before.version + 10
    assert log.state().commits == before.commits + [f"c{i}" for i in range(9)]


def test_many_writers_lose_no_commit(folder):
    log = folder._log("series")
    before = log.state()
    threads = [threading.Thread(target=lambda i=i: [log.commit(lambda s, k=k: {"add": [f"w{i}-{k}"]}) for k in range(4)]) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    after = log.state()
    assert len(after.commits) == len(set(after.commits)) == len(before.commits) + 20 and after.version == before.version + 20
    assert not [n for n, _ in folder.files.list("tables/series/log/0000000000") if n.endswith(".part")]


def test_log_goes_on_over_folders(folder, monkeypatch):
    monkeypatch.setattr(storage_log, "FOLDER_VERSIONS", 20)
    folder.files.delete("tables/series")
    log = folder._log("series")
    for i in range(45):
        log.commit(lambda s, i=i: {"add": [f"c{i}"]})
    # Without the snapshots of the newest folder, the one before it is read too.
    for n in (40,):
        folder.files.delete(log._path(n, "snapshot.json"))
    assert log.state().commits == [f"c{i}" for i in range(45)]


@pytest.mark.parametrize("few", [True, False])
def test_only_files_of_the_asked_times_are_opened(spark, few, monkeypatch):
    monkeypatch.setattr(storage_log, "DRIVER_FILES", 20_000 if few else 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    week = 7 * 86_400
    with open_memory(spark) as folder:
        folder.sql("CREATE TIME SERIES TABLE s(t TIMESTAMP, k TAG, a FIELD, b FIELD)")
        # 30 weeks in one commit, a day in another.
        rows = spark.range(30 * 7 * 24).select(F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz"), F.concat(F.lit("k"), F.col("id") % 3), F.col("id").cast("float"), (-F.col("id")).cast("float"))
        folder.write("s", rows)
        folder.write("s", rows.where("id < 24"))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        log, schema = folder._log("s"), folder.table("s").segment_schema
        whole = folder.segments("s").inputFiles()
        assert len(whole) == sum(n["files"] for n in log.state().notes.values())
        start, end = (20 * week + 3600) * 1_000_000, (20 * week + 7200) * 1_000_000
        some = log.segments(schema, None, (start, end)).inputFiles()
        spans = {r["f"]: (r["a"], r["b"]) for r in folder.segments("s").groupBy(F.input_file_name().alias("f")).agg(F.min("start_us").alias("a"), F.max("end_us").alias("b")).collect()}
        assert sorted(some) == sorted(f for f, (a, b) in spans.items() if a <= end and b >= start) and len(some) < len(whole) / 2
        assert set(log.segments(schema, [2], (start, end)).inputFiles()) == {f for f in some if "field_column=2" in f}
        high = log.segments(schema, [2], (None, None), (5000.0, None)).inputFiles()
        assert 0 < len(high) < len(whole) / 2
        at = "TIMESTAMP '1970-05-21 01:00:00' AND TIMESTAMP '1970-05-21 02:00:00'"
        for columns, files in (("a", 1), ("a, b", 2)):
            found = folder.sql(f"SELECT {columns} FROM s WHERE t BETWEEN {at}")
            assert len(found.inputFiles()) <= 2 * files and [r["a"] for r in found.orderBy("a").collect()] == [3361.0, 3362.0]
        assert folder.sql(f"SELECT COUNT(a) AS n FROM s WHERE t >= {at.replace('AND', 'AND t <=')}").first()["n"] == 2
        assert [r["a"] for r in folder.sql("SELECT a FROM s WHERE a > 5037.5").collect()] == [5038.0, 5039.0]


def test_threads_and_folders_with_tables_of_one_name(folder, spark):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("series")
    with open_memory(spark) as other:
        other.sql(DDL)
        other.write("series", points(spark, ROWS[:1]))
        counts: dict[str, list] = {"a": [], "b": []}

        def ask(f, name):
            for _ in range(4):
                counts[name].append(f.sql("SELECT field_1 FROM series WHERE timestamp >= TIMESTAMP '1970-01-01 00:00:00'").count())

        threads = [threading.Thread(target=ask, args=x) for x in ((folder, "a"), (other, "b"), (folder, "a"))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert counts == {"a": [6] * 8, "b": [1] * 4}
    # The session's own view is there again.
    assert spark.table("series").columns == ["x"]
    spark.catalog.dropTempView("series")


def test_insert_runs_its_query_once(spark):
    with open_memory(spark) as folder:
        folder.sql("CREATE TABLE plain(x DOUBLE)")
        folder.sql("CREATE TIME SERIES TABLE s(t TIMESTAMP, a FIELD, b FIELD)")
        n = folder.sql("INSERT INTO plain SELECT rand() AS x FROM range(2000) WHERE rand() < 0.5").first()["count"]
        assert n == folder.frame("plain").count()
        n = folder.sql("INSERT INTO s SELECT timestamp_seconds(id), rand(), 1 FROM range(2000) WHERE rand() < 0.5").first()["count"]
        assert n == folder.frame("s").count() == folder.sql("SELECT COUNT(b) AS n FROM s").first()["n"]


def test_random_queries_with_and_without_pruning(spark):
    rng = random.Random(11)
    with open_memory(spark) as folder:
        folder.sql("CREATE TIME SERIES TABLE w(ts TIMESTAMP, k TAG, v FIELD, u FIELD)")
        rows = spark.range(6000).select(F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("k"), F.col("id") % 2).alias("k"), F.col("id").cast("float").alias("v"), (F.col("id") % 97).cast("float").alias("u"))
        folder.write("w", rows)
        rows.createOrReplaceTempView("plain_w")

        def cond(alias=""):
            day, value = rng.randint(1, 40), rng.randint(0, 6000)
            moment = f"TIMESTAMP_NTZ '{dt.datetime(1970, 1, 1) + dt.timedelta(days=day)}'"
            return rng.choice([f"{alias}ts >= {moment}", f"{moment} > {alias}ts", f"{alias}v > {value}", f"{value} >= {alias}v", f"{alias}v < (SELECT AVG(v) FROM w)", f"{alias}ts > (SELECT MIN(ts) FROM w WHERE v > {value})", f"EXISTS (SELECT 1 FROM w WHERE v > {value} AND ts < {moment})", f"{alias}v IN (SELECT v FROM w WHERE u = {value % 97})"])

        shapes = [
            lambda: f"SELECT count(*) AS n, sum(v) AS s FROM w WHERE {cond()} AND {cond()}",
            lambda: f"SELECT count(*) AS n, sum(v) AS s FROM w WHERE {cond()} OR {cond()}",
            lambda: f"WITH a AS (SELECT * FROM w WHERE {cond()}), b AS (SELECT * FROM w WHERE {cond()}) SELECT count(*) AS n, sum(a.v) AS s FROM a JOIN b ON a.ts = b.ts WHERE {cond('a.')}",
            lambda: f"SELECT count(*) AS n, sum(v) AS s FROM (SELECT v, ts FROM w WHERE {cond()} UNION ALL SELECT u, ts FROM w WHERE {cond()}) x",
            lambda: f"SELECT (SELECT MAX(v) FROM w WHERE {cond()}) AS n, sum(a.u) AS s FROM w a LEFT JOIN w b ON a.v = b.v AND {cond('b.')} WHERE {cond('a.')}",
        ]
        for i in range(15):
            sql = shapes[i % len(shapes)]()
            want = spark.sql(re.sub(r"\bw\b", "plain_w", sql)).first()
            assert tuple(folder.sql(sql).first()) == tuple(want), sql


def test_truncate_vacuum_drop(folder, spark):
    folder.sql("TRUNCATE series")
    assert folder.frame("series").count() == 0 and folder.vacuum("series") == 0
    folder.write("series", points(spark))
    assert folder.vacuum("series", 0) == 1 and folder.vacuum(retain=0) == 0
    assert folder.frame("series").count() == 6
    folder.sql("DROP TABLE series")
    assert folder.tables() == [] and not folder.files.exists("tables/series")
    with pytest.raises(InvalidArgument):
        folder.vacuum(retain=-1)


def test_copy_and_move(folder, spark, tmp_path):
    target = open_local(spark, str(tmp_path / "target"))
    target.sql(DDL)
    folder.copy_time_series_table("series", target, "series", tags={"tag_1": "tag_x"})
    assert target.frame("series").count() == 3
    folder.copy_time_series_table("series", target, "series", 100, 299)
    assert target.frame("series").count() == 3
    folder.move("series", target, "series")
    assert folder.frame("series").count() == 0 and target.frame("series").count() == 9
    target.sql("CREATE TABLE plain(tag_1 TEXT, n BIGINT)")
    target.copy("SELECT tag_1, COUNT(field_1) AS n FROM series GROUP BY tag_1", target, "plain")
    assert rows_of(target.frame("plain")) == [("tag_x", 6), ("tag_y", 3)]
    with pytest.raises(InvalidArgument):
        target.copy("SELECT 1 AS x", target, "plain")
    with pytest.raises(InvalidArgument):
        target.copy("SELECT * FROM series", target, "series")
    with pytest.raises(InvalidArgument):
        target.move("plain", folder, "series")
    assert open_local(spark, str(tmp_path / "target")).tables() == ["plain", "series"]


def test_include_and_metadata(folder, spark):
    with open_memory(spark) as other:
        other.sql(DDL)
        other.write("series", points(spark, ROWS[:2]))
        assert folder.sql(f"INCLUDE '{other.url}' SELECT timestamp FROM series").count() == 8
    with open_url(spark, "memory://near") as near:
        near.sql(DDL)
        near.write("series", points(spark, ROWS[:3]))
        assert folder.sql("INCLUDE 'memory://near' SELECT timestamp FROM series").count() == 9
    assert rows_of(folder.sql("SELECT column_name FROM metadata.time_series_table_field_columns WHERE generated_column_expr IS NULL")) == [("field_1",), ("field_2",)]
    assert folder.sql("SELECT * FROM metadata.normal_table_metadata").count() == 0
    assert "ArrowEvalPython" in folder.sql("EXPLAIN SELECT field_1 FROM series").first()["plan"]


def test_sql_of_other_kinds(folder):
    for sql in ("UPDATE series SET field_1 = 1", "VACUUM CLUSTER series", "TRUNCATE CLUSTER series"):
        with pytest.raises((InvalidArgument, Unimplemented)):
            folder.sql(sql)
    with pytest.raises(InvalidArgument):
        folder.read("DROP TABLE series")
    with pytest.raises(Unimplemented):
        connect("grpc://localhost")
    with pytest.raises(InvalidArgument):
        open_url(folder.spark, "ftp://x")
    assert folder.sql("SELECT 1 AS one").first()["one"] == 1


def test_statements_for_a_cluster(folder, spark):
    with open_memory(spark) as other, open_memory(spark) as bare:
        other.sql(DDL)
        other.write("series", points(spark))
        folder.join(other.url)
        folder.sql("TRUNCATE CLUSTER series")
        assert folder.frame("series").count() == other.frame("series").count() == 0
        folder.sql("VACUUM CLUSTER series RETAIN 0")
        assert not folder.files.list("tables/series/data") and not other.files.list("tables/series/data")
        folder.write("series", points(spark))
        # A node without the table: nothing is done anywhere.
        folder.join(bare.url)
        with pytest.raises(InvalidArgument, match="does not exist"):
            folder.sql("TRUNCATE CLUSTER series")
        assert folder.frame("series").count() == 6
        folder.sql("TRUNCATE series")
        assert folder.frame("series").count() == 0


def test_reading_checks_its_arguments(folder):
    for call in (
        lambda: folder.read_time_series_table("series", ["none"]),
        lambda: folder.read_time_series_table("series", {"field_1": "median"}),
        lambda: folder.read_time_series_table("series", ["field_1"], ["tag_1"]),
        lambda: folder.read_time_series_table("series", {"field_1": "max", "field_2": None}),
        lambda: folder.read_time_series_table("series", tags={"field_1": "1"}),
    ):
        with pytest.raises(InvalidArgument):
            call()


def test_tables_made_in_python(spark):
    with open_memory(spark) as folder:
        columns = (Column("ts", Kind.TIMESTAMP), Column("value", Kind.FIELD, ErrorBound.absolute(0.5)))
        folder.create(TimeSeriesTable("plain", columns))
        assert folder.table("PLAIN") == TimeSeriesTable("plain", columns)
        folder.write("plain", spark.createDataFrame([(at(-5), 1.0), (at(0), 1.2), (at(7), 1.4)], "ts timestamp_ntz, value float"))
        assert rows_of(folder.sql("SELECT ts FROM plain")) == [(at(-5),), (at(0),), (at(7),)]
        assert folder.sql("SELECT count(*) AS n FROM plain WHERE ts < '1970-01-01'").first()["n"] == 1


def test_value_predicates_reach_segments(folder, spark):
    nan = float("nan")
    folder.write("series", points(spark, [(400, "tag_x", "tag_a", nan, 1.0), (500, "tag_x", "tag_a", -5.0, 1.0)]))
    found = folder.sql("SELECT field_1 FROM series WHERE field_1 > 72.5 AND tag_1 = 'tag_y'")
    assert rows_of(found) == [(73.0,)]
    assert "GreaterThanOrEqual(max_value,72.5)" in plan(found)
    assert len(folder.sql("SELECT field_1 FROM series WHERE field_1 >= 70").collect()) == 4
    assert [r[0] for r in folder.sql("SELECT field_1 FROM series WHERE field_1 < 37").collect()] == [-5.0]
    assert [r[0] for r in folder.sql("SELECT field_1 FROM series WHERE 38 = field_1").collect()] == [38.0]
    assert folder.sql("SELECT count(*) AS n FROM series WHERE field_1 > double('NaN') OR field_1 > 1000").first()["n"] == 1
    # A self join uses the table twice, so only bounds that hold for both count.
    both = folder.sql("SELECT a.field_1 FROM series a JOIN series b ON a.timestamp = b.timestamp AND a.field_1 > 70 AND b.field_1 < 40")
    assert sorted(r[0] for r in both.collect()) == [71.0, 72.0, 73.0]


def test_bounds_leave_subqueries_whole(folder):
    late = "timestamp >= TIMESTAMP '1970-01-01 00:00:00.0003'"
    above = folder.sql(f"SELECT field_1 FROM series WHERE {late} AND field_1 < (SELECT AVG(field_1) + 15 FROM series)")
    assert rows_of(above) == [(39.0,)]
    assert rows_of(folder.sql(f"SELECT field_1 FROM series WHERE {late} AND EXISTS (SELECT 1 FROM series WHERE field_1 = 37)")) == [(39.0,), (71.0,)]
    assert rows_of(folder.sql("SELECT (SELECT COUNT(field_1 + 0) FROM series) AS n FROM series WHERE field_1 > 72.5")) == [(6,)]
    # A subquery in a filter on a tag is pushed below the decoding.
    assert rows_of(folder.sql(f"SELECT field_1 FROM series WHERE {late} AND tag_1 = (SELECT MIN(tag_1) FROM series WHERE field_1 = 37)")) == [(39.0,)]
    nested = "SELECT MAX(field_1) FROM series WHERE field_1 < (SELECT AVG(field_1) FROM series)"
    assert rows_of(folder.sql(f"SELECT field_1 FROM series WHERE {late} AND field_1 > ({nested})")) == [(71.0,)]
    assert "GreaterThanOrEqual(end_us,300)" in plan(folder.sql(f"SELECT field_1 FROM series WHERE {late} AND field_1 > (SELECT 40)"))


@pytest.mark.parametrize("bound", ["", "(2%)"])
def test_copy_of_a_range_that_cuts_a_chunk(spark, bound):
    day = 86_400_000_000
    with open_memory(spark) as folder, open_memory(spark) as target:
        for f in (folder, target):
            f.sql(f"CREATE TIME SERIES TABLE s(t TIMESTAMP, k TAG, a FIELD{bound}, b FIELD)")
        # 34,560 points of a series in a week: one chunk, with segments that end at different points for each field.
        rows = spark.range(34_560).select(F.timestamp_micros(F.lit(7 * day) + F.col("id") * 17_500_000).cast("timestamp_ntz"), F.lit("x"), (F.floor(F.col("id") / 700) * 3 + F.floor(F.col("id") / 3000) * F.rand(2)).cast("float"), F.rand(3).cast("float"))
        folder.write("s", rows)
        segments = [r.asDict() for r in folder.segments("s").select("chunk", "field_column", "start_us", "end_us").collect()]
        assert len({r["chunk"] for r in segments}) == 1
        points = [(scan.micros(r[0]), *r[1:]) for r in folder.frame("s").orderBy("t").collect()]
        want = []
        for low, high in ((8 * day, 10 * day), (None, 8 * day - 1), (12 * day + 1, None), (9 * day, 9 * day + 1)):
            inside = [[(r["start_us"], r["end_us"]) for r in segments if r["field_column"] == n and (low is None or r["start_us"] >= low) and (high is None or r["end_us"] <= high)] for n in (2, 3)]
            part = [p for p in points if all(any(a <= p[0] <= b for a, b in spans) for spans in inside)]
            want += part
            assert bool(part) == (high != 9 * day + 1)
            folder.copy_time_series_table("s", target, "s", low, high)
            found = sorted((scan.micros(r[0]), *r[1:]) for r in target.frame("s").collect())
            assert found == sorted(want)
        assert target.sql("SELECT COUNT(a) AS n FROM s").first()["n"] == target.sql("SELECT COUNT(b) AS n FROM s").first()["n"] == len(want)
        before = len(want)
        folder.copy_time_series_table("s", target, "s", 7 * day, 30 * day)
        assert target.frame("s").count() == before + 34_560
