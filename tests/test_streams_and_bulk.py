from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidemill.engine import open_memory
from tidemill.errors import InvalidArgument
from tidemill.sources.bulk import export_table, import_parquet
from tidemill.streaming import ingest

SCHEMA = "ts timestamp_ntz, tag string, value float"


def rows(spark, n=100, shift=0):
    return spark.range(n).select((F.timestamp_seconds(F.col("id") + shift)).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("t"), F.col("id") % 3).alias("tag"), F.col("id").cast("float").alias("value"))


def made(spark):
    folder = open_memory(spark)
    folder.sql("CREATE TIME SERIES TABLE points(ts TIMESTAMP, tag TAG, value FIELD)")
    return folder


def test_stream_is_written_once(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    rows(spark).repartition(3).write.parquet(source)
    with made(spark) as folder:
        stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.start(stream(), folder, "points", check).awaitTermination()
        rows(spark, 50, 1000).coalesce(1).write.mode("append").parquet(source)
        ingest.start(stream(), folder, "points", check).awaitTermination()
        assert folder.frame("points").count() == 150
        # A batch that the source's checkpoint doesn't know of as done is not written a second time.
        ingest.start(stream(), folder, "points", str(tmp_path / "other"), name=check).awaitTermination()
        assert folder.frame("points").count() == 150


def test_transfer(spark):
    with made(spark) as edge, made(spark) as cloud:
        assert not ingest.transfer(edge, cloud, "points")
        edge.write("points", rows(spark))
        assert not ingest.transfer(edge, cloud, "points", 10**9)
        assert ingest.transfer(edge, cloud, "points", 10)
        assert (edge.frame("points").count(), cloud.frame("points").count()) == (0, 100)


def test_interrupted_transfer_adds_nothing_twice(spark):
    with made(spark) as edge, made(spark) as cloud:
        edge.write("points", rows(spark))
        state = edge._log("points").state()
        cloud._append_segments(cloud.table("points"), edge.segments("points"), [f"move-{c}" for c in state.commits])
        edge.move("points", cloud, "points")
        assert (edge.frame("points").count(), cloud.frame("points").count()) == (0, 100)


def test_interrupted_transfer_with_rows_that_came_since(spark):
    with made(spark) as edge, made(spark) as cloud:
        edge.write("points", rows(spark))
        state = edge._log("points").state()
        cloud._append_segments(cloud.table("points"), edge.segments("points"), [f"move-{c}" for c in state.commits])
        edge.write("points", rows(spark, 20, 5000))
        edge.move("points", cloud, "points")
        assert (edge.frame("points").count(), cloud.frame("points").count()) == (0, 120)


def test_transfer_by_timer(spark):
    with made(spark) as edge, made(spark) as cloud:
        timer = ingest.Transfer(edge, cloud, "points", 0.2, 10)
        edge.write("points", rows(spark))
        until = time.monotonic() + 120
        while not timer.moved and time.monotonic() < until:
            time.sleep(0.1)
        timer.stop()
        assert timer.moved == 1 and (edge.frame("points").count(), cloud.frame("points").count()) == (0, 100)
        edge.drop("points")
        edge.sql("CREATE TABLE points(x INT)")
        edge.sql("INSERT INTO points VALUES (1)")
        broken = ingest.Transfer(edge, cloud, "points", 0.05)
        time.sleep(3)
        with pytest.raises(InvalidArgument, match="kind"):
            broken.stop()


def test_small_batches_make_few_segments(spark, tmp_path):
    source = str(tmp_path / "in")
    # 12 batches of 40 rows of each of 3 series, in order of time.
    for i in range(12):
        rows(spark, 120, 120 * i).coalesce(1).write.mode("append").parquet(source)
    with made(spark) as folder:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        for _ in range(2):
            ingest.start(stream, folder, "points", str(tmp_path / "check"), hold=500, least=100).awaitTermination()
        state = folder._log("points").state()
        # Two flushes after five batches each, and what two more brought.
        assert len(state.commits) == 2 and folder.held("points") == 240
        assert folder.segments("points").select("chunk").distinct().count() == 2 * 3 and folder.frame("points").count() == 1200
        assert not folder.flush("points", 10_000) and folder.flush("points")
        assert folder.frame("points").count() == 1440 and folder.held("points") == 0
        assert folder.frame("points").distinct().count() == 1440
        assert not folder.flush("points")


def test_a_flush_leaves_short_series(spark):
    with made(spark) as folder:
        folder.hold("points", rows(spark, 100).where("tag <> 't1' OR value < 10"), ["s:0"])
        assert not folder.hold("points", rows(spark), ["s:0"])
        assert folder.frame("points").count() == 0
        assert folder.flush("points", 20)
        assert folder.frame("points").count() == 67 and folder.held("points") == 3
        folder.sql("TRUNCATE points")
        assert folder.held("points") == 0 and folder.vacuum("points", 0) == 3


def test_export_and_import(spark, tmp_path):
    with made(spark) as folder, made(spark) as other:
        folder.write("points", rows(spark))
        out = str(tmp_path / "out")
        export_table(folder, "SELECT ts, tag, CAST(value AS DOUBLE) AS v FROM points", out, ["tag"])
        with pytest.raises(InvalidArgument, match="double"):
            import_parquet(other, "points", out, {"value": "v"})
        with pytest.raises(InvalidArgument, match="no column"):
            import_parquet(other, "points", out)
        import_parquet(other, "points", out, {"value": "v"}, before=["TRUNCATE points"], after=["VACUUM RETAIN 0"], narrow=True)
        assert sorted(map(tuple, other.frame("points").collect())) == sorted(map(tuple, folder.frame("points").collect()))


def test_partition_values_stay_strings(spark, tmp_path):
    out = str(tmp_path / "numbers")
    spark.createDataFrame([(dt.datetime(2024, 1, 1), "007", 1.0)], SCHEMA).write.partitionBy("tag").parquet(out)
    with made(spark) as folder:
        import_parquet(folder, "points", out)
        assert folder.frame("points").first()["tag"] == "007"


def test_shell(spark, capsys):
    from tidemill import shell

    assert shell.split("SELECT ';' AS a; -- x;\nSELECT 2;;") == ["SELECT ';' AS a", "-- x;\nSELECT 2"]
    with made(spark) as folder:
        folder.write("points", rows(spark, 3))
        shell.serve(folder, ["\\dt", "\\d points", "SELECT count(*) AS n FROM points", "DROP TABLE none", "\\q", "\\h"])
    assert capsys.readouterr().out.splitlines() == ["points", "ts: timestamp_ntz", "tag: string", "value: float, error bound 0", "n", "3", "Invalid Argument Error: Table with name 'none' does not exist."]
