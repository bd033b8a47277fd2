"""Queries of the problems on documents and very large columns (p1, p7, p8, p9) over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.mixing import Mix, mix_sources
from tidemill.llm.packing import pack_containers
from tidemill.llm.quantiles import merge_sketches, percentiles, sketch_groups
from tidemill.llm.spans import shared_spans
from tidemill.llm.tokens import BLANK, WORD, token_count
from tidemill.runtime import durable, small

PERCENTILES = [0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999]
CAPACITY = 2048


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _columns(spark: SparkSession, d: str, name: str) -> tuple[list[str], list[str]]:
    """Tags and fields of a time series table, read off its metadata (one row) and the order of its columns."""
    row = table(spark, d, "time_series_table_metadata").where(F.col("table_name") == name).first()
    stored = table(spark, d, name).columns
    return [stored[i] for i in row["tag_column_indices"]], [stored[i] for i in row["field_column_indices"]]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per series and field of both time series tables."""
    out = None
    for name in ("time_series_table", "wind_turbine"):
        tags, fields = _columns(spark, d, name)
        found = percentiles(sketch_groups(table(spark, d, name), tags, fields), tags, PERCENTILES)
        key = F.to_json(F.struct(*tags), {"ignoreNullFields": "false"})
        found = found.select(F.lit(name).alias("table_name"), key.alias("tags"), *[c for c in found.columns if c not in tags])
        out = found if out is None else out.unionByName(found)
    return out


def p1_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Per park, combined from the summaries of single days."""
    _, fields = _columns(spark, d, "time_series_table")
    rows = table(spark, d, "time_series_table").withColumn("day", F.to_date("timestamp"))
    days = sketch_groups(rows, ["tag_1", "day"], fields)
    return percentiles(merge_sketches(days, ["tag_1"]), ["tag_1"], PERCENTILES)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the summaries stand for, and the exact ends: their lowest and highest values."""
    tags, fields = _columns(spark, d, "time_series_table")
    found = percentiles(sketch_groups(table(spark, d, "time_series_table"), tags, fields), tags, [0.0, 1.0])
    ends = found.groupBy(*tags, "column_name", "n").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return ends


def _near(found: DataFrame, rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Whether each percentile's rank, counted in all rows, is within twice the stated error (six deviations)."""
    values = F.array(*[F.struct(F.lit(f).alias("column_name"), F.col(f).cast("double").alias("x")) for f in fields])
    long = rows.dropDuplicates().select(*[F.col(k).alias(f"__{k}") for k in keys], F.inline(values).alias("__column", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    wide = found.groupBy(*keys, "column_name").pivot("percentile", PERCENTILES).agg(F.first("value"))
    wide = wide.toDF(*keys, "column_name", *[f"v{i}" for i in range(len(PERCENTILES))])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = long.join(small(durable(wide), 100_000), [*same, F.col("column_name") == F.col("__column")])
    counts = [F.struct(F.lit(q).alias("percentile"), F.count_if(F.col("x") < F.col(f"v{i}")).alias("below"), F.count_if(F.col("x") <= F.col(f"v{i}")).alias("up_to")) for i, q in enumerate(PERCENTILES)]
    ranks = both.groupBy(*keys, "column_name").agg(F.array(*counts).alias("ranks")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("column_name").alias("__column"), F.inline("ranks").alias("__q", "below", "up_to"))
    checked = found.join(ranks, [*same, F.col("column_name") == F.col("__column"), F.col("percentile") == F.col("__q")])
    at, slack = F.ceil(F.col("percentile") * F.col("n")), 2 * F.col("rank_error") * F.col("n")
    near = (at >= F.col("below") + 1 - slack) & (at <= F.col("up_to") + slack)
    return checked.select(*keys, "column_name", "percentile", "n", near.alias("near"))


def p1_near(spark: SparkSession, d: str) -> DataFrame:
    """The ranks of the percentiles of each park, held against all rows."""
    _, fields = _columns(spark, d, "time_series_table")
    rows = table(spark, d, "time_series_table")
    found = durable(percentiles(sketch_groups(rows, ["tag_1"], fields), ["tag_1"], PERCENTILES))
    return _near(found, rows, ["tag_1"], fields)


def p1_days_near(spark: SparkSession, d: str) -> DataFrame:
    """The same of percentiles that are combined from single days."""
    _, fields = _columns(spark, d, "time_series_table")
    return _near(durable(p1_from_days(spark, d)), table(spark, d, "time_series_table"), ["tag_1"], fields)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_containers(table(spark, d, "documents"), "doc_id", token_count(F.col("text")), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("pieces > 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What was packed of each document: all its tokens, in as few pieces as can be."""
    return _packed(spark, d).groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("pieces"), F.max("size").alias("largest"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is."""
    return _packed(spark, d).groupBy("container").agg(F.sum("size").alias("tokens"), F.count("*").alias("pieces"))


def p7_tight(spark: SparkSession, d: str) -> DataFrame:
    """All containers together: the tokens in them, how many hold too much, how many documents are split without need,
    and whether there are at most 1 % more than the tokens fill."""
    pieces = durable(_packed(spark, d))
    bins = pieces.groupBy("container").agg(F.sum("size").alias("used"))
    whole = bins.agg(F.sum("used").alias("tokens"), F.count_if(F.col("used") > CAPACITY).alias("overfull"), F.count("*").alias("n"))
    split = pieces.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("size").alias("t")).agg(F.count_if((F.col("k") > 1) & (F.col("t") <= CAPACITY)).alias("split"))
    return whole.join(split).select("tokens", "overfull", "split", (F.col("n") <= F.ceil(1.01 * F.ceil(F.col("tokens") / CAPACITY))).alias("tight"))


def _mix(spark: SparkSession, d: str) -> Mix:
    return mix_sources(table(spark, d, "documents"), "doc_id", "source", token_count(F.col("text")), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report.where("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).copies


def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The report's exact part: what each source has, should give and can give."""
    report = _mix(spark, d).report
    return report.select("source", "records", F.col("size").alias("tokens"), F.round("target_size", 3).alias("target_size"), "short")


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per source, counted from the copies: whether none is repeated too often, and whether the target is met to within
    the largest document, or all is taken as often as it may be."""
    mix = _mix(spark, d)
    sums = mix.copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("mixed"), F.max("copies").alias("most"), F.max("size").alias("largest"), F.min(F.when(F.col("size") > 0, F.col("copies"))).alias("least"))
    both = mix.report.join(sums.withColumnRenamed("source", "__source"), F.lower(F.trim("source")) == F.col("__source"), "left")
    met = F.when(F.col("short"), F.coalesce(F.col("least") == F.col("max_repeats"), F.lit(True))).otherwise(F.abs(F.coalesce("mixed", F.lit(0)) - F.col("target_size")) <= F.coalesce("largest", F.lit(0)))
    shares = F.abs(F.sum("share").over(Window.partitionBy(F.lit(1))) - 1) < 1e-9
    return both.select("source", "short", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"), met.alias("met"), shares.alias("shares"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = shared_spans(table(spark, d, "documents"), "doc_id", "text").pairs()
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    report = shared_spans(table(spark, d, "documents"), "doc_id", "text").report()
    return report.withColumnRenamed("id", "doc_id")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"), "doc_id", "text").spans.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_percentiles, p1_from_days, p1_counts, p1_near, p1_days_near, p7_found, p7_containers, p7_sizes, p7_fill, p7_tight, p8_found, p8_report, p8_copies, p8_bounds, p8_kept, p9_found, p9_shared, p9_spans)
    return {f.__name__: f for f in found}


_TOKENS = rf"len(regexp_extract_all(coalesce(text, ''), '[{WORD}]+|[^{WORD}{BLANK}]+'))"

_MIX = f"""
  d AS (SELECT lower(trim(source, ' ')) AS s, {_TOKENS} AS t FROM documents),
  m AS (SELECT *, lower(trim(source, ' ')) AS s FROM mix_targets),
  n AS (SELECT m.source, m.target_weight, m.max_repeats, count(d.t) AS records, coalesce(sum(d.t), 0) AS tokens FROM m LEFT JOIN d USING (s) GROUP BY ALL),
  a AS (SELECT sum(tokens) AS whole FROM n)
"""


_NEAR = f"""
WITH u AS (SELECT DISTINCT * FROM time_series_table),
  v AS (SELECT tag_1, 'field_1' AS column_name, field_1 AS x FROM u UNION ALL SELECT tag_1, 'field_2', field_2 FROM u)
SELECT tag_1, column_name, percentile, count(*) AS n, true AS near FROM v, (SELECT unnest([{', '.join(map(str, PERCENTILES))}])::DOUBLE AS percentile) q
WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL"""

# Every window of 200 characters of every text, by a hash of its characters. Windows are cut from pieces of 1,199
# characters, as a place in a long text takes long to find.
_WINDOWS = """
  pieces AS (SELECT doc_id, 1000 * j AS base, substr(text, 1000 * j + 1, 1199) AS part
    FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 200) // 1000 + 1)) AS j FROM documents WHERE length(text) >= 200)),
  w AS (SELECT doc_id, base + i AS i, md5_number(substr(part, i, 200)) AS h FROM (SELECT doc_id, base, part, unnest(range(1, least(1000, length(part) - 199) + 1)) AS i FROM pieces)),
  s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
  m AS (SELECT w.* FROM w SEMI JOIN s USING (h))
"""

_SPANS = f"""{_WINDOWS},
  g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM m),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM g),
  spans AS (SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS start, CAST(max(i) + 199 AS INTEGER) AS stop FROM n GROUP BY doc_id, part)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_counts": """
WITH u AS (SELECT DISTINCT * FROM time_series_table),
  v AS (SELECT tag_1, tag_2, 'field_1' AS column_name, CAST(field_1 AS DOUBLE) AS x FROM u UNION ALL SELECT tag_1, tag_2, 'field_2', CAST(field_2 AS DOUBLE) FROM u)
SELECT tag_1, tag_2, column_name, count(*) AS n, min(x) AS lowest, max(x) AS highest FROM v WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL""",
        "p1_near": _NEAR,
        "p1_days_near": _NEAR,
        "p7_tight": f"SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split, true AS tight FROM (SELECT {_TOKENS} AS n FROM documents)",
        "p8_kept": f"WITH {_MIX} SELECT source, tokens * max_repeats < target_weight * whole AS short, true AS capped, true AS met, true AS shares FROM n, a",
        "p9_found": f"WITH {_WINDOWS}, c AS (SELECT DISTINCT h, doc_id FROM m) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM c a JOIN c b ON a.h = b.h AND a.doc_id < b.doc_id",
        "p9_spans": f"WITH {_SPANS} SELECT doc_id, start, stop FROM spans",
        "p9_shared": f"""
WITH {_SPANS}, t AS (SELECT doc_id, sum(stop - start) AS shared, count(*) AS runs FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS characters, CAST(coalesce(shared, 0) AS BIGINT) AS shared_characters, coalesce(runs, 0) AS shared_runs,
  CASE WHEN length(text) > 0 THEN coalesce(shared, 0) / length(text) ELSE 0.0 END AS share FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL""",
        "p7_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 2048",
        "p7_sizes": f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS n FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS tokens, CAST(ceil(n / 2048) AS BIGINT) AS pieces, CAST(least(n, 2048) AS INTEGER) AS largest FROM t WHERE n > 0""",
        "p8_found": f"WITH {_MIX} SELECT source FROM n, a WHERE tokens * max_repeats < target_weight * whole",
        "p8_bounds": f"""
WITH {_MIX} SELECT source, records, CAST(tokens AS BIGINT) AS tokens, round(target_weight * whole, 3) AS target_size, tokens * max_repeats < target_weight * whole AS short FROM n, a""",
    }
