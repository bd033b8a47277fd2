from __future__ import annotations

import random
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm.packing import BestFit, pack_containers
from tidemill.llm.tokens import token_count


def items(spark, sizes, parts=4):
    return spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "id long, size long, container string").repartition(parts)


def check(rows, sizes, capacity):
    """Every token of every item is in exactly one piece, no container is over its capacity, and only large items are split."""
    used, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r["container"]] += r["size"]
        pieces[r["id"]].append((r["piece"], r["first"], r["size"], r["pieces"]))
    assert all(0 < u <= capacity for u in used.values())
    for i, size in enumerate(sizes):
        if not size or size < 0:
            assert i not in pieces
            continue
        own = sorted(pieces[i])
        assert [p[0] for p in own] == list(range(len(own))) and all(p[3] == len(own) for p in own)
        assert len(own) == -(-size // capacity)
        at = 0
        for _, first, part, _ in own:
            assert first == at
            at += part
        assert at == size
    return len(used)


def test_all_is_packed_with_little_space_left(spark):
    rng = random.Random(1)
    sizes = [min(int(rng.lognormvariate(5.5, 1)), 9000) + 1 for _ in range(3000)]
    number = check(pack_containers(items(spark, sizes), "id", F.col("size"), 2048).collect(), sizes, 2048)
    assert number <= 1.02 * sum(sizes) / 2048 + 1


def test_rounds_merge_what_partitions_leave_underfull(spark):
    sizes = [30] * 50 + [70] * 50
    number = check(pack_containers(items(spark, sizes, 20), "id", F.col("size"), 100).collect(), sizes, 100)
    assert 50 <= number <= 52


def test_items_that_do_not_fit_together(spark):
    sizes = [60] * 300
    assert check(pack_containers(items(spark, sizes, 9), "id", F.col("size"), 100, held=40).collect(), sizes, 100) == 300


def test_small_tasks(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    number = check(pack_containers(items(spark, sizes, 6), "id", F.col("size"), 100, held=50).collect(), sizes, 100)
    assert number <= 1.06 * sum(sizes) / 100


def test_edges(spark):
    sizes = [0, None, -5, 100, 101, 1000, 1]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, size long")
    check(pack_containers(df, "id", F.col("size"), 100).collect(), [s or 0 for s in sizes], 100)
    empty = pack_containers(df.where("id < 0"), "id", F.col("size"), 100)
    assert empty.count() == 0 and empty.columns == ["container", "id", "piece", "pieces", "first", "size"]
    twice = spark.createDataFrame([(1, 10), (1, 10), (None, 5)], "id long, size long")
    assert sorted((r["id"] or 0, r["size"]) for r in pack_containers(twice, "id", F.col("size"), 100).collect()) == [(0, 5), (1, 10), (1, 10)]


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_equals_the_plain_rule(sizes):
    fit, left = BestFit(50), []
    for s in sizes:
        fit.put(s, s)
        fitting = [x for x in left if x >= s]
        if fitting:
            left.remove(min(fitting))
            left.append(min(fitting) - s)
        else:
            left.append(50 - s)
    assert sorted(fit.left) == sorted(left)


def test_tokens_are_those_of_the_pattern(spark):
    import re

    texts = ["", None, "Hello, world!!", "a_b c-d 1,5 m²", "é½ ①x y z​", "über-groß: 日本語、テスト", "x\x1cy\x85z", "🙂🙂 ok", "a\n\n\tb", "नमस्ते"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in found] == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]
