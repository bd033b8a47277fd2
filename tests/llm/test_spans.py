from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import spans
from tidemill.llm.spans import Plan, shared_spans

LONG = 40


def brute(texts, length):
    where = defaultdict(set)
    for i, t in texts.items():
        for j in range(len(t or "") - length + 1):
            where[t[j : j + length]].add(i)
    pairs, cover = set(), {}
    for own in where.values():
        own = sorted(own)
        pairs |= {(a, b) for k, a in enumerate(own) for b in own[k + 1 :]}
    for i, t in texts.items():
        marks = np.zeros(len(t or ""), bool)
        for j in range(len(t or "") - length + 1):
            if len(where[t[j : j + length]]) > 1:
                marks[j : j + length] = True
        cover[i] = int(marks.sum())
    return pairs, cover


def check(spark, texts, length=LONG, hot=spans.HOT):
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc long, body string, id int").repartition(3)
    found = shared_spans(df, "doc", "body", length, hot)
    pairs, cover = brute(texts, length)
    rows = found.pairs().collect()
    assert {(r["id_a"], r["id_b"]) for r in rows} == pairs and len(rows) == len(pairs)
    report = {r["id"]: r for r in found.report().collect()}
    assert {i: r["shared_characters"] for i, r in report.items()} == cover
    assert {i: r["characters"] for i, r in report.items()} == {i: len(t or "") for i, t in texts.items()}
    for r in found.spans.collect():
        assert r["stop"] - r["start"] >= length
    return found


def words(rng, n, alphabet="abcdefghij "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_planted_runs_of_all_lengths(spark):
    rng = random.Random(3)
    texts = {i: words(rng, rng.randint(0, 300)) for i in range(40)}
    for k in range(60):
        a, b = rng.sample(sorted(texts), 2)
        run = words(rng, LONG - 2 + k % 50)
        for i in (a, b):
            at = rng.randint(0, len(texts[i]))
            texts[i] = texts[i][:at] + run + texts[i][at:]
    check(spark, texts)


def test_exact_length_and_one_less(spark):
    rng = random.Random(4)
    run = words(rng, LONG)
    check(spark, {1: "x" + run + "y", 2: "z" + run, 3: run[:-1] + "!", 4: run})


def test_copies_near_copies_and_boilerplate(spark):
    rng = random.Random(5)
    base = words(rng, 500)
    texts = {i: base for i in range(10)}
    texts |= {20 + i: base[: 40 * i] + "#" + base[40 * i + 1 :] for i in range(10)}
    head = words(rng, 90)
    texts |= {50 + i: head + words(rng, 150) for i in range(30)}
    check(spark, texts)


def test_repeats_within_one_text_do_not_count(spark):
    rng = random.Random(6)
    run = words(rng, 100)
    check(spark, {1: run + "|" + run, 2: words(rng, 200), 3: None, 4: "", 5: "short"})


def test_periodic_texts_and_other_scripts(spark):
    check(spark, {1: "a" * 100, 2: "b" + "a" * 70, 3: "ab" * 60, 4: "ba" * 40, 5: "\U0001f642é日" * 30, 6: "x" + "\U0001f642é日" * 20})


def test_groups_beyond_a_task(spark, monkeypatch):
    rng = random.Random(7)
    head = words(rng, 60)
    texts = {i: head + words(rng, 30) for i in range(60)}
    monkeypatch.setattr(spans, "CLOSE", 5)
    pieces = list(spans.bounded_groups(iter([pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 1, 1, 1, 1, 2, 3, 3])], names=["k"])]), "k", 0, 2, 3))
    assert sum(t.num_rows for t, _ in pieces) == 10
    check(spark, texts)


@pytest.mark.parametrize(("hot", "parts"), [(3, 256), (3, 2), (12, 5), (25, 1)])
def test_hot_anchors_are_shared_out(spark, monkeypatch, hot, parts):
    """Boilerplate with own text around it, repeated in a text, in whole copies and with changed characters."""
    monkeypatch.setattr(spans, "PARTS", parts)
    rng = random.Random(hot)
    head, tail = words(rng, 130), words(rng, 70)
    texts = {i: words(rng, 20 + i) + head + words(rng, 30 + i % 7) + tail for i in range(40)}
    texts |= {50 + i: head[: 3 * i] + "#" + head[3 * i + 1 :] for i in range(12)}
    texts |= {70 + i: texts[1] for i in range(8)}
    texts[90] = head + "|" + head + "|" + tail
    texts |= {100 + i: words(rng, 120) for i in range(10)}
    check(spark, texts, hot=hot)


def test_hot_anchors_are_found(spark):
    rng = random.Random(9)
    head = words(rng, 60)
    rows = [(i, words(rng, 50) + head) for i in range(50)] + [(100 + i, words(rng, 90)) for i in range(20)]
    texts = spark.createDataFrame(rows, "id long, text string")
    some, all_ = spans._hot_anchors(texts, 70, Plan(LONG), 40), spans._hot_anchors(texts, 70, Plan(LONG), 0)
    assert 0 < len(some) < 6 and len(all_) > 60 and set(some) <= set(all_)
    assert len(spans._hot_anchors(texts, 70, Plan(LONG), 70)) == 0


@pytest.mark.parametrize("cuts", [1, 2, 3, 7])
def test_bounded_groups_keep_all_rows(cuts):
    keys = [0] * 2 + [5] * 11 + [6] + [7] * 3 + [9] * 20 + [11]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + cuts], pa.int64())], names=["k"]) for i in range(0, len(keys), cuts)]
    out = list(spans.bounded_groups(iter(batches), "k", 0, 4, 8))
    assert [k for t, _ in out for k in t.column("k").to_pylist()] == keys
    seen = set()
    for t, whole in out:
        own = set(t.column("k").to_pylist())
        if whole:
            assert not own & seen
        seen |= own


def test_texts_longer_than_a_stretch(monkeypatch):
    monkeypatch.setattr(spans, "STRETCH", 1 << 9)
    plan, rng = Plan(LONG), random.Random(8)
    body = words(rng, 3000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([body])], names=["id", "text"])
    covered = []
    for out in spans._anchor_rows(iter([batch]), plan):
        for at, more in zip(out.column("at").to_pylist(), out.column("more").to_pylist()):
            covered += range(at, at + more + 1)
    assert sorted(covered) == list(range(len(body) - LONG + 1))


def test_empty_table(spark):
    check(spark, {})


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=120), st.text("ab", max_size=120))
def test_every_window_has_one_anchor_and_the_same_one_everywhere(left, right):
    plan = Plan(16)
    found = []
    for text in (left, right):
        where = {}
        if len(text) >= plan.length:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            hasher = spans.Hasher()
            hasher.load(points)
            keys = hasher.every(plan.width)
            place, first, last = spans.anchors(keys, np.full(len(points), len(points)), plan.window, plan.width)
            for p, a, b in zip(place, first, last):
                for s in range(a, b + 1):
                    assert s not in where
                    where[s] = p - s
            assert sorted(where) == list(range(len(text) - plan.length + 1))
        found.append({(text[s : s + plan.length], o) for s, o in where.items()})
    offsets = defaultdict(set)
    for window, o in found[0] | found[1]:
        offsets[window].add(o)
    assert all(len(o) == 1 for o in offsets.values())
