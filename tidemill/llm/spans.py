"""Long runs of characters that several texts have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import durable, int64, quoted

#: Characters of a text that are looked at together; longer texts are gone through in overlapping stretches.
STRETCH = 1 << 20
#: A side of a join below so many ids (8 MB) is broadcast, a larger one is shuffled.
FEW_IDS = 1_000_000
#: Occurrences of one anchor that are compared with each other in one task; more are compared by a shuffle.
CLOSE = 100_000

#: An anchor with more occurrences is hot: they are shared out over so many tasks.
HOT, PARTS = 1_000_000, 256

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hasher:
    """Hashes of windows of any length at all positions of a text, by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self) -> None:
        self._up, self._down = _powers(1 << 12)

    def load(self, points: np.ndarray) -> None:
        n = len(points)
        if n >= len(self._up):
            self._up, self._down = _powers(max(2 * len(self._up), n + 1))
        mixed = points.astype(np.uint64)
        mixed += np.uint64(1)
        mixed *= np.uint64(0xD1B54A32D192ED03)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed *= self._down[:n]
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed, out=self._sums[1:])

    def every(self, width: int) -> np.ndarray:
        """The hash of each window of `width`."""
        found = self._sums[width:] - self._sums[:-width]
        found *= self._up[: len(found)]
        return _finish(found)

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return _finish((self._sums[starts + width] - self._sums[starts]) * self._up[starts])


def _finish(found: np.ndarray) -> np.ndarray:
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(32)
    return found


def sliding(values: np.ndarray, width: int, combine: np.ufunc, fill: int) -> np.ndarray:
    """combine over values[i .. i + width - 1] for every i; places beyond the end count as `fill`."""
    n = len(values)
    blocks = n // width + 2
    padded = np.full(blocks * width, np.uint64(fill), np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = combine.accumulate(grid, axis=1).ravel()
    right = combine.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return combine(right[:n], left[width - 1 : width - 1 + n])


def anchors(keys: np.ndarray, ends: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor its position, and the first and last neighbourhood whose least, among equals last, window it is.

    `keys` has the hash of the window of `width` at every position, `ends` the end of the text that it is in. A
    neighbourhood is `window` positions from its start on; it lies in one text, and each has exactly one anchor.
    """
    n = len(keys)
    low = np.uint64(STRETCH - 1)
    ordered = (keys & ~low) | (low - (np.arange(n, dtype=np.uint64) & low))
    least = sliding(ordered, window, np.minimum, (1 << 64) - 1)
    least[np.arange(n) + window - 1 + width > ends[:n]] = 0
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], n) - 1
    some = least[first] > 0
    first, last = first[some], last[some]
    return (low - (least[first] & low)).astype(np.int64), first, last


class Plan:
    """Sizes for a least length of a common run.

    A window of the full length has one anchor: of the shorter windows in it, each `width` long, the one with the
    least hash. Wherever the window occurs, its anchor is the same. The ways in which a window can lie around its
    anchor make four groups of `step`; the `wide` characters that all of a group share stand for it in a first look.
    """

    def __init__(self, length: int) -> None:
        if length < 16:
            raise ValueError("a common run has at least 16 characters here")
        self.length = length
        self.width = length // 2 + 1
        self.window = length - self.width + 1
        self.step = -(-self.window // 4)
        self.wide = length - self.step + 1


def _stretches(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of texts one after the other, at most STRETCH: points, starts, ids, position of each in its text."""
    points: list[np.ndarray] = []
    ids: list[int] = []
    offsets: list[int] = []
    held = 0

    def out():
        sizes = np.array([len(p) for p in points], np.int64)
        return np.concatenate(points), np.cumsum(sizes) - sizes, np.array(ids, np.int64), np.array(offsets, np.int64)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = 0
            while True:
                part = whole[at : at + STRETCH]
                if held and held + len(part) > STRETCH:
                    yield out()
                    points, ids, offsets, held = [], [], [], 0
                points.append(part)
                ids.append(i)
                offsets.append(at)
                held += len(part)
                if at + STRETCH >= len(whole):
                    break
                at += STRETCH - overlap
    if points:
        yield out()


#: Bits of an anchor row's key that hold four numbers of six bits; the bits above them are the anchor's.
LANES = 24


def _anchor_rows(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Per anchor: `key` (40 bits of its hash; for each group of its windows that occurs 6 bits of the hash of what
    they share, else 0), `id`, `at` (where its first window starts), `more` (how many windows follow) and `whole`
    (the hash of all characters of its windows, and of where the anchor lies in them)."""
    hasher = Hasher()
    for points, starts, ids, offsets in _stretches(batches, plan.length - 1):
        if len(points) < plan.length:
            continue
        sizes = np.diff(np.append(starts, len(points)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        hasher.load(points)
        keys = hasher.every(plan.width)
        place, first, last = anchors(keys, (starts + sizes)[owner], plan.window, plan.width)
        if not len(place):
            continue
        own = owner[place]
        key = (keys[place] >> np.uint64(LANES)) << np.uint64(LANES)
        for k in range(4):
            there = (place - last < (k + 1) * plan.step) & (place - first >= k * plan.step)
            core = hasher.at(place[there] - k * plan.step, plan.wide)
            key[there] |= ((core >> np.uint64(40)) % np.uint64(63) + np.uint64(1)) << np.uint64(6 * k)
        whole = np.empty(len(place), np.uint64)
        for span in np.unique(last - first).tolist():
            same = np.flatnonzero(last - first == span)
            whole[same] = hasher.at(first[same], plan.length + span)
        whole = _mix(whole ^ _mix(((place - first) * 1_000 + (last - first)).astype(np.uint64)))
        at = first - starts[own] + offsets[own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(ids[own]), pa.array(at.astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(whole.view(np.int64))],
            names=["key", "id", "at", "more", "whole"],
        )


def _mix(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


_SETTLED = "key bigint, id bigint, at int, more int, class bigint, settled boolean"


def _shared_anchors(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by key: occurrences whose windows may occur in another text.

    Those of hot anchors, of which a task has only a part, are passed on undecided: `settled` null, `class` their whole.

    An occurrence is `settled` if all that may share a window with it have the very same windows; `class` then names
    their texts. The rest is to be compared character by character.
    """
    for table, complete in bounded_groups(batches, "key", LANES, 4 * CLOSE, 1_000_000):
        key, ids = int64(table.column("key")).view(np.uint64), int64(table.column("id"))
        anchor = key >> np.uint64(LANES)
        many = np.isin(anchor, hot)
        if many.any():
            rows = np.flatnonzero(many)
            yield _occurrences(table, rows, int64(table.column("whole"))[rows], None)
            rows = np.flatnonzero(~many)
            table, key, ids, anchor = table.take(pa.array(rows)), key[rows], ids[rows], anchor[rows]
            if not len(rows):
                continue
        if not complete:
            yield _occurrences(table, np.arange(table.num_rows), np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, bool))
            continue
        # Most anchors occur once; only the rest is looked at.
        new = np.append(True, anchor[1:] != anchor[:-1])
        several = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(several):
            continue
        key, ids, anchor = key[several], ids[several], anchor[several]
        whole = int64(table.column("whole"))[several].view(np.uint64)
        keep, mixed = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for k in range(4):
            lane = (key >> np.uint64(6 * k)) & np.uint64(63)
            order = np.lexsort((ids, lane, anchor))
            order = order[lane[order] > 0]
            if not len(order):
                continue
            begin = _begins(anchor[order], lane[order])
            size = np.diff(np.append(begin, len(order)))
            multi = ids[order][begin] != ids[order][begin + size - 1]
            w = whole[order]
            differ = np.logical_or.reduceat(w != np.repeat(w[begin], size), begin)
            keep[order] |= np.repeat(multi, size)
            mixed[order] |= np.repeat(multi & differ, size)
        pure = np.flatnonzero(keep & ~mixed)
        names = np.zeros(len(key), np.uint64)
        if len(pure):
            order = pure[np.lexsort((ids[pure], whole[pure], anchor[pure]))]
            begin = _begins(anchor[order], whole[order])
            size = np.diff(np.append(begin, len(order)))
            fresh = np.append(True, ids[order][1:] != ids[order][:-1])
            fresh[begin] = True
            names[order] = np.repeat(np.add.reduceat(np.where(fresh, _mix(ids[order].view(np.uint64)), np.uint64(0)), begin), size)
        hit = np.flatnonzero(keep)
        if len(hit):
            yield _occurrences(table, several[hit], names[hit].view(np.int64), ~mixed[hit])


def _begins(*columns: np.ndarray) -> np.ndarray:
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _occurrences(table: pa.Table, rows: np.ndarray, names: np.ndarray, settled: np.ndarray | None) -> pa.RecordBatch:
    taken = table.select(["key", "id", "at", "more"]).take(pa.array(rows)).combine_chunks()
    columns = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in taken.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(names), pa.nulls(len(rows), pa.bool_()) if settled is None else pa.array(settled)], names=["key", "id", "at", "more", "class", "settled"])


def bounded_groups(batches: Iterator[pa.RecordBatch], key: str, shift: int, rows: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Like complete_groups for one key without its lowest `shift` bits, but a group beyond `most` rows comes in parts,
    marked False."""
    part: list[pa.Table] = []
    count = 0
    oversized = None

    def split(table: pa.Table, last: bool) -> tuple[list[tuple[pa.Table, bool]], list[pa.Table]]:
        nonlocal oversized
        values = int64(table.column(key)) >> shift
        out = []
        if oversized is not None:
            stop = int(np.searchsorted(values != oversized, True)) if (values != oversized).any() else len(values)
            if stop:
                out.append((table.slice(0, stop), False))
            table, values = table.slice(stop), values[stop:]
            if len(values):
                oversized = None
        if not len(values):
            return out, []
        cut = len(values) if last else int(np.flatnonzero(np.append(True, values[1:] != values[:-1]))[-1])
        if cut:
            out.append((table.slice(0, cut), True))
        rest = table.slice(cut)
        if rest.num_rows > most:
            oversized = int(values[-1])
            out.append((rest, False))
            return out, []
        return out, [rest] if rest.num_rows else []

    for batch in batches:
        if not batch.num_rows:
            continue
        part.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= rows:
            out, part = split(pa.concat_tables(part).combine_chunks(), False)
            yield from out
            count = 0
    if part:
        out, _ = split(pa.concat_tables(part).combine_chunks(), True)
        yield from out


def _hot_anchors(texts: DataFrame, count: int, plan: Plan, hot: int) -> np.ndarray:
    """Anchors of which there are probably more than `hot` occurrences, counted in a sample of the texts.

    It only says what is shared out over tasks: the result doesn't depend on it. Of fewer texts than `hot` there are
    none. Of the sampled rows each of the list takes hot / 64, so the list is short whatever the texts.
    """
    if count <= hot:
        return np.zeros(0, np.uint64)
    # An anchor at the limit is seen about 1,000 times.
    one_in = max(1, min(64, hot // 1000))
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)
    seen = some.mapInArrow(lambda b: _anchor_rows(b, plan), "key bigint, id bigint, at int, more int, whole bigint")
    often = seen.groupBy(F.shiftrightunsigned("key", LANES).alias("anchor")).count().where(F.col("count") > hot / one_in)
    return np.sort(np.array([r["anchor"] for r in often.collect()], np.uint64))


def _spread(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """Rows put together by anchor, those of hot ones by anchor and part of the texts, in order of their key."""
    anchor = F.shiftrightunsigned("key", LANES)
    if not len(hot):
        return rows.repartition(anchor).sortWithinPartitions("key")
    part = F.when(anchor.isin(*hot.tolist()), F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(-1)
    return rows.repartition(anchor, part).sortWithinPartitions("key")


def _decided(shared: DataFrame) -> DataFrame:
    """Occurrences of hot anchors decided like the others, by their variants: all with the same windows are one.

    What a variant stands for is counted over all tasks; lanes, at most 4 x 63 of an anchor, tell whether its windows
    occur in another text, and whether in another variant. Only variants of which that is so are joined back.
    """
    open_ = shared.where("settled IS NULL")
    texts = open_.select("key", F.col("class").alias("whole"), "id").distinct()
    variants = durable(texts.groupBy("key", "whole").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.bit_xor(F.xxhash64("id")).alias("name")))
    lanes = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("key", 6 * k).bitwiseAND(F.lit(63)).alias("lane")) for k in range(4)])
    spread = variants.select("*", F.shiftrightunsigned("key", LANES).alias("anchor"), F.inline(lanes)).where("lane > 0")
    totals = spread.groupBy("anchor", "k", "lane").agg((F.min("a") != F.max("b")).alias("multi"), (F.min("whole") != F.max("whole")).alias("differ")).where("multi")
    totals = totals.select(F.col("anchor").alias("__anchor"), F.col("k").alias("__k"), F.col("lane").alias("__lane"), "differ")
    same = [F.col("anchor") == F.col("__anchor"), F.col("k") == F.col("__k"), F.col("lane") == F.col("__lane")]
    kept = spread.join(_small(totals), same).groupBy("key", "whole").agg((~F.bool_or("differ")).alias("__pure"), F.first("name").alias("__name"))
    kept = _small(kept.select(F.col("key").alias("__key"), F.col("whole").alias("__whole"), "__pure", "__name"))
    found = open_.join(kept, (F.col("key") == F.col("__key")) & (F.col("class") == F.col("__whole")))
    return shared.where("settled IS NOT NULL").unionByName(found.select("key", "id", "at", "more", F.col("__name").alias("class"), F.col("__pure").alias("settled")))


_CASES = "span boolean, id bigint, class bigint, start int, stop int, sure boolean"


def _compare(table: pa.Table, plan: Plan, whole: bool) -> Iterator[pa.RecordBatch]:
    """Occurrences of anchors with their surroundings: spans shared with another text, and classes of texts.

    All windows of the full length that an anchor stands for are compared. Classes of the same texts are one, named
    by their texts. Of a part of a group (`whole` false) every window is passed on as a class of its own, to be
    compared elsewhere.
    """
    texts = table.column("around").to_pylist()
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    ids, first = int64(table.column("id")), int64(table.column("from"))
    starts = np.cumsum(sizes) - sizes
    joined = np.concatenate(points)
    hasher = Hasher()
    hasher.load(joined)
    number = sizes - plan.length + 1
    owner = np.repeat(np.arange(len(sizes)), number)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    window = hasher.at(starts[owner] + shift, plan.length)
    if not whole:
        yield _cases(False, ids[owner], window.view(np.int64), (first[owner] + shift), (first[owner] + shift + plan.length), False)
        return
    # The windows of an occurrence are all those whose anchor it is, so equal windows are in the same group.
    order = np.lexsort((ids[owner], window))
    w, d = window[order], ids[owner][order]
    new = np.append(True, w[1:] != w[:-1])
    fresh = new | np.append(True, d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    texts_in = np.add.reduceat(fresh.astype(np.int64), begin)
    spread = np.repeat(texts_in > 1, np.diff(np.append(begin, len(w))))
    shared = np.zeros(len(owner), bool)
    shared[order[spread]] = True
    hit = np.flatnonzero(shared)
    if not len(hit):
        return
    # The shared windows of an occurrence overlap each other, so they make one span.
    who = owner[hit]
    lead = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
    last = np.append(lead[1:], len(who)) - 1
    at = who[lead]
    yield _cases(True, ids[at], np.zeros(len(at), np.int64), first[at] + shift[hit[lead]], first[at] + shift[hit[last]] + plan.length, True)
    name = np.add.reduceat(np.where(fresh, _mix(d.view(np.uint64)), np.uint64(0)), begin)
    multi = np.flatnonzero(texts_in > 1)
    _, one = np.unique(name[multi], return_index=True)
    chosen = multi[one]
    finish = np.append(begin[1:], len(w))
    members = np.concatenate([np.arange(begin[c], finish[c]) for c in chosen.tolist()])
    head = np.repeat(begin[chosen], (finish - begin)[chosen])
    members, head = members[fresh[members]], head[fresh[members]]
    # Equal hashes are held against the characters themselves.
    place = lambda x: (starts[owner] + shift)[order[x]][:, None] + np.arange(plan.length)
    same = np.concatenate([(joined[place(members[a : a + 4096])] == joined[place(head[a : a + 4096])]).all(axis=1) for a in range(0, len(members), 4096)])
    members, head = members[same], head[same]
    yield _cases(False, d[members], np.repeat(name[multi], 1)[np.searchsorted(begin[multi], head)].view(np.int64), np.zeros(len(members), np.int64), np.zeros(len(members), np.int64), True)


def _cases(span: bool, ids: np.ndarray, class_: np.ndarray, start: np.ndarray, stop: np.ndarray, sure: bool) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, span)), pa.array(ids), pa.array(class_), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(np.full(n, sure))],
        names=["span", "id", "class", "start", "stop", "sure"],
    )


class Shared:
    """`spans` (id, start, stop: maximal stretches found elsewhere) and `classes` (class, id: texts with a run in common)."""

    def __init__(self, spans: DataFrame, classes: DataFrame, texts: DataFrame) -> None:
        self.spans, self.classes, self.texts = spans, classes, texts

    def report(self) -> DataFrame:
        """One row per text: `id`, `characters`, `shared_characters`, `shared_runs`, `share`."""
        sums = self.spans.groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared"), F.count("*").alias("runs"))
        sums = sums.withColumnRenamed("id", "__id")
        both = self.texts.join(sums, F.col("id") == F.col("__id"), "left")
        shared = F.coalesce("shared", F.lit(0))
        return both.select(
            "id",
            F.col("size").cast("bigint").alias("characters"),
            shared.cast("bigint").alias("shared_characters"),
            F.coalesce("runs", F.lit(0)).cast("bigint").alias("shared_runs"),
            F.when(F.col("size") > 0, shared / F.col("size")).otherwise(0.0).alias("share"),
        )

    def pairs(self) -> DataFrame:
        """Each pair of texts with a run in common, once: `id_a` below `id_b`. As many rows as there are pairs."""
        a = self.classes.select(F.col("class"), F.col("id").alias("id_a"))
        b = self.classes.select(F.col("class").alias("__class"), F.col("id").alias("id_b"))
        return a.join(b, (F.col("class") == F.col("__class")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b").distinct()


def shared_spans(df: DataFrame, key: str, text: str, length: int = 200, hot: int = HOT) -> Shared:
    """Runs of at least `length` characters (code points) that occur in more than one text.

    A span is a maximal stretch of a text each of whose characters lies in such a run. Repetition within one text
    doesn't count. Null, empty and shorter texts share nothing, but are in the report; texts may be of any length.
    The key is a whole number and unique; rows with a null key are ignored. Texts that are equal as a whole are
    compared once. An empty table gives empty results.

    Method: every window of `length` has an anchor, the shorter window (length / 2 + 1) in it with the least hash;
    the hashes of all windows of a text are taken, and about one in 50 is an anchor. Anchors are shuffled by hash,
    with a hash of all characters of the windows they stand for. Where all texts that may share a window agree in
    all of them, that settles it; the others are fetched with their characters and compared window by window.
    Shared windows are joined to maximal spans. Nothing is broadcast but lists of at most a million ids (below 60 MB);
    texts in classes of any size are found without pairs. Anchors with more than `hot` occurrences are shared out over
    tasks, so that a text that a third of all records quote is no one's task alone.

    Exactness: equal windows always count as equal. Unequal ones never do where characters are compared; settled
    anchors, hot ones and groups that are too large for a task take windows for equal if the 64-bit hash of their
    characters (of settled ones: of all their characters, beside 40 bits of the anchor's) is, whole copies if their
    MD5 is.
    """
    plan = Plan(length)
    rows = df.select(F.col(quoted(key)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text")).where("id IS NOT NULL")
    sized = durable(rows.select("id", F.coalesce(F.char_length("text"), F.lit(0)).alias("size"), F.when(F.char_length("text") >= length, F.md5(F.col("text").cast("binary"))).alias("digest")))
    groups = sized.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.xxhash64(F.first("digest"), F.lit("copies")).alias("class")).where("n > 1")
    copies = durable(sized.join(groups, "digest").select("id", "first", "class", "size"))
    again = copies.where("id <> first").select("id")
    long = rows.where(F.char_length("text") >= length)
    long = long.join(_small(again), "id", "left_anti")

    found = long.mapInArrow(lambda b: _anchor_rows(b, plan), "key bigint, id bigint, at int, more int, whole bigint")
    often = _hot_anchors(long, sized.count(), plan, hot)
    shared = durable(_spread(found, often).mapInArrow(lambda b: _shared_anchors(b, often), _SETTLED))
    if len(often):
        shared = durable(_decided(shared))
    mixed = shared.where("NOT settled")
    places = mixed.groupBy("id").agg(F.collect_list(F.struct("key", "at", "more")).alias("places"))
    wanted = long.join(_small(mixed.select("id").distinct()), "id", "left_semi").join(places, "id")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for i, body, at in zip(some.column("id").to_pylist(), some.column("text").to_pylist(), some.column("places").to_pylist()):
                    for place in at:
                        begin = place["at"]
                        out[0].append(place["key"])
                        out[1].append(i)
                        out[2].append(begin)
                        out[3].append(body[begin : begin + place["more"] + plan.length])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["key", "id", "from", "around"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, complete in bounded_groups(batches, "key", LANES, 4_000, CLOSE):
            # Parts of oversized groups, and of hot ones, are gone through in steps of bounded memory.
            many = np.isin(int64(table.column("key")).view(np.uint64) >> np.uint64(LANES), often)
            if not complete:
                many[:] = True
            for whole in (True, False):
                rows = np.flatnonzero(many != whole)
                some = table if len(rows) == table.num_rows else table.take(pa.array(rows)).combine_chunks()
                for a in range(0, len(rows), len(rows) if whole else 4_000):
                    yield from _compare(some.slice(a, len(rows) if whole else 4_000), plan, whole)

    around = wanted.select("id", "text", "places").mapInArrow(surroundings, "key bigint, id bigint, `from` int, around string")
    cases = durable(_spread(around, often).mapInArrow(compare, _CASES))
    unsure = cases.where("NOT sure")
    multi = unsure.groupBy("class").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select(F.col("class").alias("__class"))
    checked = unsure.join(multi, F.col("class") == F.col("__class"), "left_semi")
    settled = shared.where("settled").select("id", F.col("at").alias("start"), (F.col("at") + F.col("more") + F.lit(length)).alias("stop"), "class")
    spans = cases.where("span").select("id", "start", "stop").unionByName(checked.select("id", "start", "stop")).unionByName(settled.select("id", "start", "stop"))
    classes = cases.where("sure AND NOT span").select("class", "id").unionByName(checked.select("class", "id")).unionByName(settled.select("class", "id")).distinct()
    # What holds for the first of equal texts holds for all of them.
    firsts = copies.where("id <> first").select(F.col("id").alias("__copy"), F.col("first").alias("__first"))
    copied = classes.join(firsts, F.col("id") == F.col("__first")).select("class", F.col("__copy").alias("id"))
    classes = classes.unionByName(copied).unionByName(copies.select("class", "id"))
    every = spans.join(copies.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti").unionByName(copies.select("id", F.lit(0).alias("start"), F.col("size").alias("stop")))
    return Shared(_islands(every), classes, sized.select("id", "size"))


def _small(ids: DataFrame) -> DataFrame:
    """Ids to join with: broadcast if they are few, counted; otherwise Spark shuffles both sides."""
    ids = durable(ids)
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _islands(spans: DataFrame) -> DataFrame:
    """Spans of each text joined where they touch or overlap."""
    spans = spans.distinct()
    order = Window.partitionBy("id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    numbered = marked.withColumn("__part", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "__part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__part")
