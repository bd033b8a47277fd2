"""Overlapping intervals of a stream: the periods of each entity, kept up to date in keyed state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.intervals import IntervalMap
from tidemill.runtime import quoted, struct_text


def stream_intervals(df: DataFrame, keys: Sequence[str], start_us: str, end_us: str, tolerance_us: int = 0, time: str | None = None) -> DataFrame:
    """Per micro-batch the periods that it made or changed: the keys, `kind`, `start_us`, `end_us`.

    An entity's state is its ordered interval map; an insertion finds its overlaps by binary search, and only what it
    changed comes out. `kind` is `period` for a period as it is now, `replaced` for one that was merged into another
    since. Bounds are whole microseconds; rows with a null bound or with the end before the start are ignored. Null keys
    are an entity of their own. Use output mode `update`.

    `time` names a timestamp with a watermark. A period that ended more than the tolerance before the watermark comes
    out once more as `closed` and leaves the state, which so holds no more than the watermark's delay of each entity
    and nothing of entities that are silent. Rows older than the watermark are dropped by Spark; one whose interval
    reaches back to a closed period starts a period of its own. Without `time` the state keeps all periods.
    """
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    extra = [F.col(quoted(time)).alias("t")] if time else []
    rows = df.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.col(quoted(start_us)).cast("bigint").alias("s"), F.col(quoted(end_us)).cast("bigint").alias("e"), *extra)
    rows = rows.where("s IS NOT NULL AND e IS NOT NULL AND s <= e")
    out = ", ".join(filter(None, [struct_text(rows, names), "kind string, start_us bigint, end_us bigint"]))

    def update(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap(tolerance_us)
        if state.exists:
            held.starts, held.ends = (list(x) for x in state.get)
        made: set[tuple[int, int]] = set()
        gone: set[tuple[int, int]] = set()
        for part in [] if state.hasTimedOut else parts:
            for s, e in zip(part["s"].tolist(), part["e"].tolist()):
                place = held.within(s, e)
                old = list(zip(held.starts[place], held.ends[place]))
                held.insert(s, e)
                new = (held.starts[place.start], held.ends[place.start])
                if old != [new]:
                    gone |= set(old) - made
                    made = (made - set(old)) | {new}
        closed: list[tuple[int, int]] = []
        if time:
            mark = state.getCurrentWatermarkMs()
            # Disjoint intervals in order have their ends in order.
            count = bisect_left(held.ends, mark * 1000 - tolerance_us)
            closed = list(zip(held.starts[:count], held.ends[:count]))
            del held.starts[:count], held.ends[:count]
        if not held.starts:
            if state.exists:
                state.remove()
        elif made or gone or closed or not state.exists or state.hasTimedOut:
            state.update((held.starts, held.ends))
        if time and held.starts:
            state.setTimeoutTimestamp(max(mark + 1, (held.ends[0] + tolerance_us) // 1000 + 1))
        changed = [("replaced", *x) for x in sorted(gone)] + [("period", *x) for x in sorted(made)] + [("closed", *x) for x in closed]
        found = pd.DataFrame(changed, columns=["kind", "start_us", "end_us"])
        for i, n in enumerate(names):
            found.insert(i, n, [key[i]] * len(found))
        yield found

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    grouped = rows.groupBy(*names).applyInPandasWithState(update, out, "starts array<bigint>, ends array<bigint>", "update", timeout)
    return grouped.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "kind", "start_us", "end_us")
