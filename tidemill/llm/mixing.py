"""Records from several sources in target shares of the total size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.runtime import durable, quoted

#: Steps of the first and second look for the point where the rounding is cut.
STEPS = 4096


def _by_source(values: dict[str, float], source: Column) -> Column:
    """A number per source; the sources are the rows of the target table, a handful."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs)[source] if pairs else F.lit(None).cast("double")


def normalized(source: Column) -> Column:
    return F.lower(F.trim(source))


class Mix:
    """The outcome of `mix_sources`: `copies` (a row per record of a listed source) and `report` (a row per source)."""

    def __init__(self, copies: DataFrame, report: DataFrame) -> None:
        self.copies, self.report = copies, report


def mix_sources(df: DataFrame, key: str, source: str, size: Column, targets: DataFrame, iterations: int = 60, tolerance: float = 1e-9, seed: int = 7) -> Mix:
    """How often each record is taken so that the sources make up their target weights.

    `targets` has `source`, `target_weight` and `max_repeats`, one row per source; its rows are read to the driver.
    Sources are compared after trimming blanks and lower-casing. With T the size of all records of listed sources,
    a source's target is `target_weight` x T.

    `copies`: the key, `source`, `size`, `rate` double, `copies` int (0 to max_repeats). Records of unlisted or null
    sources aren't in it; those of size 0 or null size get no copy. `report`: `source`, `target_weight`,
    `max_repeats`, `records`, `size`, `target_size` double, `short` boolean (even max_repeats of every record stay
    below the target), `converged` boolean (the dual of the source was solved to `tolerance` within `iterations` steps; if
    not, its rates are off the closest ones, but the rounding still meets the target), `copies`, `mixed_size`, `share` (of all that was mixed; null if nothing was). A source without
    records has 0. A short source contributes max_repeats of everything, the others their target of T.

    Method: entropy balancing. Among all rates between 0 and max_repeats whose sizes add up to the target, those
    closest to one copy each in relative entropy are exp(lambda x size), capped; lambda maximises a concave dual, one
    unknown per source. Newton steps, kept within a bracket, each run as one aggregation over the counts by (source,
    size). The rates are rounded to copies by a hash of the key, shifted per source to where the copies' size meets
    the target; that point is found by two aggregations into 4,096 steps.
    """
    spark = df.sparkSession
    listed = {r["source"].strip(" ").lower(): r for r in targets.collect() if r["source"] is not None}
    weights = {s: float(r["target_weight"]) for s, r in listed.items()}
    caps = {s: int(r["max_repeats"]) for s, r in listed.items()}
    rows = df.select(F.col(quoted(key)).alias("__key"), normalized(F.col(quoted(source))).alias("__source"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint").alias("__size"))
    rows = durable(rows.where(F.col("__source").isin(*listed) if listed else F.lit(False)))
    counts = durable(rows.groupBy("__source", "__size").agg(F.count("*").alias("__n")))
    totals = {r["__source"]: (int(r["n"]), int(r["t"] or 0)) for r in counts.groupBy("__source").agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("__size")).alias("t")).collect()}
    whole = sum(t for _, t in totals.values())
    target = {s: weights[s] * whole for s in listed}
    have = {s: totals.get(s, (0, 0)) for s in listed}
    short = {s: have[s][1] * caps[s] < target[s] for s in listed}
    free = [s for s in listed if not short[s] and have[s][1] > 0 and target[s] > 0]
    # Sizes are measured in the source's mean, so that the unknowns are near 1.
    unit = {s: max(have[s][1] / have[s][0], 1e-9) if have[s][0] else 1.0 for s in listed}

    tilt = {s: 0.0 for s in free}
    low, high = {s: -math.inf for s in free}, {s: math.inf for s in free}
    at_cap = {s for s in free if have[s][1] * caps[s] == target[s]}
    open_ = [s for s in free if s not in at_cap]
    for _ in range(iterations):
        if not open_:
            break
        x = F.col("__size") / _by_source(unit, F.col("__source"))
        power = F.least(_by_source({s: tilt[s] for s in open_}, F.col("__source")) * x, F.lit(60.0))
        cap = _by_source({s: float(caps[s]) for s in open_}, F.col("__source"))
        rate = F.least(F.exp(power), cap)
        slope = F.when(F.exp(power) < cap, F.exp(power) * x).otherwise(0.0)
        mass = F.col("__n") * F.col("__size")
        found = counts.where(F.col("__source").isin(*open_)).groupBy("__source").agg(F.sum(mass * rate).alias("f"), F.sum(mass * slope).alias("g")).collect()
        for r in found:
            s, f, g = r["__source"], r["f"], r["g"]
            off = f - target[s]
            if abs(off) <= tolerance * target[s]:
                open_.remove(s)
                continue
            if off > 0:
                high[s] = min(high[s], tilt[s])
            else:
                low[s] = max(low[s], tilt[s])
            # Newton on the logarithm of the size, which is closer to a line than the size.
            step = tilt[s] - math.log(max(f, 1e-300) / target[s]) * f / g if g > 0 and f > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isfinite(low[s]) and math.isfinite(high[s]):
                    step = (low[s] + high[s]) / 2
                else:
                    step = tilt[s] + (-1.0 if off > 0 else 1.0) * (1 + abs(tilt[s]))
            tilt[s] = step

    cap = _by_source({s: float(caps[s]) for s in listed}, F.col("__source"))
    x = F.col("__size") / _by_source(unit, F.col("__source"))
    tilted = F.least(F.exp(F.least(_by_source({s: tilt[s] for s in free if s not in at_cap}, F.col("__source")) * x, F.lit(60.0))), cap)
    nothing = [s for s in listed if not short[s] and target[s] <= 0]
    rate = F.when(F.col("__size") == 0, 0.0).when(F.col("__source").isin(*nothing) if nothing else F.lit(False), 0.0).otherwise(F.coalesce(tilted, cap))
    uniform = (F.xxhash64("__key", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")
    rated = rows.withColumn("__rate", rate).withColumn("__place", F.col("__rate") + uniform)
    firm = F.floor("__place").cast("double")
    # Distance to the next copy, up or down; a record at its cap or at none can't go further.
    up = F.when(firm + 1 <= cap, firm + 1 - F.col("__place"))
    down = F.when(firm >= 1, F.col("__place") - firm)
    moving = [s for s in free if s not in at_cap]
    placed = rated.where(F.col("__source").isin(*moving) if moving else F.lit(False)).where("__size > 0")
    base = {r["__source"]: float(r["t"]) for r in placed.groupBy("__source").agg(F.sum(F.least(firm, cap) * F.col("__size")).alias("t")).collect()}
    lack = {s: target[s] - base.get(s, 0.0) for s in moving}
    sign = _by_source({s: 1.0 if lack[s] > 0 else -1.0 for s in moving}, F.col("__source"))
    shift = {s: 0.0 for s in moving}
    width = 1.0
    for _ in range(2):
        distance = F.when(sign > 0, up).otherwise(down)
        step = F.floor((distance - _by_source(shift, F.col("__source"))) / F.lit(width / STEPS))
        bins = placed.where(distance.isNotNull() & (step >= 0) & (step < STEPS)).groupBy("__source", step.alias("step")).agg(F.sum("__size").alias("t")).collect() if moving else []
        by: dict[str, dict[int, float]] = {}
        for r in bins:
            by.setdefault(r["__source"], {})[int(r["step"])] = float(r["t"])
        for s in moving:
            need = abs(lack[s])
            done, k = 0.0, 0
            for k in sorted(by.get(s, {})):
                if done + by[s][k] > need:
                    break
                done += by[s][k]
                k += 1
            shift[s] += k * width / STEPS
            lack[s] = math.copysign(need - done, lack[s])
        width /= STEPS
    delta = F.coalesce(_by_source({s: shift[s] for s in moving}, F.col("__source")), F.lit(0.0))
    taken = F.when(delta == 0, firm).when(sign > 0, F.when(up < delta, firm + 1).otherwise(firm)).otherwise(F.when(down < delta, firm - 1).otherwise(firm))
    fixed = ~F.col("__source").isin(*moving) if moving else F.lit(True)
    number = F.when(F.col("__size") == 0, 0.0).when(fixed, F.col("__rate")).otherwise(F.least(F.greatest(taken, F.lit(0.0)), cap))
    copies = durable(rated.select(F.col("__key").alias(key), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__rate").alias("rate"), number.cast("int").alias("copies")))
    sums = {r["source"]: r for r in copies.groupBy("source").agg(F.sum("copies").alias("c"), F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    mixed = sum(int(r["t"]) for r in sums.values())
    lines = []
    for s in listed:
        c, t = (int(sums[s]["c"]), int(sums[s]["t"])) if s in sums else (0, 0)
        lines.append((listed[s]["source"], weights[s], caps[s], have[s][0], have[s][1], target[s], short[s], s not in open_, c, t, t / mixed if mixed else None))
    report = spark.createDataFrame(lines, "source string, target_weight double, max_repeats int, records bigint, size bigint, target_size double, short boolean, converged boolean, copies bigint, mixed_size bigint, share double")
    return Mix(copies, report)
