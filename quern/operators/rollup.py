"""Windows of samples at each step of a grid: instant selection and range functions.

A sample knows by integer arithmetic which steps' windows hold it, so windows are an explode and a hash aggregation with map-side
combine: no range join, and no series' samples ever in one task. Selection first keeps the newest sample of each grid cell and then
lets it serve the steps up to the next cell that has one. Functions that merge (sums, counts, extremes, the last value) are
aggregated to panes of gcd(range, step) first where windows overlap much, so that panes are multiplied and samples are not.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ieee
from .relation import Grid

#: Windows that share a sample, from which on panes pay.
OVERLAP = 4
MERGED = ("sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "count_over_time", "last_over_time", "present_over_time")
PAIRS = ("rate", "increase", "delta", "irate", "idelta", "resets", "changes")


def bounds(grid: Grid, span: int, offset: int) -> tuple[int, int]:
    """Samples after the first and up to the second are looked at."""
    return grid.start - offset - span, grid.start - offset + (grid.n - 1) * grid.step


def _int(expr: str) -> Column:
    return F.expr(expr).cast("bigint")


def _first(grid: Grid, offset: int) -> Column:
    return _int(f"(greatest(ts_ms - ({grid.start - offset}), 0L) + {grid.step - 1}) div {grid.step}")


def _last(grid: Grid, offset: int, span: int) -> Column:
    return F.least(F.lit(grid.n - 1).cast("bigint"), _int(f"(ts_ms - ({grid.start - offset}) + {span - 1}) div {grid.step}"))


def _stepped(df: DataFrame, grid: Grid, keys: list[str], *cols) -> DataFrame:
    return df.select(*keys, (F.col("k") * grid.step + grid.start).alias("step"), *cols)


def select(samples: DataFrame, keys: list[str], grid: Grid, lookback: int, offset: int = 0, source: bool = False) -> DataFrame:
    """keys, step, value (and src: the sample's own time): the newest sample in (step - offset - lookback, step - offset], unless it is stale.

    ``samples``: keys, ts_ms, value, stale; unique by keys and ts_ms; within bounds().
    """
    cells = samples.select(*keys, "ts_ms", "value", "stale", _first(grid, offset).alias("k"))
    newest = cells.groupBy(*keys, "k").agg(F.max("ts_ms").alias("ts_ms"), F.max_by("value", "ts_ms").alias("value"), F.max_by("stale", "ts_ms").alias("stale"))
    newest = newest.withColumn("to", _last(grid, offset, lookback))
    extra = [F.col("ts_ms").alias("src")] if source else []
    if lookback <= grid.step or grid.n == 1:  # no sample serves a second step
        return _stepped(newest.where("k <= to and not stale"), grid, keys, "value", *extra)
    after = F.lead("k").over(Window.partitionBy(*keys).orderBy("k"))  # at most one row for each step of the grid
    newest = newest.withColumn("to", F.least("to", F.coalesce(after - 1, F.lit(grid.n - 1).cast("bigint"))))
    served = newest.where("k <= to and not stale").withColumn("k", F.explode(F.sequence("k", "to")))
    return _stepped(served, grid, keys, "value", *extra)


def _extrapolated(kind: str, end: Column, span: int) -> Column:
    """The change over the window, carried to its edges where samples come close to them."""
    t0, t1, v0, v1, n = (F.col(c) for c in ("t0", "t1", "v0", "v1", "n"))
    counter = kind != "delta"
    covered = (t1 - t0) / 1000.0
    mean = covered / (n - 1)
    change = v1 - v0 + (F.col("lost") if counter else F.lit(0.0))
    to_start, to_end = (t0 - (end - span)) / 1000.0, (end - t1) / 1000.0
    to_start = F.when(to_start >= mean * 1.1, mean / 2).otherwise(to_start)
    if counter:
        zero = v0 * F.try_divide(covered, change)
        to_start = F.when((change > 0) & (v0 >= 0) & (zero < to_start), zero).otherwise(to_start)
    to_end = F.when(to_end >= mean * 1.1, mean / 2).otherwise(to_end)
    out = change * ((covered + to_start + to_end) / covered)
    return out / (span / 1000.0) if kind == "rate" else out


def _pair(kind: str, windows: DataFrame, keys: list[str], grid: Grid, offset: int, span: int) -> DataFrame:
    v, pv, dt = F.col("value"), F.col("pv"), F.col("ts_ms") - F.col("pt")
    inside = F.col("pt") > F.col("k") * grid.step + (grid.start - offset - span)
    group = windows.groupBy(*keys, "k")
    if kind in ("resets", "changes"):
        differs = (v < pv) & ~F.isnan(v) & ~F.isnan(pv) if kind == "resets" else ieee.compare("!=", v, pv) & ~(F.isnan(v) & F.isnan(pv))
        return group.agg(F.sum(F.when(inside & differs, 1.0).otherwise(0.0)).alias("value"))
    if kind in ("irate", "idelta"):
        last = group.agg(F.max("ts_ms").alias("ts_ms"), F.max_by("value", "ts_ms").alias("value"), F.max_by("pt", "ts_ms").alias("pt"), F.max_by("pv", "ts_ms").alias("pv"))
        last = last.where(inside)
        if kind == "idelta":
            return last.select(*keys, "k", (v - pv).alias("value"))
        return last.where(dt > 0).select(*keys, "k", (F.when(v < pv, v).otherwise(v - pv) / (dt / 1000.0)).alias("value"))
    lost = F.sum(F.when(inside & (v < pv) & ~F.isnan(pv) & ~F.isnan(v), pv).otherwise(0.0))
    found = group.agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"), F.min_by("value", "ts_ms").alias("v0"), F.max_by("value", "ts_ms").alias("v1"), lost.alias("lost")
    ).where("n >= 2 and t1 > t0")
    end = F.col("k") * grid.step + (grid.start - offset)
    return found.select(*keys, "k", _extrapolated(kind, end, span).alias("value"))


def _merged(kind: str, samples: DataFrame, keys: list[str], grid: Grid, span: int, offset: int) -> DataFrame:
    """By panes: the samples between two neighbouring ends or beginnings of windows."""
    width = gcd(span, grid.step)
    each, wide = grid.step // width, span // width
    pane = _int(f"(ts_ms - ({grid.start - offset - span}) + {width - 1}) div {width}")  # from 1
    v = F.col("value")
    partial = {
        "sum_over_time": [F.sum(v).alias("a")], "avg_over_time": [F.sum(v).alias("a"), F.count("*").alias("b")], "min_over_time": [F.min(v).alias("a")],
        "max_over_time": [F.max(F.when(~F.isnan(v), v)).alias("a")], "count_over_time": [F.count("*").alias("a")],
        "last_over_time": [F.max("ts_ms").alias("b"), F.max_by("value", "ts_ms").alias("a")], "present_over_time": [F.lit(1.0).alias("a")],
    }[kind]
    panes = samples.select(*keys, "ts_ms", "value", pane.alias("p")).groupBy(*keys, "p").agg(*partial)
    low, high = _int(f"(greatest(p - {wide}, 0L) + {each - 1}) div {each}"), F.least(F.lit(grid.n - 1).cast("bigint"), _int(f"(p - 1) div {each}"))
    windows = panes.withColumn("k", low).withColumn("to", high).where("k <= to").withColumn("k", F.explode(F.sequence("k", "to")))
    a, b = F.col("a"), F.col("b")
    total = {
        "sum_over_time": lambda: F.sum(a), "avg_over_time": lambda: F.sum(a) / F.sum(b), "min_over_time": lambda: F.min(a), "max_over_time": lambda: F.coalesce(F.max(a), ieee.nan()),
        "count_over_time": lambda: F.sum(a), "last_over_time": lambda: F.max_by("a", "b"), "present_over_time": lambda: F.max(a),
    }[kind]()
    return windows.groupBy(*keys, "k").agg(total.cast("double").alias("value"))


def rollup(kind: str, samples: DataFrame, keys: list[str], grid: Grid, span: int, offset: int = 0, q: float | None = None, exact: bool = False) -> DataFrame:
    """keys, step, value: ``kind`` over the samples in (step - offset - span, step - offset]. Stale samples must be gone.

    ``exact``: sums and means are folded in time order with compensation, at the price of each window's samples in one row.
    """
    if kind in MERGED and not exact and span >= OVERLAP * grid.step and grid.n >= OVERLAP:
        return _stepped(_merged(kind, samples, keys, grid, span, offset), grid, keys, "value")
    cols = ["ts_ms", "value"]
    if kind in PAIRS:
        w = Window.partitionBy(*keys).orderBy("ts_ms")
        samples = samples.select(*keys, *cols, F.lag("ts_ms").over(w).alias("pt"), F.lag("value").over(w).alias("pv"))
        cols += ["pt", "pv"]
    windows = samples.select(*keys, *cols, _first(grid, offset).alias("k"), _last(grid, offset, span).alias("to")).where("k <= to")
    if grid.n > 1:  # a sequence from a larger to a smaller number would run backwards, hence the filter
        windows = windows.withColumn("k", F.explode(F.sequence("k", "to")))
    if kind in PAIRS:
        return _stepped(_pair(kind, windows, keys, grid, offset, span), grid, keys, "value")
    v = F.col("value")
    if exact and kind in ("sum_over_time", "avg_over_time"):
        found = compensated(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))))
        value = found if kind == "sum_over_time" else found / F.count("*")
    else:
        value = {
            "sum_over_time": lambda: F.sum(v), "avg_over_time": lambda: F.avg(v), "min_over_time": lambda: ieee.min_of(v), "max_over_time": lambda: ieee.max_of(v),
            "count_over_time": lambda: F.count("*"), "last_over_time": lambda: F.max_by("value", "ts_ms"), "stddev_over_time": lambda: F.stddev_pop(v),
            "stdvar_over_time": lambda: F.var_pop(v), "quantile_over_time": lambda: ieee.quantile(q, v), "present_over_time": lambda: F.max(F.lit(1.0)),
        }[kind]()
    return _stepped(windows.groupBy(*keys, "k").agg(value.cast("double").alias("value")), grid, keys, "value")


def compensated(rows: Column) -> Column:
    """Kahan-Neumaier sum of structs' values, in the array's order."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc: Column, row: Column) -> Column:
        x, t = row["value"], acc["s"] + row["value"]
        low = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), F.when(ieee.infinite(t) | F.isnan(t), 0.0).otherwise(acc["c"] + low).alias("c"))

    return F.aggregate(rows, zero, add, lambda acc: acc["s"] + acc["c"])
