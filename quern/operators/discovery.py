"""What there is in a metrics table: series, label names and values, metadata, federation, active series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ieee import shortest
from ..plans.ast import QueryError
from ..plans.parser import parse_selector
from ..sources.metrics import Metrics
from .relation import NAME, col


def _selectors(match: list[str] | None) -> list:
    return [parse_selector(m).matchers for m in match or ()]


def series(metrics: Metrics, match: list[str], after: int | None = None, upto: int | None = None, limit: int | None = None) -> DataFrame:
    """Distinct label sets, a column for each label, in order. At least one selector is needed."""
    if not match:
        raise QueryError("series needs a selector")
    found = metrics.matching(_selectors(match), after, upto).select(*[F.col(col(x)).alias(x) for x in metrics.labels])
    found = found.orderBy(*[f"`{x}`" for x in metrics.labels])
    return found if limit is None else found.limit(limit)


def labels(metrics: Metrics, match: list[str] | None = None, after: int | None = None, upto: int | None = None) -> DataFrame:
    """label: names that a matching series has."""
    found = metrics.matching(_selectors(match), after, upto)
    have = F.array_compact(F.array(*[F.when(F.col(col(x)) != "", F.lit(x)) for x in metrics.labels]))
    return found.select(F.explode(have).alias("label")).distinct().orderBy("label")


def label_values(metrics: Metrics, name: str, match: list[str] | None = None, after: int | None = None, upto: int | None = None) -> DataFrame:
    if name not in metrics.labels:
        return metrics.samples.sparkSession.createDataFrame([], "value string")
    found = metrics.matching(_selectors(match), after, upto).select(F.col(col(name)).alias("value"))
    return found.where("value <> ''").distinct().orderBy("value")


def metadata(metrics: Metrics, metric: str | None = None, limit: int | None = None, per_metric: int | None = None) -> DataFrame:
    """metric, type, help, unit."""
    if metrics.metadata is None:
        return metrics.samples.sparkSession.createDataFrame([], "metric string, type string, help string, unit string")
    found = metrics.metadata.distinct()
    if metric is not None:
        found = found.where(F.col("metric") == metric)
    if per_metric is not None:
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("metric").orderBy("type", "help", "unit"))).where(F.col("_r") <= per_metric).drop("_r")
    if limit is not None:
        names = found.select("metric").distinct().orderBy("metric").limit(limit)
        found = found.join(names, "metric", "left_semi")
    return found.orderBy("metric")


def federate(metrics: Metrics, match: list[str], at: int, lookback: int = 300_000) -> DataFrame:
    """line: the newest samples of matching series, once each, in the text exposition format."""
    from ..plans.ast import Selector
    from ..plans.planner import Engine

    engine = Engine(metrics, lookback=lookback)
    found = None
    for m in match:
        one = engine.instant(Selector(parse_selector(m).matchers), at, flat=True)
        found = one if found is None else found.union(one)
    rest = sorted(x for x in metrics.labels if x != NAME)

    def quoted(x: str):
        text = F.col(f"`{x}`")
        for a, b in (("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"')):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.when(F.col(f"`{x}`") != "", F.concat(F.lit(f'{x}="'), text, F.lit('"')))

    pairs = F.concat_ws(",", *[quoted(x) for x in rest]) if rest else F.lit("")
    name = F.col(NAME) if NAME in metrics.labels else F.lit("")
    line = F.concat(name, F.lit("{"), pairs, F.lit("} "), shortest(F.col("value")), F.lit(" "), F.col("ts_ms").cast("string"))
    return found.select(line.alias("line")).distinct().orderBy("line")


def active_series(samples: DataFrame, keys: list[str], minutes: int = 15, precision: int | None = None) -> DataFrame:
    """minute, active: the number of series with a sample in the ``minutes`` up to and with each minute.

    A series counts from each of its minutes on until its next one takes over, or for ``minutes``; such runs are counted by beginning and
    length before they are spread. With a ``precision`` the number is estimated, by one sketch of 2**precision registers a minute:
    each minute then unions its own and those before it, sketches travel and series don't.
    """
    minute = F.floor(F.col("ts_ms") / 60_000).cast("bigint")
    if precision is not None:
        sketches = samples.groupBy(minute.alias("at")).agg(F.hll_sketch_agg(F.xxhash64(*keys), F.lit(precision)).alias("sketch"))
        spread = sketches.select(F.explode(F.sequence("at", F.col("at") + (minutes - 1))).alias("minute"), "sketch")
        return spread.groupBy("minute").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("active"))
    seen = samples.select(*keys, minute.alias("at")).distinct()
    gap = F.lead("at").over(Window.partitionBy(*keys).orderBy("at")) - F.col("at")
    runs = seen.select("at", F.least(gap, F.lit(minutes)).alias("n")).groupBy("at", "n").agg(F.count("*").alias("c"))
    spread = runs.select(F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("minute"), "c")
    return spread.groupBy("minute").agg(F.sum("c").alias("active"))
