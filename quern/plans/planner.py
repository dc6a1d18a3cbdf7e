"""The metrics query language over DataFrames: parse, optimise, plan; Catalyst does the rest."""

from __future__ import annotations

import contextlib
import io
import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregate as agg, matching, pointwise
from ..operators.relation import NAME, Grid, Scalar, Vector, col, literal, of
from ..operators.rollup import bounds, rollup, select
from ..sources.metrics import Metrics
from .ast import ARITHMETIC, AGGREGATES, ROLLUPS, Aggregate, Binary, Call, Expr, Number, QueryError, Selector, Subquery, Text
from .optimize import optimize
from .parser import duration_ms, parse

LOOKBACK = 300_000
SUBQUERY_STEP = 1000  #: of a subquery without a step in an instant query


@dataclass(frozen=True)
class Options:
    """Where this engine follows the language's standard, and flags that choose otherwise."""

    lookback: int = LOOKBACK
    keep_name: bool = False  # functions and operators with a scalar keep the metric's name
    first_wins: bool = False  # of several series for a match group the first one counts; else an error
    left_roster: bool = False  # or gives no series that the left side lacks
    exact: bool = False  # sums over time by compensated summation in time order


@dataclass(frozen=True)
class Plan:
    metrics: Metrics
    grid: Grid
    options: Options
    whole: Grid  # of the query, for @ start() and @ end() within subqueries
    instant: bool

    @property
    def spark(self) -> SparkSession:
        return self.metrics.samples.sparkSession

    # Leaves --------------------------------------------------------------------------------------

    def pinned(self, at: int | str | None) -> int | None:
        return {"start": self.whole.start, "end": self.whole.end}[at] if isinstance(at, str) else at

    def at(self, at: int | str | None, make) -> Vector:
        """make(plan), at the pinned time if there is one: then evaluated once and repeated for every step."""
        if at is None:
            return make(self)
        t = self.pinned(at)
        v = make(replace(self, grid=Grid(t, t, 1)))
        steps = F.sequence(F.lit(self.grid.start).cast("bigint"), F.lit(self.grid.start + (self.grid.n - 1) * self.grid.step).cast("bigint"), F.lit(self.grid.step).cast("bigint")) if self.grid.n > 1 else F.array(F.lit(self.grid.start).cast("bigint"))
        rest = [c for c in v.df.columns if c != "step"]
        return replace(v, df=v.df.select(*rest, F.explode(steps).alias("step")))

    def selected(self, e: Selector, source: bool = False) -> Vector:
        def make(p: Plan) -> Vector:
            read = self.metrics.read(e.matchers, *bounds(p.grid, self.options.lookback, e.offset))
            df = select(read.samples, read.keys, p.grid, self.options.lookback, e.offset, source)
            return Vector(read.labelled(df, *["src"] * source), read.labels, read.one_name)

        return self.at(e.at, make)

    def rolled(self, name: str, e: Expr, q: float | None = None) -> Vector:
        if isinstance(e, Selector) and e.range is not None:

            def make(p: Plan) -> Vector:
                read = self.metrics.read(e.matchers, *bounds(p.grid, e.range, e.offset))
                df = rollup(name, read.samples.where("not stale"), read.keys, p.grid, e.range, e.offset, q, self.options.exact)
                return Vector(read.labelled(df), read.labels, read.one_name)
        elif isinstance(e, Subquery):

            def make(p: Plan) -> Vector:
                step = e.step or (SUBQUERY_STEP if self.instant else self.whole.step)
                after, upto = bounds(p.grid, e.range, e.offset)
                inner = Grid((after // step + 1) * step, upto // step * step, step)
                child = as_vector(replace(self, grid=inner).vector(e.expr), inner, self.spark)
                samples = child.df.select(*of(child.labels), F.col("step").alias("ts_ms"), "value")
                df = rollup(name, samples, of(child.labels), p.grid, e.range, e.offset, q, self.options.exact)
                return Vector(df.select(*of(child.labels), "step", "value"), child.labels, child.one_name)
        else:
            raise QueryError(f"{name} needs a range of samples")
        v = self.at(e.at, make)
        return v if name == "last_over_time" or self.options.keep_name else v.without_name()

    # Expressions ---------------------------------------------------------------------------------

    def build(self, e: Expr) -> Vector | Scalar:
        if isinstance(e, Number):
            return literal(e.value)
        if isinstance(e, Selector):
            if e.range is not None:
                raise QueryError("a range of samples needs a function")
            return self.selected(e)
        if isinstance(e, Call):
            return self.call(e)
        if isinstance(e, Aggregate):
            return self.aggregate(e)
        if isinstance(e, Binary):
            a, b = self.build(e.left), self.build(e.right)
            if isinstance(a, Scalar) != isinstance(b, Scalar) and (e.op in ARITHMETIC or e.bool_):
                a, b = (self.nameless(x) if isinstance(x, Vector) else x for x in (a, b))
            return matching.binary(e.op, a, b, e.matching, e.bool_, self.grid, self.spark, self.options.first_wins, self.options.left_roster)
        if isinstance(e, Subquery):
            raise QueryError("a subquery needs a function")
        raise QueryError("a string is no query")

    def vector(self, e: Expr) -> Vector | Scalar:
        return self.build(e)

    def nameless(self, v: Vector) -> Vector:
        return v if self.options.keep_name else v.without_name()

    def argument(self, e: Expr, name: str) -> Vector:
        v = self.build(e)
        if not isinstance(v, Vector):
            raise QueryError(f"{name} needs a vector")
        return v

    def scalar(self, e: Expr, name: str) -> Scalar:
        s = self.build(e)
        if not isinstance(s, Scalar):
            raise QueryError(f"{name} needs a scalar")
        return s

    def number(self, e: Expr, name: str) -> float:
        e = optimize(e)
        if not isinstance(e, Number):
            raise QueryError(f"{name} needs a number")
        return e.value

    def text(self, e: Expr, name: str) -> str:
        if not isinstance(e, Text):
            raise QueryError(f"{name} needs a string")
        return e.value

    def call(self, e: Call) -> Vector | Scalar:
        name, args = e.name, e.args

        def count(low: int, high: int | None = None) -> None:
            if not low <= len(args) <= (low if high is None else high):
                raise QueryError(f"{name} takes {low if high is None else f'{low} to {high}'} arguments, not {len(args)}")

        if name in ROLLUPS:
            count(2 if name == "quantile_over_time" else 1)
            return self.rolled(name, args[-1], self.number(args[0], name) if name == "quantile_over_time" else None)
        if name == "time":
            count(0)
            return Scalar(lambda step: step / 1000.0)
        if name == "scalar":
            count(1)
            v = self.argument(args[0], name)
            one = v.df.groupBy("step").agg(F.when(F.count("*") == 1, F.first("value")).alias("value"))
            df = self.grid.steps(self.spark).join(one, "step", "left").select("step", F.coalesce("value", F.lit(math.nan)).alias("value"))
            return Scalar(df=df, steps=self.grid.n)
        if name == "vector":
            count(1)
            return Vector(self.scalar(args[0], name).over(self.grid, self.spark), ())
        if name == "timestamp":
            count(1)
            if isinstance(args[0], Selector):
                v = self.selected(args[0], source=True)
                return self.nameless(replace(v, df=v.df.select(*of(v.labels), "step", (F.col("src") / 1000.0).alias("value"))))
            return self.nameless(self.argument(args[0], name).with_value(F.col("step") / 1000.0))
        if name in pointwise.CALENDAR:
            count(0, 1)
            v = self.argument(args[0], name) if args else Vector(self.grid.steps(self.spark).withColumn("value", F.col("step") / 1000.0), ())
            return self.nameless(v.with_value(pointwise.CALENDAR[name](F.col("value"))))
        if name in pointwise.SIMPLE:
            count(1)
            return self.nameless(self.argument(args[0], name).with_value(pointwise.SIMPLE[name](F.col("value"))))
        if name == "round":
            count(1, 2)
            from ..functions.ieee import round_to

            return self.nameless(self.argument(args[0], name).with_value(round_to(F.col("value"), self.number(args[1], name) if len(args) > 1 else 1.0)))
        if name in ("clamp", "clamp_min", "clamp_max"):
            count(3 if name == "clamp" else 2)
            limits = [self.number(x, name) for x in args[1:]]
            low, high = {"clamp": lambda: limits, "clamp_min": lambda: (limits[0], None), "clamp_max": lambda: (None, limits[0])}[name]()
            v = self.nameless(self.argument(args[0], name).with_value(pointwise.clamp(F.col("value"), low, high)))
            return replace(v, df=v.df.where(F.lit(False))) if name == "clamp" and low > high else v
        if name == "label_replace":
            count(5)
            return pointwise.label_replace(self.argument(args[0], name), *[self.text(x, name) for x in args[1:]])
        if name == "label_join":
            if len(args) < 3:
                raise QueryError("label_join takes 3 arguments or more")
            to, separator, *sources = [self.text(x, name) for x in args[1:]]
            return pointwise.label_join(self.argument(args[0], name), to, separator, sources)
        raise QueryError(f"unknown function {name}")

    def aggregate(self, e: Aggregate) -> Vector:
        assert e.op in AGGREGATES
        v = self.argument(e.expr, e.op)
        if e.op in ("topk", "bottomk"):
            return agg.ranked(e.op, v, self.scalar(e.param, e.op), e.by, e.labels)
        param = self.number(e.param, e.op) if e.op == "quantile" else self.text(e.param, e.op) if e.op == "count_values" else None
        return agg.aggregate(e.op, v, e.by, e.labels, param)


def as_vector(v: Vector | Scalar, grid: Grid, spark: SparkSession) -> Vector:
    return v if isinstance(v, Vector) else Vector(v.over(grid, spark), ())


class Engine:
    """Queries over ``metrics``. Times are milliseconds since the epoch."""

    def __init__(self, metrics: Metrics, options: Options | None = None, **flags):
        self.metrics, self.options = metrics, options or Options(**flags)

    def plan(self, query: str | Expr, start: int, end: int, step: int, instant: bool) -> tuple[Expr, Vector | Scalar, Grid]:
        if step <= 0 or end < start:
            raise QueryError("a step must be positive and an end not before its start")
        e = optimize(parse(query) if isinstance(query, str) else query)
        grid = Grid(start, end, step)
        return e, Plan(self.metrics, grid, self.options, grid, instant).build(e), grid

    def _out(self, e: Expr, v: Vector | Scalar, grid: Grid, flat: bool) -> DataFrame:
        spark = self.metrics.samples.sparkSession
        if isinstance(v, Scalar):
            return v.over(grid, spark).select(F.col("step").alias("ts_ms"), "value")
        if flat:
            return v.df.select(*[F.col(col(x)).alias(x) for x in v.labels], F.col("step").alias("ts_ms"), "value")
        entries = F.array(*[F.struct(F.lit(x).alias("key"), F.col(col(x)).alias("value")) for x in sorted(v.labels)]) if v.labels else F.expr("cast(array() as array<struct<key:string,value:string>>)")
        return v.df.select(F.map_from_entries(F.filter(entries, lambda x: x["value"] != "")).alias("labels"), F.col("step").alias("ts_ms"), "value")

    def instant(self, query: str | Expr, at: int, flat: bool = False) -> DataFrame:
        """labels (a map, or with ``flat`` a column for each), ts_ms, value. topk and bottomk at the root come in their order."""
        e, v, grid = self.plan(query, at, at, 1, True)
        out = self._out(e, v, grid, flat)
        if isinstance(e, Aggregate) and e.op in ("topk", "bottomk"):
            return out.orderBy(F.isnan("value"), F.desc("value") if e.op == "topk" else F.asc("value"))
        return out

    def range(self, query: str | Expr, start: int, end: int, step: int, flat: bool = False) -> DataFrame:
        e, v, grid = self.plan(query, start, end, step, False)
        return self._out(e, v, grid, flat)

    def series_of(self, found: DataFrame) -> DataFrame:
        """A result of range() with one row a series: labels, and samples (ts_ms, value) in order."""
        by = [c for c in found.columns if c not in ("ts_ms", "value")]
        keys = [F.to_json("labels").alias("_k")] if by == ["labels"] else []
        df = found.select("*", *keys)
        group = df.groupBy("_k").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("samples")).drop("_k") if keys else df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("samples"))
        return group

    def explain(self, query: str, start: int, end: int | None = None, step: int = 1) -> str:
        """The parsed and optimised query, and Spark's plan."""
        e, v, grid = self.plan(query, start, end if end is not None else start, step, end is None)
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            self._out(e, v, grid, True).explain("formatted")
        return f"== Query ==\n{parse(query).show()}\n== Optimised ==\n{e.show()}\n== Spark ==\n{said.getvalue()}"


__all__ = ["Engine", "Options", "Metrics", "NAME", "duration_ms"]
