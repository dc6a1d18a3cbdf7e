"""What passes between operators: a step grid, vectors as DataFrames with one column a label, and scalars as expressions.

A vector's DataFrame has ``l_<label>`` string columns ("" stands for no such label), ``step`` (ms) and ``value``. Absence is a row that
is not there; NaN is a value. (labels, step) is unique.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NAME = "__name__"
SMALL_GRID = 100_000  #: steps up to which a scalar of each step is broadcast


def col(label: str) -> str:
    return f"l_{label}"


def of(labels) -> list[str]:
    return [col(x) for x in labels]


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int

    @property
    def n(self) -> int:
        return max(0, (self.end - self.start) // self.step + 1)

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.range(0, self.n, 1, 1).select((F.col("id") * self.step + self.start).alias("step"))


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    labels: tuple[str, ...]
    one_name: bool = True  # all rows have one metric name, so dropping it can't make two series one

    def with_value(self, value: Column) -> Vector:
        return replace(self, df=self.df.select(*of(self.labels), "step", value.cast("double").alias("value")))

    def project(self, labels: tuple[str, ...], names: tuple[str, ...] = ()) -> Vector:
        """Only these labels; those that the vector has not are left out."""
        return replace(self, labels=tuple(x for x in labels if x in self.labels))

    def widened(self, labels: tuple[str, ...]) -> DataFrame:
        """The DataFrame with exactly these labels."""
        have = [F.col(col(x)) if x in self.labels else F.lit("").alias(col(x)) for x in labels]
        return self.df.select(*have, "step", "value")

    def without_name(self) -> Vector:
        if NAME not in self.labels:
            return self
        labels = tuple(x for x in self.labels if x != NAME)
        if self.one_name:
            return Vector(self.df.select(*of(labels), "step", "value"), labels)
        return checked(Vector(self.df, labels), "vector cannot contain metrics with the same labelset")


def checked(v: Vector, message: str) -> Vector:
    """v, or an error while it runs where two rows have the same labels at one step."""
    found = v.df.groupBy(*of(v.labels), "step").agg(F.count("*").alias("_n"), F.first("value").alias("_v"))
    value = F.when(F.col("_n") > 1, F.raise_error(F.lit(message)).cast("double")).otherwise(F.col("_v"))
    return Vector(found.select(*of(v.labels), "step", value.alias("value")), v.labels)


@dataclass(frozen=True)
class Scalar:
    """A number at each step: an expression of the step, or a DataFrame (step, value) with a row for each step of the grid."""

    expr: Callable[[Column], Column] | None = None
    df: DataFrame | None = None
    literal: float | None = None
    steps: int = 0

    def beside(self, df: DataFrame, name: str = "_s") -> DataFrame:
        """``df`` (with step) and this scalar's value as a column."""
        if self.expr is not None:
            return df.withColumn(name, self.expr(F.col("step")))
        side = self.df.select("step", F.col("value").alias(name))
        return df.join(F.broadcast(side) if self.steps <= SMALL_GRID else side, "step")

    def over(self, grid: Grid, spark: SparkSession) -> DataFrame:
        if self.df is not None:
            return self.df
        return grid.steps(spark).select("step", self.expr(F.col("step")).alias("value"))


def literal(x: float) -> Scalar:
    return Scalar(lambda step: F.lit(x), literal=x)
