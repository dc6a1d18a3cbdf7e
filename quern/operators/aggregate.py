"""Aggregation over series at each step: hash aggregations, and ranks within groups."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import ieee
from .relation import NAME, Scalar, Vector, col, of


def groups(v: Vector, by: bool, labels: tuple[str, ...] | None) -> tuple[str, ...]:
    if labels is None:
        return ()
    if by:
        return tuple(x for x in v.labels if x in labels)
    return tuple(x for x in v.labels if x not in labels and x != NAME)


def aggregate(op: str, v: Vector, by: bool = True, labels: tuple[str, ...] | None = None, param: float | str | None = None) -> Vector:
    keys, x = groups(v, by, labels), F.col("value")
    df = v.df
    if op == "count_values":
        # Formatted before grouping, which would hold 0 and -0 for one.
        df = df.withColumn(col(param), ieee.shortest(x))
        keys = (*(k for k in keys if k != param), param)
    value = {
        "sum": lambda: F.sum(x), "avg": lambda: F.avg(x), "min": lambda: ieee.min_of(x), "max": lambda: ieee.max_of(x), "count": lambda: F.count("*"), "count_values": lambda: F.count("*"),
        "stddev": lambda: F.stddev_pop(x), "stdvar": lambda: F.var_pop(x), "group": lambda: F.max(F.lit(1.0)), "quantile": lambda: ieee.quantile(param, x),
    }[op]()
    return Vector(df.groupBy(*of(keys), "step").agg(value.cast("double").alias("value")), keys, v.one_name)


def ranked(op: str, v: Vector, k: Scalar, by: bool = True, labels: tuple[str, ...] | None = None) -> Vector:
    """topk and bottomk: the k series of each group with the largest or smallest values; NaN last, ties by labels.

    A literal k lets Spark keep k rows of each group and task before the shuffle.
    """
    keys, x = groups(v, by, labels), F.col("value")
    order = [F.isnan(x), x.desc() if op == "topk" else x.asc(), *of(v.labels)]
    w = Window.partitionBy(*of(keys), "step").orderBy(*order)
    df = v.df.withColumn("_r", F.row_number().over(w))
    if k.literal is not None:
        n = 0 if k.literal != k.literal else int(max(0, min(k.literal, 2**31 - 1)))
        df = df.where(F.col("_r") <= n)
    else:
        df = k.beside(df, "_k").where(F.col("_r") <= F.when(F.isnan("_k"), 0).otherwise(F.col("_k")))
    return Vector(df.select(*of(v.labels), "step", "value"), v.labels, v.one_name)
