"""Binary operators: arithmetic, comparisons and sets, between scalars and vectors, by equi-joins on labels and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ieee
from ..plans.ast import ARITHMETIC, COMPARISONS, Matching, QueryError
from .relation import NAME, Grid, Scalar, Vector, checked, col, of


def scalars(op: str, a: Scalar, b: Scalar, grid: Grid, spark) -> Scalar:
    """Comparisons give 1 or 0."""

    def value(x: Column, y: Column) -> Column:
        return ieee.arithmetic(op, x, y) if op in ARITHMETIC else ieee.compare(op, x, y).cast("double")

    if a.expr is not None and b.expr is not None:
        return Scalar(lambda step: value(a.expr(step), b.expr(step)))
    df = b.beside(a.over(grid, spark), "_b")
    return Scalar(df=df.select("step", value(F.col("value"), F.col("_b")).alias("value")), steps=grid.n)


def _result(op: str, flag: bool, x: Column, y: Column, keep: Column) -> tuple[Column, Column | None]:
    """The value, and which rows stay."""
    if op in ARITHMETIC:
        return ieee.arithmetic(op, x, y), None
    found = ieee.compare(op, x, y)
    return (found.cast("double"), None) if flag else (keep, found)


def with_scalar(op: str, v: Vector, s: Scalar, vector_left: bool, flag: bool = False) -> Vector:
    df = s.beside(v.df)
    x, y = (F.col("value"), F.col("_s")) if vector_left else (F.col("_s"), F.col("value"))
    value, stay = _result(op, flag, x, y, F.col("value"))
    df = df if stay is None else df.where(stay)
    return Vector(df.select(*of(v.labels), "step", value.alias("value")), v.labels, v.one_name)


def _keys(a: Vector, b: Vector, m: Matching) -> tuple[str, ...]:
    both = dict.fromkeys((*a.labels, *b.labels))
    if m.on:
        return tuple(m.labels)
    return tuple(x for x in both if x not in m.labels and x != NAME)


def _side(v: Vector, keys: tuple[str, ...], extra: dict[str, str]) -> DataFrame:
    """k_<i> key columns, step, value and other labels as the given columns."""
    get = lambda x: F.col(col(x)) if x in v.labels else F.lit("")
    return v.df.select(*[get(x).alias(f"k_{i}") for i, x in enumerate(keys)], "step", "value", *[get(x).alias(c) for x, c in extra.items()])


def _single(df: DataFrame, by: list[str], message: str, first_wins: bool = False) -> DataFrame:
    """One row for each key and step; another is an error, or with ``first_wins`` left out."""
    rest = [c for c in df.columns if c not in by and c != "value"]
    if first_wins:
        found = df.groupBy(*by).agg(F.min(F.struct(*rest, "value")).alias("_f"))
        return found.select(*by, *[F.col(f"_f.{c}").alias(c) for c in ("value", *rest)])
    found = df.groupBy(*by).agg(F.count("*").alias("_n"), F.first("value").alias("_v"), *[F.first(c).alias(c) for c in rest])
    return found.select(*by, F.when(F.col("_n") > 1, F.raise_error(F.lit(message)).cast("double")).otherwise(F.col("_v")).alias("value"), *rest)


def vectors(op: str, a: Vector, b: Vector, m: Matching, flag: bool = False, first_wins: bool = False) -> Vector:
    keys = _keys(a, b, m)
    by = [*(f"k_{i}" for i in range(len(keys))), "step"]
    drop = op in ARITHMETIC or flag
    many, one = (b, a) if m.many == "right" else (a, b)
    kept = many.labels
    if m.many is None:
        kept = tuple(x for x in many.labels if (x in m.labels if m.on else x not in m.labels))
    kept = tuple(x for x in kept if not (drop and x == NAME) and x not in m.include)
    single = _side(one, keys, {x: f"i_{i}" for i, x in enumerate(m.include)})
    if not set(one.labels) <= set(keys):
        single = _single(single, by, "found duplicate series for the match group on one side of the operation", first_wins)
    # A key that both sides share is among the many side's labels already; others are carried along.
    left = _side(many, keys, {x: col(x) for x in kept if x not in keys})
    joined = left.withColumnRenamed("value", "_many").join(single.withColumnRenamed("value", "_one"), by)
    x, y = (F.col("_many"), F.col("_one")) if m.many != "right" else (F.col("_one"), F.col("_many"))
    value, stay = _result(op, flag, x, y, x)
    if stay is not None:
        joined = joined.where(stay)
    labels = [F.col(f"k_{keys.index(x)}").alias(col(x)) if x in keys else F.col(col(x)) for x in kept]
    more = [F.col(f"i_{i}").alias(col(x)) for i, x in enumerate(m.include)]
    out = Vector(joined.select(*labels, *more, "step", value.alias("value")), (*kept, *m.include), a.one_name and b.one_name)
    safe = {x for x in many.labels if not (x == NAME and many.one_name)} <= set(kept)
    return out if safe else checked(out, "multiple matches for labels: many-to-one matching must be explicit (group_left/group_right)")


def sets(op: str, a: Vector, b: Vector, m: Matching, left_roster: bool = False) -> Vector:
    """and, unless, or; all of the left side's labels stay. ``left_roster``: or only fills steps of series the left side has."""
    keys = _keys(a, b, m)
    by = [*(f"k_{i}" for i in range(len(keys))), "step"]
    if op in ("and", "unless"):
        probe = _side(b, keys, {}).select(*by).distinct()
        left = a.df.select("*", *[(F.col(col(x)) if x in a.labels else F.lit("")).alias(f"k_{i}") for i, x in enumerate(keys)])
        found = left.join(probe, by, "left_semi" if op == "and" else "left_anti")
        return Vector(found.select(*of(a.labels), "step", "value"), a.labels, a.one_name)
    labels = tuple(dict.fromkeys((*a.labels, *b.labels)))
    probe = _side(a, keys, {}).select(*by).distinct()
    right = b.df.select("*", *[(F.col(col(x)) if x in b.labels else F.lit("")).alias(f"k_{i}") for i, x in enumerate(keys)])
    rest = right.join(probe, by, "left_anti")
    if left_roster:
        rest = rest.join(_side(a, keys, {}).select(*by[:-1]).distinct(), by[:-1], "left_semi") if by[:-1] else rest
    rest = Vector(rest.select(*of(b.labels), "step", "value"), b.labels)
    return Vector(Vector(a.df, a.labels).widened(labels).unionByName(rest.widened(labels)), labels, False)


def binary(op: str, a: Vector | Scalar, b: Vector | Scalar, m: Matching, flag: bool, grid: Grid, spark, first_wins: bool = False, left_roster: bool = False) -> Vector | Scalar:
    if isinstance(a, Scalar) and isinstance(b, Scalar):
        if op not in (*ARITHMETIC, *COMPARISONS):
            raise QueryError(f"{op} is not for scalars")
        return scalars(op, a, b, grid, spark)
    if isinstance(a, Scalar) or isinstance(b, Scalar):
        if op not in (*ARITHMETIC, *COMPARISONS):
            raise QueryError(f"{op} is not for scalars")
        return with_scalar(op, a, b, True, flag) if isinstance(a, Vector) else with_scalar(op, b, a, False, flag)
    if op in ("and", "or", "unless"):
        return sets(op, a, b, m, left_roster)
    return vectors(op, a, b, m, flag, first_wins)
