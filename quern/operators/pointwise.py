"""Functions of one sample's value, calendar functions, and changes of labels."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, functions as F

from ..functions import ieee
from .relation import NAME, Vector, checked, col, of


def _calendar(f) -> partial:
    def of_value(x: Column) -> Column:
        # Seconds beyond the years that dates reach are undefined, as are NaN and infinities.
        some = ~(F.isnan(x) | (F.abs(x) >= F.lit(2.5e11)))
        t = F.timestamp_seconds(F.when(some, x).cast("bigint"))
        return F.when(some, f(t).cast("double")).otherwise(ieee.nan())

    return of_value


SIMPLE = {
    "abs": F.abs, "ceil": ieee.ceil, "floor": ieee.floor, "exp": F.exp, "sqrt": F.sqrt, "sgn": ieee.sign,
    "ln": partial(ieee.log, name="ln"), "log2": partial(ieee.log, name="log2"), "log10": partial(ieee.log, name="log10"),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians,
}
CALENDAR = {
    "year": _calendar(F.year), "month": _calendar(F.month), "day_of_month": _calendar(F.dayofmonth), "day_of_year": _calendar(F.dayofyear),
    "day_of_week": _calendar(lambda t: F.dayofweek(t) - 1), "hour": _calendar(F.hour), "minute": _calendar(F.minute), "days_in_month": _calendar(lambda t: F.day(F.last_day(t))),
}


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        x = ieee.greatest(x, F.lit(low))
    return x if high is None else ieee.least(x, F.lit(high))


def _expanded(replacement: str) -> list[int | str]:
    """Text and group numbers or names of ``$1``, ``${name}``, ``$$``."""
    parts: list[int | str] = []
    at = 0
    for m in re.finditer(r"\$(?:(\$)|(\w+)|\{(\w+)\})", replacement):
        parts.append("t" + replacement[at : m.start()])
        name = m[2] or m[3]
        parts.append("t$" if m[1] else int(name) if name.isdigit() else "n" + name)
        at = m.end()
    return [*parts, "t" + replacement[at:]]


def _java_names(pattern: str) -> tuple[str, dict[str, int]]:
    """``(?P<name>`` as Java writes it, and each name's group number."""
    names: dict[str, int] = {}
    group = 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?P?<([A-Za-z_]\w*)>", pattern):
        if m[0].startswith("("):
            group += 1
            if m[1]:
                names[m[1]] = group
    return re.sub(r"\(\?P?<([A-Za-z_]\w*)>", "(", pattern), names


def _put(v: Vector, label: str, value: Column) -> Vector:
    labels = v.labels if label in v.labels else (*v.labels, label)
    df = v.df.withColumn(col(label), F.coalesce(value, F.lit(""))).select(*of(labels), "step", "value")
    one = v.one_name and label != NAME
    return checked(Vector(df, labels, one), "vector cannot contain metrics with the same labelset")


def label_replace(v: Vector, to: str, replacement: str, source: str, pattern: str) -> Vector:
    """``to`` becomes ``replacement`` where ``pattern`` matches all of ``source``; an empty result removes the label."""
    pattern, names = _java_names(pattern)
    whole = f"^(?s:{pattern})$"
    text = F.col(col(source)) if source in v.labels else F.lit("")
    groups = re.compile(pattern).groups
    parts = []
    for p in _expanded(replacement):
        n = p if isinstance(p, int) else names.get(p[1:], -1) if p[0] == "n" else None
        if n is None:
            parts.append(F.lit(p[1:]))
        elif 0 <= n <= groups:
            parts.append(F.coalesce(F.regexp_extract(text, whole, n), F.lit("")))
    old = F.col(col(to)) if to in v.labels else F.lit("")
    return _put(v, to, F.when(text.rlike(whole), F.concat(*parts)).otherwise(old))


def label_join(v: Vector, to: str, separator: str, sources: list[str]) -> Vector:
    return _put(v, to, F.concat_ws(separator, *[F.col(col(x)) if x in v.labels else F.lit("") for x in sources]))
