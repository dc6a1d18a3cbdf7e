"""Expressions of the metrics query language, as the parser makes them and the planner reads them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


class QueryError(ValueError):
    """A query that can't be parsed or planned."""


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str


@dataclass(frozen=True)
class Expr:
    def show(self, depth: int = 0) -> str:
        """The plan as an indented tree."""
        own, below = [], []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Expr):
                below.append(v)
            elif isinstance(v, tuple) and v and isinstance(v[0], Expr):
                below += v
            elif v not in (None, (), False):
                own.append(f"{f.name}={v!r}")
        return "\n".join(["  " * depth + type(self).__name__ + (f"({', '.join(own)})" if own else ""), *[x.show(depth + 1) for x in below]])


@dataclass(frozen=True)
class Number(Expr):
    value: float


@dataclass(frozen=True)
class Text(Expr):
    value: str


@dataclass(frozen=True)
class Selector(Expr):
    """An instant vector; with ``range`` (ms) the samples of a window."""

    matchers: tuple[Matcher, ...]
    range: int | None = None
    offset: int = 0
    at: int | str | None = None  # ms, "start" or "end"


@dataclass(frozen=True)
class Subquery(Expr):
    expr: Expr
    range: int
    step: int | None = None
    offset: int = 0
    at: int | str | None = None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Aggregate(Expr):
    op: str
    expr: Expr
    param: Expr | None = None
    by: bool = True
    labels: tuple[str, ...] | None = None  # None: no clause, one group


@dataclass(frozen=True)
class Matching:
    on: bool = False
    labels: tuple[str, ...] = ()
    many: str | None = None  # left or right
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    bool_: bool = False
    matching: Matching = field(default_factory=Matching)


ARITHMETIC = ("+", "-", "*", "/", "%", "^", "atan2")
COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")
SETS = ("and", "or", "unless")
AGGREGATES = ("sum", "avg", "min", "max", "count", "stddev", "stdvar", "group", "topk", "bottomk", "quantile", "count_values")
WITH_PARAM = ("topk", "bottomk", "quantile", "count_values")
ROLLUPS = (
    "rate", "increase", "delta", "irate", "idelta", "resets", "changes", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time",
    "count_over_time", "last_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "present_over_time",
)


def is_scalar(e: Expr) -> bool:
    if isinstance(e, Number):
        return True
    if isinstance(e, Binary):
        return is_scalar(e.left) and is_scalar(e.right)
    return isinstance(e, Call) and e.name in ("time", "pi", "scalar")
