"""Rewrites of a parsed query: constants folded, matchers once each."""

from __future__ import annotations

import math

from .ast import ARITHMETIC, COMPARISONS, Aggregate, Binary, Call, Expr, Number, Selector, Subquery


def _power(a: float, b: float) -> float:
    try:
        return math.pow(a, b)
    except OverflowError:
        return -math.inf if a < 0 and b % 2 == 1 else math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)


def constant(op: str, a: float, b: float) -> float:
    if op == "%":
        return math.nan if b == 0 or math.isinf(a) or a != a or b != b else math.fmod(a, b)
    if op in ARITHMETIC:
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: _divide(a, b), "^": lambda: _power(a, b), "atan2": lambda: math.atan2(a, b)}[op]()
    return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])


def optimize(e: Expr) -> Expr:
    if isinstance(e, Selector):
        return Selector(tuple(dict.fromkeys(e.matchers)), e.range, e.offset, e.at)
    if isinstance(e, Subquery):
        return Subquery(optimize(e.expr), e.range, e.step, e.offset, e.at)
    if isinstance(e, Call):
        return Call(e.name, tuple(map(optimize, e.args))) if e.name != "pi" else Number(math.pi)
    if isinstance(e, Aggregate):
        return Aggregate(e.op, optimize(e.expr), e.param and optimize(e.param), e.by, e.labels)
    if isinstance(e, Binary):
        a, b = optimize(e.left), optimize(e.right)
        if isinstance(a, Number) and isinstance(b, Number) and e.op in (*ARITHMETIC, *COMPARISONS):
            return Number(constant(e.op, a.value, b.value))
        return Binary(e.op, a, b, e.bool_, e.matching)
    return e
