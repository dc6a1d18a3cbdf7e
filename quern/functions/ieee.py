"""IEEE-754 arithmetic as Spark expressions.

Spark in ANSI mode raises on x / 0.0, orders NaN above every number, holds NaN equal to NaN and returns NULL for logarithms of
numbers that have none. These helpers give what floating-point hardware gives, and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN, INF = float("nan"), float("inf")


def nan() -> Column:
    return F.lit(NAN)


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def infinite(x: Column) -> Column:
    return (x == F.lit(INF)) | (x == F.lit(-INF))


def negative(x: Column) -> Column:
    """The sign bit, which -0.0 has as well: atan2(-0.0, -1) is -pi."""
    return (x < 0.0) | ((x == 0.0) & (F.atan2(x, F.lit(-1.0)) < 0.0))


def div(a: Column, b: Column) -> Column:
    zero = F.when((a == 0.0) | is_nan(a), nan()).when(negative(a) == negative(b), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0.0, zero).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    """Truncated remainder, with the sign of a."""
    return F.when((b == 0.0) | infinite(a) | is_nan(a) | is_nan(b), nan()).when(infinite(b), a).otherwise(F.try_mod(a, b))


def compare(op: str, a: Column, b: Column) -> Column:
    some = ~(is_nan(a) | is_nan(b))
    return {
        "==": some & (a == b), "!=": ~(some & (a == b)), ">": some & (a > b), "<": some & (a < b), ">=": some & (a >= b), "<=": some & (a <= b),
    }[op]


def arithmetic(op: str, a: Column, b: Column) -> Column:
    return {
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: div(a, b), "%": lambda: mod(a, b),
        "^": lambda: F.pow(a, b), "atan2": lambda: F.atan2(a, b),
    }[op]()


def log(x: Column, name: str = "ln") -> Column:
    f = {"ln": F.ln, "log2": F.log2, "log10": F.log10}[name]
    return F.when(is_nan(x) | (x < 0.0), nan()).when(x == 0.0, F.lit(-INF)).when(x == INF, F.lit(INF)).otherwise(f(x))


def whole(x: Column, f) -> Column:
    """``f`` (ceil or floor) as a double: large, infinite and undefined values are themselves."""
    return F.when(is_nan(x) | (F.abs(x) >= F.lit(2.0**52)), x).otherwise(f(F.when(~is_nan(x) & (F.abs(x) < F.lit(2.0**52)), x)).cast("double"))


def floor(x: Column) -> Column:
    return whole(x, F.floor)


def ceil(x: Column) -> Column:
    return whole(x, F.ceil)


def sign(x: Column) -> Column:
    return F.when(is_nan(x), x).when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def round_to(x: Column, to: float = 1.0) -> Column:
    """Half towards +infinity."""
    if to == 0:
        return x
    inv = 1.0 / to
    return div(floor(x * F.lit(inv) + 0.5), F.lit(inv))


def least(a: Column, b: Column) -> Column:
    return F.when(is_nan(a) | is_nan(b), nan()).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(is_nan(a) | is_nan(b), nan()).otherwise(F.greatest(a, b))


def max_of(x: Column) -> Column:
    """Aggregate: NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~is_nan(x), x)), nan())


def min_of(x: Column) -> Column:
    return F.min(x)


def quantile(q: float, x: Column) -> Column:
    """Aggregate: linear interpolation between order statistics; a q out of range gives infinities."""
    if q != q:
        return F.max(nan())
    if q < 0 or q > 1:
        return F.max(F.lit(-INF if q < 0 else INF))
    return F.percentile(x, F.lit(q))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _positional(r: Column) -> Column:
    """-1.25E-7 written out."""
    parts = F.named_struct(
        F.lit("digits"), F.regexp_replace(F.concat(F.regexp_extract(r, r"(\d+)\.", 1), F.regexp_extract(r, r"\.(\d+)", 1)), "(?<=.)0+$", ""),
        F.lit("power"), F.regexp_extract(r, r"E(-?\d+)$", 1).cast("int"), F.lit("sign"), F.when(r.startswith("-"), "-").otherwise(""),
    )

    def written(p: Column) -> Column:
        digits, power = p["digits"], p["power"]
        whole = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, F.length(digits))))
        return F.concat(p["sign"], F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(whole))

    return let(parts, written)


def shortest(x: Column) -> Column:
    """The shortest decimal that reads back as x, without an exponent: 6, 0.5, -0, +Inf, NaN."""

    def of(r: Column) -> Column:
        return F.when(r == "Infinity", "+Inf").when(r == "-Infinity", "-Inf").when(r.contains("E"), _positional(r)).otherwise(F.regexp_replace(r, r"\.0$", ""))

    return let(x.cast("double").cast("string"), of)
