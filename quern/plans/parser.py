"""A recursive-descent parser of the metrics query language."""

from __future__ import annotations

import re

from .ast import AGGREGATES, ARITHMETIC, COMPARISONS, SETS, WITH_PARAM, Aggregate, Binary, Call, Expr, Matcher, Matching, Number, QueryError, Selector, Subquery, Text

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
_DURATION = r"(?:\d+(?:ms|[smhdwy]))+"
_TOKEN = re.compile(
    rf"""(?P<space>[\s]+|\#[^\n]*)
    |(?P<duration>{_DURATION}(?![A-Za-z0-9_]))
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)
    |(?P<name>(?:[A-Za-z_]|:(?=[A-Za-z_:]))[A-Za-z0-9_:]*)
    |(?P<op>==|!=|>=|<=|=~|!~|[-+*/%^<>=(){{}}\[\],:@])""",
    re.X,
)
#: Weakest first.
_LEVELS = (("or",), ("and", "unless"), COMPARISONS, ("+", "-"), ("*", "/", "%", "atan2"))


def duration_ms(text: str) -> int:
    """``1h30m`` in milliseconds; plain numbers are seconds."""
    if not re.fullmatch(_DURATION, text):
        try:
            return round(float(text) * 1000)
        except ValueError:
            raise QueryError(f"not a duration: {text!r}") from None
    return sum(int(n) * _UNITS[u] for n, u in re.findall(r"(\d+)(ms|[smhdwy])", text))


def _unquoted(raw: str) -> str:
    if raw[0] == "`":
        return raw[1:-1]
    simple = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"', "'": "'"}

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c in simple:
            return simple[c]
        raise QueryError(f"unknown escape \\{c} in {raw}")

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, raw[1:-1], flags=re.S)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at]!r} at {at} in {text!r}")
            at = m.end()
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        got = self.peek()
        if value is not None and (got[1] != value or got[0] == "text") or kind is not None and got[0] != kind:
            raise QueryError(f"expected {value or kind}, found {got[1] or 'the end'!r}")
        self.at += 1
        return got[1]

    def accept(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def word(self, *values: str) -> str | None:
        """A keyword in any case."""
        kind, value = self.peek()
        if kind == "name" and value.lower() in values:
            self.at += 1
            return value.lower()
        return None

    # Operators -----------------------------------------------------------------------------------

    def expr(self, level: int = 0) -> Expr:
        if level == len(_LEVELS):
            return self.unary()
        left = self.expr(level + 1)
        while True:
            kind, value = self.peek()
            op = value.lower() if kind == "name" else value if kind == "op" else ""
            if op not in _LEVELS[level]:
                return left
            self.at += 1
            left = self.binary(op, left, lambda: self.expr(level + 1))

    def binary(self, op: str, left: Expr, right) -> Expr:
        flag = bool(self.word("bool"))
        if flag and op not in COMPARISONS:
            raise QueryError(f"bool can't stand after {op}")
        on, labels, many, include = False, (), None, ()
        if (word := self.word("on", "ignoring")) is not None:
            on, labels = word == "on", self.names()
            if (word := self.word("group_left", "group_right")) is not None:
                if op in SETS:
                    raise QueryError(f"{word} can't stand with {op}")
                many = word[6:]
                include = self.names() if self.peek()[1] == "(" else ()
                if on and set(include) & set(labels):
                    raise QueryError("a label can't be in both on and group clauses")
        return Binary(op, left, right(), flag, Matching(on, labels, many, include))

    def unary(self) -> Expr:
        if (op := self.accept("+", "-")) is not None:
            inner = self.unary()
            if op == "+":
                return inner
            return Number(-inner.value) if isinstance(inner, Number) else Binary("*", Number(-1.0), inner)
        return self.power()

    def power(self) -> Expr:
        base = self.postfix(self.primary())
        if self.peek() == ("op", "^"):
            self.at += 1
            return self.binary("^", base, self.unary)  # to the right; binds stronger than a sign before it
        return base

    # Modifiers -----------------------------------------------------------------------------------

    def duration(self) -> int:
        sign = -1 if self.accept("-") else 1
        self.accept("+")
        kind, value = self.peek()
        if kind not in ("duration", "number"):
            raise QueryError(f"expected a duration, found {value!r}")
        self.at += 1
        return sign * duration_ms(value)

    def postfix(self, e: Expr) -> Expr:
        seen: set[str] = set()
        while True:
            if self.peek() == ("op", "["):
                self.at += 1
                span = self.duration()
                if span <= 0:
                    raise QueryError("a range must be positive")
                if self.accept(":"):
                    step = None if self.peek()[1] == "]" else self.duration()
                    if step is not None and step <= 0:
                        raise QueryError("a subquery's step must be positive")
                    self.take("]")
                    e = Subquery(e, span, step)
                else:
                    self.take("]")
                    if not isinstance(e, Selector) or e.range is not None or e.offset or e.at is not None:
                        raise QueryError("a range needs a selector before it")
                    e = Selector(e.matchers, span)
                seen.clear()
            elif self.word("offset"):
                e = self.modified(e, "offset", self.duration(), seen)
            elif self.accept("@"):
                kind, value = self.peek()
                if kind == "name" and value in ("start", "end"):
                    self.at += 1
                    self.take("(")
                    self.take(")")
                    at: int | str = value
                else:
                    sign = -1 if self.accept("-") else 1
                    at = sign * round(float(self.take(kind="number")) * 1000)
                e = self.modified(e, "at", at, seen)
            else:
                return e

    def modified(self, e: Expr, what: str, value, seen: set[str]) -> Expr:
        if not isinstance(e, (Selector, Subquery)):
            raise QueryError(f"{what} needs a selector or a subquery before it")
        if what in seen:
            raise QueryError(f"{what} stands twice")
        seen.add(what)
        return type(e)(**{**e.__dict__, what: value})

    # Primaries -----------------------------------------------------------------------------------

    def primary(self) -> Expr:
        kind, value = self.peek()
        if kind == "number":
            self.at += 1
            return Number(float(int(value, 16)) if value[:2].lower() == "0x" else float(value))
        if kind == "duration":
            self.at += 1
            return Number(duration_ms(value) / 1000)
        if kind == "text":
            self.at += 1
            return Text(_unquoted(value))
        if value == "(":
            self.at += 1
            e = self.expr()
            self.take(")")
            return e
        if value == "{":
            return self.selector(None)
        if kind != "name":
            raise QueryError(f"unexpected {value or 'end'!r}")
        low, after = value.lower(), self.peek(1)
        if low in ("inf", "nan") and after[1] not in ("{", "("):
            self.at += 1
            return Number(float(low))
        if low in AGGREGATES and (after[1] == "(" or after[0] == "name" and after[1].lower() in ("by", "without")):
            return self.aggregate(low)
        self.at += 1
        if after == ("op", "("):
            return Call(value, self.args())
        return self.selector(value)

    def args(self) -> tuple[Expr, ...]:
        self.take("(")
        out: list[Expr] = []
        while self.peek() != ("op", ")"):
            out.append(self.expr())
            if not self.accept(","):
                break
        self.take(")")
        return tuple(out)

    def names(self) -> tuple[str, ...]:
        self.take("(")
        out = []
        while self.peek() != ("op", ")"):
            out.append(self.take(kind="name"))
            if not self.accept(","):
                break
        self.take(")")
        return tuple(out)

    def aggregate(self, op: str) -> Expr:
        self.at += 1
        clause = self.word("by", "without")
        labels = self.names() if clause else None
        args = self.args()
        if not clause and (clause := self.word("by", "without")):
            labels = self.names()
        if len(args) != 1 + (op in WITH_PARAM):
            raise QueryError(f"{op} takes {1 + (op in WITH_PARAM)} arguments, not {len(args)}")
        return Aggregate(op, args[-1], args[0] if op in WITH_PARAM else None, clause != "without", labels)

    def selector(self, name: str | None) -> Expr:
        found = [Matcher("__name__", "=", name)] if name is not None else []
        if self.accept("{"):
            while self.peek() != ("op", "}"):
                kind, value = self.peek()
                if kind == "text" and self.peek(1)[1] in (",", "}"):
                    self.at += 1
                    found.append(Matcher("__name__", "=", _unquoted(value)))
                else:
                    if kind not in ("name", "text"):
                        raise QueryError(f"expected a label, found {value!r}")
                    self.at += 1
                    op = self.accept("=", "!=", "=~", "!~")
                    if op is None:
                        raise QueryError(f"expected a matcher after {value}")
                    found.append(Matcher(_unquoted(value) if kind == "text" else value, op, _unquoted(self.take(kind="text"))))
                if self.word("or"):
                    raise QueryError("or between matchers is not supported")
                if not self.accept(","):
                    break
            self.take("}")
        if name is not None and any(m.name == "__name__" for m in found[1:]):
            raise QueryError("the metric's name stands twice")
        if not any(_selective(m) for m in found):
            raise QueryError("a selector needs a matcher that doesn't match the empty string")
        return Selector(tuple(found))


def _selective(m: Matcher) -> bool:
    if m.op in ("=", "!="):
        return (m.value != "") == (m.op == "=")
    return (re.fullmatch(m.value, "") is None) == (m.op == "=~")


def parse(text: str) -> Expr:
    p = _Parser(text)
    e = p.expr()
    if p.peek()[0] != "end":
        raise QueryError(f"unexpected {p.peek()[1]!r}")
    return e


def parse_selector(text: str) -> Selector:
    e = parse(text)
    if not isinstance(e, Selector) or e.range is not None:
        raise QueryError(f"not a series selector: {text!r}")
    return e


assert set(ARITHMETIC) >= {"^"}
