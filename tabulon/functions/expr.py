"""A small numeric row-expression language, compiled to Spark columns."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([^\W\d]\w*)|`([^`]+)`|(<=|>=|<>|!=|==|&&|\|\||\*\*|[-+*/%^()<>=&|~,]))")
SAME = {"!=": "<>", "==": "=", "&&": "&", "||": "|", "**": "^"}
DEEPEST = 100


class ExpressionError(ValueError):
    """A mistake in an expression, with its place."""

    def __init__(self, said: str, at: int):
        super().__init__(f"{said} (at {at + 1})")
        self.at = at


def finite(c: Column) -> Column:
    """Missing where not a finite number."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def _flag(c: Column) -> Column:
    return c.cast("double")


def _both(a: Column, b: Column, value: Column) -> Column:
    """Missing as soon as either side is, unlike SQL's three-valued logic."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(value)


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, a - b * F.floor(a / b))


def _trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def _present(xs: list[Column]) -> Column:
    return F.filter(F.array(*xs), lambda x: x.isNotNull())


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(xs):
    a = _present(xs)
    return F.when(F.size(a) > 0, _total(a) / F.size(a))


def _variance(xs):
    a = _present(xs)
    m = _total(a) / F.size(a)
    return F.when(F.size(a) > 1, F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(a) - 1))


def _median(xs):
    a = F.array_sort(_present(xs))
    n = F.size(a)
    at = lambda i: F.get(a, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def _cv(xs):
    return F.when(_mean(xs) != 0, F.sqrt(_variance(xs)) / _mean(xs))


ONE = {
    "ABS": F.abs, "SQRT": lambda x: F.when(x >= 0, F.sqrt(x)), "LN": lambda x: F.when(x > 0, F.log(x)), "LG10": lambda x: F.when(x > 0, F.log10(x)),
    "EXP": F.exp, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ARSIN": F.asin, "ARTAN": F.atan, "ATAN": F.atan, "RND": lambda x: F.floor(x + 0.5).cast("double"),
    "TRUNC": _trunc, "SIGN": F.signum, "MISSING": lambda x: _flag(x.isNull()),
}
ONE |= {"LOG10": ONE["LG10"], "ROUND": ONE["RND"]}
TWO = {"MOD": _mod, "POWER": F.pow}
MANY = {
    "SUM": lambda xs: F.when(F.size(_present(xs)) > 0, _total(_present(xs))), "MEAN": _mean, "MEDIAN": _median, "VARIANCE": _variance, "SD": lambda xs: F.sqrt(_variance(xs)),
    "MIN": lambda xs: F.array_min(_present(xs)), "MAX": lambda xs: F.array_max(_present(xs)), "CFVAR": _cv,
}


class _Parser:
    def __init__(self, text: str, columns: list[str]):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at:].strip()[0]!r}", at)
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.tokens.append((kind, SAME.get(m[kind], m[kind]), m.start(kind)))
            at = m.end()
        self.end, self.i, self.depth = len(text), 0, 0
        self.columns = {c.lower(): c for c in columns}
        self.used: list[str] = []

    def peek(self):
        return self.tokens[self.i] if self.i < len(self.tokens) else (0, "", self.end)

    def take(self, *ops: str) -> str | None:
        kind, text, _ = self.peek()
        if kind == 4 and text in ops:
            self.i += 1
            return text
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ExpressionError(f"{op!r} expected", self.peek()[2])

    def whole(self) -> Column:
        out = self.either()
        if self.i < len(self.tokens):
            raise ExpressionError(f"unexpected {self.peek()[1]!r}", self.peek()[2])
        return out

    def either(self) -> Column:
        self.depth += 1
        if self.depth > DEEPEST:
            raise ExpressionError("nested too deeply", self.peek()[2])
        out = self.also()
        while self.take("|"):
            b = self.also()
            out = _both(out, b, _flag((out != 0) | (b != 0)))
        self.depth -= 1
        return out

    def also(self) -> Column:
        out = self.compare()
        while self.take("&"):
            b = self.compare()
            out = _both(out, b, _flag((out != 0) & (b != 0)))
        return out

    def compare(self) -> Column:
        out = self.plus()
        while op := self.take("=", "<>", "<", "<=", ">", ">="):
            b = self.plus()
            out = _flag({"=": out == b, "<>": out != b, "<": out < b, "<=": out <= b, ">": out > b, ">=": out >= b}[op])
        return out

    def plus(self) -> Column:
        out = self.times()
        while op := self.take("+", "-"):
            out = out + self.times() if op == "+" else out - self.times()
        return out

    def times(self) -> Column:
        out = self.power()
        while op := self.take("*", "/", "%"):
            b = self.power()
            out = out * b if op == "*" else (_div if op == "/" else _mod)(out, b)
        return out

    def power(self) -> Column:
        out = self.sign()
        return F.pow(out, self.power()) if self.take("^") else out

    def sign(self) -> Column:
        op = self.take("-", "+", "~")
        if not op:
            return self.atom()
        self.depth += 1
        if self.depth > DEEPEST:
            raise ExpressionError("nested too deeply", self.peek()[2])
        x = self.sign()
        self.depth -= 1
        return -x if op == "-" else x if op == "+" else _flag(x == 0)

    def atom(self) -> Column:
        kind, text, at = self.peek()
        self.i += 1
        if kind == 1:
            return F.lit(float(text))
        if kind == 4 and text == "(":
            out = self.either()
            self.need(")")
            return out
        if kind == 2 and self.take("("):
            return self.call(text.upper(), at)
        if kind == 2 and text.upper() == "PI" and "pi" not in self.columns:
            return F.lit(math.pi)
        if kind in (2, 3):
            if text.lower() not in self.columns:
                raise ExpressionError(f"no column {text!r}", at)
            self.used.append(self.columns[text.lower()])
            return F.expr(f"try_cast(`{self.columns[text.lower()]}` AS double)")
        raise ExpressionError("a value expected", at)

    def call(self, name: str, at: int) -> Column:
        args = []
        if not self.take(")"):
            args.append(self.either())
            while self.take(","):
                args.append(self.either())
            self.need(")")
        for table, count in ((ONE, 1), (TWO, 2)):
            if name in table:
                if len(args) != count:
                    raise ExpressionError(f"{name} takes {count} values", at)
                out = table[name](*args)
                return out if name == "MISSING" else finite(out)
        if name not in MANY:
            raise ExpressionError(f"no function {name}", at)
        if not args:
            raise ExpressionError(f"{name} takes a value at least", at)
        return MANY[name](args)


def compile_expression(text: str, columns: list[str]) -> Column:
    """The expression as a nullable double column; what isn't finite is missing. Raises ExpressionError."""
    return finite(_Parser(text, columns).whole().cast("double"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
