"""The expression language of the calculators, compiled to one Catalyst expression.

Grammar, loosest first: `c ? a : b`, comparisons (left to right, 1.0 or 0.0), + and -, * and /, sign, ^ (its right side is a
signed term, so it groups to the right and -2^2 is -4), then numbers, names, calls and parentheses. Equality has a
tolerance of 1e-12 and dividing by less than that gives 0. An unknown function or a stray character is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
_LEX = re.compile(r"\s*(?:([0-9]+\.?[0-9]*|\.[0-9]+)|([A-Za-z_][A-Za-z_0-9]*)|(==|!=|<=|>=|[-+*/^()<>?:,]))")


class ExpressionError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("sign", m[3]))
        at = m.end()
    return out


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _log(x: Column, f: Callable) -> Column:
    return F.when(x > 0, f(x)).when(x == 0, F.lit(-float("inf"))).otherwise(F.lit(float("nan")))


def _mean(*xs: Column) -> Column:
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    return total / F.lit(float(len(xs)))


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "sqrt": (1, F.sqrt), "abs": (1, F.abs), "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "atan": (1, F.atan), "exp": (1, F.exp),
    "log": (1, lambda x: _log(x, F.log)), "log10": (1, lambda x: _log(x, F.log10)), "pow": (2, F.pow),
    "min": (-1, lambda *x: F.least(*x) if len(x) > 1 else x[0]), "max": (-1, lambda *x: F.greatest(*x) if len(x) > 1 else x[0]), "mean": (-1, _mean),
}


class _Parser:
    def __init__(self, text: str, names: Callable[[str], Column]):
        self.items, self.at, self.names = tokens(text), 0, names

    def peek(self, *signs: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] == "sign" and self.items[self.at][1] in signs:
            return self.items[self.at][1]
        return None

    def take(self, *signs: str) -> str | None:
        got = self.peek(*signs)
        self.at += got is not None
        return got

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ExpressionError(f"expected {sign!r}")

    def choice(self) -> Column:
        test = self.compare()
        if not self.take("?"):
            return test
        yes = self.choice()
        self.need(":")
        no = self.choice()
        return F.when((test != 0.0) & ~F.isnan(test) | F.isnan(test), yes).otherwise(no)

    def compare(self) -> Column:
        left = self.sums()
        while sign := self.take("==", "!=", "<=", ">=", "<", ">"):
            right = self.sums()
            number = ~F.isnan(left) & ~F.isnan(right)
            same = (left == right) | (F.abs(left - right) < TINY)
            test = {"==": same, "!=": ~same, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[sign]
            left = _flag(number & test)
        return left

    def sums(self) -> Column:
        left = self.products()
        while sign := self.take("+", "-"):
            right = self.products()
            left = left + right if sign == "+" else left - right
        return left

    def products(self) -> Column:
        left = self.signed()
        while sign := self.take("*", "/"):
            right = self.signed()
            left = left * right if sign == "*" else F.when(F.abs(right) < TINY, 0.0).otherwise(left / F.when(F.abs(right) < TINY, 1.0).otherwise(right))
        return left

    def signed(self) -> Column:
        if self.take("-"):
            return -self.signed()
        if self.take("+"):
            return self.signed()
        base = self.primary()
        return F.pow(base, self.signed()) if self.take("^") else base

    def primary(self) -> Column:
        if self.take("("):
            inner = self.choice()
            self.need(")")
            return inner
        if self.at >= len(self.items):
            raise ExpressionError("unexpected end")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(text))
        if kind != "name":
            raise ExpressionError(f"unexpected {text!r}")
        if not self.take("("):
            return self.names(text)
        if text.lower() not in FUNCTIONS:
            raise ExpressionError(f"unknown function {text}")
        args = [] if self.peek(")") else [self.choice()]
        while self.take(","):
            args.append(self.choice())
        self.need(")")
        count, build = FUNCTIONS[text.lower()]
        if count >= 0 and len(args) != count or not args:
            raise ExpressionError(f"{text} takes {count if count >= 0 else 'some'} arguments, not {len(args)}")
        return build(*args)


def compile_expression(text: str, names: Callable[[str], Column] | Mapping[str, Column]) -> Column:
    """One double-valued column; names are looked up in a mapping or by a function."""
    look = names if callable(names) else names.__getitem__
    p = _Parser(text, lambda n: look(n).cast("double"))
    out = p.choice()
    if p.at != len(p.items):
        raise ExpressionError(f"unexpected {p.items[p.at][1]!r}")
    return out


def names_in(text: str) -> list[str]:
    items = tokens(text)
    return list(dict.fromkeys(t for i, (k, t) in enumerate(items) if k == "name" and (i + 1 == len(items) or items[i + 1] != ("sign", "("))))
