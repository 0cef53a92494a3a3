"""Filter conditions: `column op value` joined by AND, as one Catalyst predicate."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import prefix_number

_OPS = (">=", "<=", "!=", "=", ">", "<")


class ConditionError(ValueError):
    pass


def parse_condition(text: str) -> list[tuple[str, str, str]]:
    """(column, operator, value) of every conjunct."""
    out = []
    for part in re.split(r"\s+and\s+", text.strip(), flags=re.I):
        part = part.replace("==", "=")
        op = next((o for o in _OPS if o in part), None)
        left, _, right = part.partition(op) if op else (part, "", "")
        if not op or not left.strip():
            raise ConditionError(f"cannot read {part!r}")
        out.append((left.strip().strip("\"'"), op, right.strip().strip("\"'")))
    return out


def compare(value: Column, op: str, other: str) -> Column:
    """Numbers if both sides start with one (equality within 1e-9), else strings byte by byte; null never passes."""
    text = value.cast("string")
    number = prefix_number(text)
    known = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", other)
    words = {"=": text == other, "!=": text != other, ">": text > other, "<": text < other, ">=": text >= other, "<=": text <= other}[op]
    if not known:
        return F.coalesce(words, F.lit(False))
    v = F.lit(float(known[0]))
    near = F.abs(number - v) < 1e-9
    digits = {"=": near, "!=": ~near, ">": number > v, "<": number < v, ">=": number >= v, "<=": number <= v}[op]
    return F.coalesce(F.when(number.isNotNull(), digits).otherwise(words), F.lit(False))


def compile_condition(text: str, column: Callable[[str], Column | None]) -> Column:
    """A predicate; a column that isn't there makes its conjunct false."""
    out = F.lit(True)
    for name, op, value in parse_condition(text):
        c = column(name)
        out = out & (F.lit(False) if c is None else compare(c, op, value))
    return out
