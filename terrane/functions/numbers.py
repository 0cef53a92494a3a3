"""Attribute strings as numbers: by their prefix, or strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = r"^\s*([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:infinity|inf|nan)))"


def prefix_number(text: Column) -> Column:
    """The number a string starts with ("12abc" is 12), else null."""
    found = F.regexp_extract(text.cast("string"), PREFIX, 1)
    return F.when(F.lower(found).rlike("nan"), F.lit(float("nan"))).otherwise(F.nullif(F.regexp_replace(found, r"(?i)infinity|inf", "Infinity"), F.lit("")).try_cast("double"))


def strict_number(text: Column, finite: bool = False) -> Column:
    """The number that the whole string is, else null."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value) if finite else value


def format_g(value: Column, digits: int = 10) -> Column:
    """Up to `digits` significant digits without trailing zeros; NaN and Inf are spelled."""
    size = F.floor(F.log10(F.abs(value)))
    plain = F.regexp_replace(F.regexp_replace(F.format_number(F.round(value, digits), digits), ",", ""), r"\.?0+$", "")
    scaled = value / F.pow(F.lit(10.0), size)
    science = F.concat(F.regexp_replace(F.regexp_replace(F.format_number(scaled, digits - 1), ",", ""), r"\.?0+$", ""), F.lit("e"), F.when(size < 0, "-").otherwise("+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    text = F.when(F.isnan(value), "NaN").when(value == float("inf"), "Inf").when(value == -float("inf"), "-Inf").when(value == 0, "0")
    return text.when((size < -4) | (size >= digits), science).otherwise(plain)
