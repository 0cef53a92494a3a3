"""Street names and addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical forms of street words.
STREET_WORDS = {
    "street": "St", "st": "St", "str": "St", "avenue": "Ave", "ave": "Ave", "av": "Av", "avenida": "Av", "road": "Rd", "rd": "Rd",
    "boulevard": "Blvd", "blvd": "Blvd", "drive": "Dr", "dr": "Dr", "lane": "Ln", "ln": "Ln", "court": "Ct", "ct": "Ct", "place": "Pl", "pl": "Pl",
    "highway": "Hwy", "hwy": "Hwy", "north": "N", "n": "N", "south": "S", "s": "S", "east": "E", "e": "E", "west": "W", "w": "W",
}


def clean_text(s: Column) -> Column:
    """No byte order mark, dots or semicolons; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^﻿", ""), r"\.", ""), r"[;\s]+", " "))


def _words(s: Column) -> Column:
    return F.filter(F.split(clean_text(s), " "), lambda w: w != "")


def _title(word: Column) -> Column:
    """The first letter and those after a hyphen or apostrophe are capitals."""
    pieces = F.regexp_extract_all(word, F.lit(r"([^-']*[-']?)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.regexp_extract(p, r"^([^A-Za-z]*)", 1), F.upper(F.regexp_extract(p, r"^[^A-Za-z]*([A-Za-z])", 1)), F.lower(F.regexp_replace(p, r"^[^A-Za-z]*[A-Za-z]?", "")))), "")


def title_case(s: Column) -> Column:
    return F.array_join(F.transform(_words(s), _title), " ")


def standard_street(s: Column) -> Column:
    """The canonical street name: "main  STREET." is "Main St"."""
    known = F.create_map(*[F.lit(x) for kv in STREET_WORDS.items() for x in kv])
    return F.array_join(F.transform(_words(s), lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), _title(w))), " ")


def street_key(s: Column) -> Column:
    return F.lower(standard_street(s))


def normal_name(s: Column) -> Column:
    """Lower case with single blanks."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(s, F.lit("")))), r"[ \t]+", " ")


def similarity(a: Column, b: Column, least: float | None = None) -> Column:
    """1 less the edit distance over the longer length; with least, null may stand for what is below it."""
    longest = F.greatest(F.length(a), F.length(b))
    edits = F.levenshtein(a, b) if least is None else F.nullif(F.call_function("levenshtein", a, b, F.ceil(longest * (1 - least)).cast("int")), F.lit(-1))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - edits / F.nullif(longest, F.lit(0)))


def house_number(s: Column) -> Column:
    """A whole number, else null."""
    v = F.trim(s.cast("string")).try_cast("double")
    return F.when(v == F.floor(v), v.cast("int"))
