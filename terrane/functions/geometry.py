"""Geometry as columns: a struct of a kind and parts, parts being arrays of vertices. Everything here is a Catalyst
expression; no value leaves the JVM.

A polygon read from WKT keeps all its rings in one vertex list, and a multi-polygon one list per member: predicates are
vertex based and follow that model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<kind: string, parts: array<array<struct<x: double, y: double>>>>"
VERTICES = "array<struct<x: double, y: double>>"
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
NEAR = 1e-9


def at(array: Column, i: int) -> Column:
    """The i-th element from 1, or from the end if negative; null if there is none."""
    return F.try_element_at(array, F.lit(i))


def _but_last(array: Column) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0)))


def _but_first(array: Column) -> Column:
    return F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0)))


def vertex(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x, y) -> Column:
    return F.struct(F.lit("POINT").alias("kind"), F.array(F.array(vertex(x, y))).alias("parts"))


def polygon(vertices: Column) -> Column:
    return F.struct(F.lit("POLYGON").alias("kind"), F.array(vertices).alias("parts"))


def linestring(vertices: Column) -> Column:
    return F.struct(F.lit("LINESTRING").alias("kind"), F.array(vertices).alias("parts"))


def box(minx, miny, maxx, maxy) -> Column:
    """A closed rectangle as a polygon."""
    return polygon(F.array(vertex(minx, miny), vertex(maxx, miny), vertex(maxx, maxy), vertex(minx, maxy), vertex(minx, miny)))


def vertices(g: Column) -> Column:
    return F.flatten(g["parts"])


def is_polygonal(g: Column) -> Column:
    return g["kind"].isin("POLYGON", "MULTIPOLYGON")


def from_wkt(text: Column) -> Column:
    """Geometry of a WKT string; Z and M are dropped; an unreadable string gives null."""
    kind = F.upper(F.regexp_extract(text, r"(?i)^\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\b", 1))
    empty = F.upper(text).rlike(r"\bEMPTY\s*$")
    body = F.regexp_extract(text, r"(?s)\((.*)\)\s*$", 1)
    # Members: of a multi-polygon the groups in double parentheses, of a multi-line or multi-point those in single ones.
    member = (
        F.when(kind == "MULTIPOLYGON", F.split(body, r"\)\s*\)\s*,\s*\(\s*\("))
        .when(kind == "MULTILINESTRING", F.split(body, r"\)\s*,\s*\("))
        .when(kind == "MULTIPOINT", F.split(body, r","))
        .otherwise(F.array(body))
    )

    def read(part: Column) -> Column:
        return F.transform(
            F.filter(F.split(F.regexp_replace(part, r"[()]", " "), ","), lambda s: F.trim(s) != ""),
            lambda s: F.struct(
                F.regexp_extract(s, rf"({NUMBER})\s+({NUMBER})", 1).try_cast("double").alias("x"),
                F.regexp_extract(s, rf"({NUMBER})\s+({NUMBER})", 2).try_cast("double").alias("y"),
            ),
        )

    parts = F.when(empty, F.array().cast(f"array<{VERTICES}>")).otherwise(F.transform(member, read))
    bad = F.exists(F.flatten(parts), lambda v: v["x"].isNull() | v["y"].isNull())
    return F.when((kind != "") & (empty | ((body != "") & ~bad)), F.struct(kind.alias("kind"), parts.alias("parts")))


def to_wkt(g: Column, digits: int = 6, close: bool = False) -> Column:
    """WKT with a fixed number of decimals; close repeats a ring's first vertex at its end where it is missing."""
    number = f"%.{digits}f %.{digits}f"

    def ring(part: Column) -> Column:
        if close:
            part = F.when(is_polygonal(g) & (F.size(part) > 0) & (at(part, 1) != at(part, -1)), F.concat(part, F.slice(part, 1, 1))).otherwise(part)
        return F.array_join(F.transform(part, lambda v: F.format_string(number, v["x"], v["y"])), ", ")

    each = F.transform(g["parts"], ring)
    text = (
        F.when(F.size(vertices(g)) <= 0, F.lit(" EMPTY"))
        .when(g["kind"].isin("POINT", "LINESTRING"), F.concat(F.lit(" ("), F.array_join(each, ", "), F.lit(")")))
        .when(g["kind"].isin("POLYGON", "MULTILINESTRING"), F.concat(F.lit(" (("), F.array_join(each, "), ("), F.lit("))")))
        .when(g["kind"] == "MULTIPOINT", F.concat(F.lit(" (("), F.array_join(each, "), ("), F.lit("))")))
        .otherwise(F.concat(F.lit(" ((("), F.array_join(each, ")), (("), F.lit(")))")))
    )
    return F.concat(g["kind"], text)


def bounds(g: Column) -> dict[str, Column]:
    v = vertices(g)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def _previous(ring: Column) -> Column:
    """Each vertex's predecessor, cyclically."""
    return F.concat(F.slice(ring, -1, 1), _but_last(ring))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; of an axis-aligned box the left and bottom edges are inside, the others outside."""
    def crosses(a: Column, b: Column) -> Column:
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.when(F.size(ring) > 0, F.aggregate(F.zip_with(ring, _previous(ring), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1).otherwise(False)


def in_feature(x: Column, y: Column, g: Column, multi: bool = True) -> Column:
    kinds = ("POLYGON", "MULTIPOLYGON") if multi else ("POLYGON",)
    return g["kind"].isin(*kinds) & F.exists(g["parts"], lambda r: in_ring(x, y, r))


def within(a: Column, b: Column, multi: bool = True) -> Column:
    """Every vertex of a lies in polygon b; a feature without vertices lies in any."""
    kinds = ("POLYGON", "MULTIPOLYGON") if multi else ("POLYGON",)
    return b["kind"].isin(*kinds) & F.forall(vertices(a), lambda v: in_feature(v["x"], v["y"], b, multi))


def contains(a: Column, b: Column) -> Column:
    return within(b, a)


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(length, F.lit(0.0))))).otherwise(0.0)
    return F.sqrt(F.pow(x - a["x"] - t * dx, 2) + F.pow(y - a["y"] - t * dy, 2))


def line_distance(x: Column, y: Column, line: Column) -> Column:
    """Distance to the nearest segment of a vertex list."""
    return F.array_min(F.zip_with(_but_last(line), _but_first(line), lambda a, b: segment_distance(x, y, a, b)))


def intersects(a: Column, b: Column, multi: bool = True, point_in_area: bool = False) -> Column:
    """Some vertex of a touches b: coincides with point b, lies on line b, or inside polygon b. With point_in_area a
    point b inside polygon a counts too. A multi-point or multi-line b never counts."""
    va = vertices(a)
    p = at(at(b["parts"], 1), 1)
    at_point = F.exists(va, lambda v: F.sqrt(F.pow(v["x"] - p["x"], 2) + F.pow(v["y"] - p["y"], 2)) < NEAR)
    if point_in_area:
        at_point = at_point | in_feature(p["x"], p["y"], a, multi)
    on_line = F.exists(va, lambda v: F.coalesce(line_distance(v["x"], v["y"], at(b["parts"], 1)) < NEAR, F.lit(False)))
    inside = F.exists(va, lambda v: in_feature(v["x"], v["y"], b, multi))
    out = F.when(b["kind"] == "POINT", F.coalesce(at_point, F.lit(False))).when(b["kind"] == "LINESTRING", on_line).when(b["kind"].isin(*(("POLYGON", "MULTIPOLYGON") if multi else ("POLYGON",))), inside)
    return out.otherwise(False)


def vertex_distance(a: Column, b: Column) -> Column:
    """Least distance between vertices; null if either has none."""
    vb = vertices(b)
    return F.array_min(F.flatten(F.transform(vertices(a), lambda p: F.transform(vb, lambda q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))))))


def ring_area2(ring: Column) -> Column:
    """Twice the signed area."""
    return _sum(F.zip_with(_previous(ring), ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))


def ring_length(ring: Column) -> Column:
    return _sum(F.zip_with(_previous(ring), ring, _step))


def _step(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))


def line_length(line: Column) -> Column:
    n = F.size(line)
    return F.when(n > 1, _sum(F.zip_with(_but_last(line), _but_first(line), _step))).otherwise(0.0)


def measures(g: Column) -> dict[str, Column]:
    """area, perimeter, length and vertices of single-part geometries; what doesn't apply is 0."""
    part = at(g["parts"], 1)
    area = F.when(g["kind"] == "POLYGON", F.abs(ring_area2(part)) / 2).otherwise(0.0)
    perimeter = F.when(g["kind"] == "POLYGON", ring_length(part)).otherwise(0.0)
    length = F.when(g["kind"] == "LINESTRING", line_length(part)).otherwise(0.0)
    return {"area": area, "perimeter": perimeter, "length": length, "vertices": F.size(vertices(g)).cast("long")}


def _ring_centre(ring: Column) -> Column:
    """(x, y, weight): weighted by area; the mean of vertices where the area vanishes."""
    twice = ring_area2(ring)
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    sx = _sum(F.zip_with(_previous(ring), ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b)))
    sy = _sum(F.zip_with(_previous(ring), ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b)))
    n = F.nullif(F.size(ring), F.lit(0))
    flat = F.abs(twice) < 1e-12
    return F.struct(
        F.when(flat, _sum(F.transform(ring, lambda v: v["x"])) / n).otherwise(sx / F.nullif(3 * twice, F.lit(0.0))).alias("x"),
        F.when(flat, _sum(F.transform(ring, lambda v: v["y"])) / n).otherwise(sy / F.nullif(3 * twice, F.lit(0.0))).alias("y"),
        (F.abs(twice) / 2).alias("w"),
    )


def _line_middle(line: Column) -> Column:
    """(x, y, weight) of the point halfway along a line."""
    steps = F.zip_with(_but_last(line), _but_first(line), lambda a, b: F.struct(a.alias("a"), b.alias("b"), _step(a, b).alias("l")))
    total = line_length(line)
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def walk(s: Column, e: Column) -> Column:
        t = (total / 2 - s["done"]) / F.nullif(e["l"], F.lit(0.0))
        here = s["x"].isNull() & (e["l"] > 0) & (s["done"] + e["l"] >= total / 2)
        return F.struct(
            (s["done"] + e["l"]).alias("done"),
            F.when(here, e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).otherwise(s["x"]).alias("x"),
            F.when(here, e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).otherwise(s["y"]).alias("y"),
        )

    mid = F.aggregate(steps, start, walk)
    first = at(line, 1)
    return F.struct(F.coalesce(mid["x"], first["x"]).alias("x"), F.coalesce(mid["y"], first["y"]).alias("y"), total.alias("w"))


def centroid(g: Column) -> Column:
    """Point: itself; line: halfway point; polygon: area centre; multi: weighted by length or area."""
    def weighted(parts: Column) -> Column:
        w = _sum(F.transform(parts, lambda p: p["w"]))
        n = F.nullif(F.size(parts), F.lit(0))
        mean = lambda c: F.when(w > 0, _sum(F.transform(parts, lambda p: p[c] * p["w"])) / F.nullif(w, F.lit(0.0))).otherwise(_sum(F.transform(parts, lambda p: p[c])) / n)
        return F.struct(mean("x").alias("x"), mean("y").alias("y"))

    points = vertices(g)
    m = F.nullif(F.size(points), F.lit(0))
    mean_of = F.struct((_sum(F.transform(points, lambda v: v["x"])) / m).alias("x"), (_sum(F.transform(points, lambda v: v["y"])) / m).alias("y"))
    return (
        F.when(F.size(points) <= 0, None)
        .when(g["kind"].isin("POINT", "MULTIPOINT"), mean_of)
        .when(g["kind"].isin("LINESTRING", "MULTILINESTRING"), weighted(F.transform(g["parts"], _line_middle)))
        .otherwise(weighted(F.transform(g["parts"], _ring_centre)))
    )


def point_buffer(x: Column, y: Column, distance, segments: int = 8) -> Column:
    """A closed circle of segments + 1 vertices."""
    import math

    turn = 2 * math.pi / segments
    ring = F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: vertex(x + distance * F.cos(i * turn), y + distance * F.sin(i * turn)))
    return polygon(ring)
