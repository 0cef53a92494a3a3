"""Geometry operators that walk along vertices: buffers of lines and polygons, clipping, simplification and the crossing
check. Each feature is worked on alone, in Arrow batches; only geometries pass through Python."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

Part = list[tuple[float, float]]


def each_geometry(df: DataFrame, work: Callable[[str, list[Part]], list[tuple[str, list[Part]]]], geom: str = "geom") -> DataFrame:
    """Applies work to (kind, parts); a row becomes as many rows as it returns geometries."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))]))
    at = df.columns.index(geom)
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)

    def run(batches):
        for b in batches:
            out = []
            for g in b.column(at).to_pylist():
                done = work(g["kind"], [[(p["x"], p["y"]) for p in part] for part in g["parts"]]) if g else []
                out.append([{"kind": k, "parts": [[{"x": x, "y": y} for x, y in part] for part in parts]} for k, parts in done])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*names, "made"])

    from pyspark.sql import types as T

    schema = T.StructType([*plain.schema.fields, T.StructField("made", T._parse_datatype_string(f"array<{G.SCHEMA}>"))])
    rows = plain.mapInArrow(run, schema).withColumn("made", F.explode("made"))
    return rows.select(*[(F.col("made") if i == at else F.col(n)).alias(c) for i, (n, c) in enumerate(zip(names, df.columns))])


def _area2(p: Part) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip([p[-1], *p[:-1]], p)) if p else 0.0


# V03


def line_buffer(line: Part, d: float, segments: int = 8, round_cap: bool = True) -> Part:
    """Offsets on both sides, joined by caps."""
    line = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
    if len(line) < 2:
        return []
    normal = lambda a, b: (-(b[1] - a[1]) / math.dist(a, b), (b[0] - a[0]) / math.dist(a, b))
    side = lambda pts: [q for a, b in zip(pts, pts[1:]) for n in (normal(a, b),) for q in ((a[0] + d * n[0], a[1] + d * n[1]), (b[0] + d * n[0], b[1] + d * n[1]))]

    def cap(p, n):
        start = math.atan2(n[1], n[0])
        return [(p[0] + d * math.cos(start - math.pi * k / segments), p[1] + d * math.sin(start - math.pi * k / segments)) for k in range(1, segments)] if round_cap else []

    back = line[::-1]
    ring = side(line) + cap(line[-1], normal(line[-2], line[-1])) + side(back) + cap(line[0], normal(back[-2], back[-1]))
    return [*ring, ring[0]]


def polygon_buffer(ring: Part, d: float) -> Part:
    """Vertices moved along their bisector, outwards for positive distances whatever the ring's orientation."""
    p = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    n, out = len(p), []
    if n < 3:
        return []
    sign = -1.0 if _area2(p) > 0 else 1.0
    for i in range(n):
        a, b, c = p[i - 1], p[i], p[(i + 1) % n]
        u = [(-(q[1] - o[1]) / (math.dist(o, q) or 1.0), (q[0] - o[0]) / (math.dist(o, q) or 1.0)) for o, q in ((a, b), (b, c))]
        bis = (u[0][0] + u[1][0], u[0][1] + u[1][1])
        size = math.hypot(*bis) or 1.0
        bis = (bis[0] / size, bis[1] / size)
        scale = d / max(0.1, abs(bis[0] * u[0][0] + bis[1] * u[0][1]))
        out.append((b[0] + sign * scale * bis[0], b[1] + sign * scale * bis[1]))
    return [*out, out[0]]


def buffer(df: DataFrame, distance: float, segments: int = 8, round_cap: bool = True) -> DataFrame:
    """Points, lines and polygons; multi-part features give an empty polygon."""
    def work(kind, parts):
        if kind == "POINT" and parts:
            x, y = parts[0][0]
            return [("POLYGON", [[(x + distance * math.cos(2 * math.pi * k / segments), y + distance * math.sin(2 * math.pi * k / segments)) for k in range(segments + 1)]])]
        if kind == "LINESTRING":
            return [("POLYGON", [line_buffer(parts[0], distance, segments, round_cap)])]
        if kind == "POLYGON":
            return [("POLYGON", [polygon_buffer(parts[0], distance)])]
        return [("POLYGON", [])]

    return each_geometry(df, work)


# V04


def _in_ring(x: float, y: float, ring: Part) -> bool:
    hit = False
    for (ax, ay), (bx, by) in zip([ring[-1], *ring[:-1]], ring):
        if (ay > y) != (by > y) and x < (ax - bx) * (y - by) / (ay - by) + bx:
            hit = not hit
    return hit


def convex_parts(ring: Part) -> list[Part]:
    """The ring itself if convex, else its triangles by ear clipping; counter-clockwise."""
    p = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    p = [q for i, q in enumerate(p) if q != p[i - 1]]
    if _area2(p) < 0:
        p = p[::-1]
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    n = len(p)
    if n < 3:
        return []
    if all(cross(p[i - 1], p[i], p[(i + 1) % n]) >= 0 for i in range(n)):
        return [p]
    out = []
    while len(p) > 3:
        for i in range(len(p)):
            a, b, c = p[i - 1], p[i], p[(i + 1) % len(p)]
            if cross(a, b, c) > 0 and not any(q not in (a, b, c) and cross(a, b, q) >= 0 and cross(b, c, q) >= 0 and cross(c, a, q) >= 0 for q in p):
                out.append([a, b, c])
                del p[i]
                break
        else:
            break
    return [*out, p]


def clip_ring(ring: Part, convex: Part) -> Part:
    """The part of a ring inside a counter-clockwise convex one (Sutherland and Hodgman)."""
    out = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    for a, b in zip([convex[-1], *convex[:-1]], convex):
        side = lambda q: (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])
        source, out = out, []
        for p, q in zip([source[-1], *source[:-1]] if source else [], source):
            sp, sq = side(p), side(q)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if sq >= 0:
                out.append(q)
    return [*out, out[0]] if len(out) > 2 and abs(_area2(out)) / 2 > 1e-9 else []


def clip_line(line: Part, ring: Part, invert: bool = False) -> list[Part]:
    """Pieces of a line inside (or outside) a ring, cut where segments cross its sides."""
    edges = list(zip(ring, ring[1:])) if ring[0] == ring[-1] else list(zip([ring[-1], *ring[:-1]], ring))
    out: list[Part] = []
    now: Part = []
    for p, q in zip(line, line[1:]):
        cuts = {0.0, 1.0}
        for a, b in edges:
            den = (q[0] - p[0]) * (b[1] - a[1]) - (q[1] - p[1]) * (b[0] - a[0])
            if abs(den) > 1e-15:
                t = ((a[0] - p[0]) * (b[1] - a[1]) - (a[1] - p[1]) * (b[0] - a[0])) / den
                u = ((a[0] - p[0]) * (q[1] - p[1]) - (a[1] - p[1]) * (q[0] - p[0])) / den
                if 0 < t < 1 and 0 <= u <= 1:
                    cuts.add(t)
        at = sorted(cuts)
        for s, t in zip(at, at[1:]):
            point = lambda k: (p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1]))
            if _in_ring(*point((s + t) / 2), ring) != invert:
                a, b = point(s), point(t)
                if now and math.dist(now[-1], a) < 1e-12:
                    now.append(b)
                else:
                    if len(now) > 1:
                        out.append(now)
                    now = [a, b]
            elif len(now) > 1:
                out.append(now)
                now = []
    return [*out, now] if len(now) > 1 else out


def clip(df: DataFrame, ring: Sequence[tuple[float, float]], invert: bool = False) -> DataFrame:
    """V04 by a polygon: points by any vertex inside, lines cut at the boundary, polygons by convex parts; inverted, a
    polygon that overlaps in part stays whole."""
    ring = [tuple(map(float, p)) for p in ring]
    convex = convex_parts(ring)

    def work(kind, parts):
        if kind in ("POINT", "MULTIPOINT"):
            return [(kind, parts)] if any(_in_ring(x, y, ring) for part in parts for x, y in part) != invert else []
        if kind in ("LINESTRING", "MULTILINESTRING"):
            got = [piece for part in parts for piece in clip_line(part, ring, invert)]
        else:
            got = [g for part in parts for c in convex if part and (g := clip_ring(part, c))]
            if invert:
                whole = all(_in_ring(x, y, ring) for part in parts for x, y in part)
                return [] if got and whole else [(kind, parts)]
        base = kind.replace("MULTI", "")
        return [(base if len(got) == 1 else f"MULTI{base}", got)] if got else []

    return each_geometry(df, work)


def clip_to_box(df: DataFrame, box: tuple[float, float, float, float], invert: bool = False) -> DataFrame:
    x0, y0, x1, y1 = box
    return clip(df, [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], invert)


def clip_to_layer(df: DataFrame, other: DataFrame, invert: bool = False) -> DataFrame:
    """The extent of another layer as the box."""
    from .vector import with_bounds

    b = with_bounds(other).agg(F.min("__minx"), F.min("__miny"), F.max("__maxx"), F.max("__maxy")).first()
    return clip_to_box(df, tuple(b), invert)


# V05


def douglas_peucker(p: Part, tolerance: float) -> Part:
    keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
    while stack:
        i, j = stack.pop()
        a, b = p[i], p[j]
        length = math.dist(a, b)
        far, at = -1.0, -1
        for k in range(i + 1, j):
            q = p[k]
            d = abs((b[0] - a[0]) * (a[1] - q[1]) - (a[0] - q[0]) * (b[1] - a[1])) / length if length > 0 else math.dist(a, q)
            if d > far:
                far, at = d, k
        if far > tolerance:
            keep.add(at)
            stack += [(i, at), (at, j)]
    return [p[k] for k in sorted(keep)]


def visvalingam(p: Part, tolerance: float, least: int = 2) -> Part:
    """Vertices go in order of the area they make, which never falls on the way; the ends stay."""
    n = len(p)
    before, after, alive, version = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n, [0] * n
    area = lambda i: abs((p[before[i]][0] - p[i][0]) * (p[after[i]][1] - p[i][1]) - (p[after[i]][0] - p[i][0]) * (p[before[i]][1] - p[i][1])) / 2
    heap = [(area(i), i, 0) for i in range(1, n - 1)]
    heapq.heapify(heap)
    left, most = n, 0.0
    while heap and left > least:
        a, i, v = heapq.heappop(heap)
        if not alive[i] or v != version[i]:
            continue
        most = max(most, a)
        if most >= tolerance:
            break
        alive[i] = False
        left -= 1
        l, r = before[i], after[i]
        after[l], before[r] = r, l
        for k in (l, r):
            if 0 < k < n - 1:
                version[k] += 1
                heapq.heappush(heap, (area(k), k, version[k]))
    return [q for q, a in zip(p, alive) if a]


def radial(p: Part, tolerance: float) -> Part:
    out = [p[0]]
    for q in p[1:-1]:
        if math.dist(out[-1], q) >= tolerance:
            out.append(q)
    return [*out, p[-1]] if len(p) > 1 else out


def nth(p: Part, n: int) -> Part:
    return [q for i, q in enumerate(p) if i % n == 0 or i == len(p) - 1]


METHODS = {"douglas": douglas_peucker, "visvalingam": visvalingam, "radial": radial, "nth": nth}


def thin(part: Part, method: str, tolerance: float) -> Part:
    """One line or ring; what would fall below two vertices, or below a triangle, stays as it was."""
    closed = len(part) > 2 and part[0] == part[-1]
    if len(part) <= (4 if closed else 2):
        return part
    if closed and method == "douglas":  # the farthest vertex parts the ring into two lines
        far = max(range(len(part)), key=lambda i: math.dist(part[0], part[i]))
        out = douglas_peucker(part[: far + 1], tolerance) + douglas_peucker(part[far:], tolerance)[1:]
    else:
        out = METHODS[method](part, int(tolerance) if method == "nth" else tolerance)
    return out if len(out) >= (4 if closed else 2) else part


def simplify(df: DataFrame, tolerance: float, method: str = "douglas") -> DataFrame:
    """V05."""
    return each_geometry(df, lambda kind, parts: [(kind, parts if "POINT" in kind else [thin(p, method, tolerance) for p in parts])])


def simplify_topology(df: DataFrame, tolerance: float, method: str = "douglas") -> DataFrame:
    """V05 with shared borders: vertices where different neighbours meet cut the rings into arcs; an arc and its reverse
    are one, thinned once, so neighbours stay joined. Arcs are found by joins on vertices, thinned in Arrow batches and put
    together again by order."""
    import pyarrow as pa

    v = df.select("fid", F.posexplode(F.col("geom")["parts"]).alias("part", "ring")).select("fid", "part", F.size("ring").alias("n"), F.posexplode("ring").alias("i", "p"))
    from pyspark.sql import Window

    w = Window.partitionBy("fid", "part").orderBy("i")
    around = v.withColumns({"a": F.lag("p").over(w), "b": F.lead("p").over(w), "first": F.col("i") == 0, "last": F.col("i") == F.col("n") - 1})
    sides = around.select("p", F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("q")).groupBy("p").agg(F.count_distinct("q").alias("k"))
    marked = around.join(sides, "p").withColumn("node", (F.col("k") > 2) | F.col("first") | F.col("last"))
    cut = marked.withColumn("arc", F.sum(F.when(F.col("node"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    both = cut.select("fid", "part", "i", "p", F.explode(F.when(F.col("node") & ~F.col("first") & ~F.col("last"), F.array(F.coalesce("arc", F.lit(0)), F.coalesce("arc", F.lit(0)) + 1)).when(F.col("first"), F.array(F.lit(1))).otherwise(F.array("arc"))).alias("arc"))
    arcs = both.groupBy("fid", "part", "arc").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("s")).withColumn("line", F.transform("s", lambda x: x["p"]))
    back = F.reverse(F.col("line"))
    turned = F.element_at("line", 1) > F.element_at("line", -1)
    arcs = arcs.withColumns({"turned": turned, "key": F.when(turned, back).otherwise(F.col("line"))})

    def run(batches):
        for b in batches:
            out = [[{"x": x, "y": y} for x, y in thin([(p["x"], p["y"]) for p in line], method, tolerance)] for line in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.column(0).type)], ["key", "thin"])

    slim = arcs.select("key").distinct().mapInArrow(run, f"key {G.VERTICES}, thin {G.VERTICES}")
    done = arcs.join(slim, "key").withColumn("line", F.when(F.col("turned"), F.reverse("thin")).otherwise(F.col("thin")))
    ring = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("arc", "line"))), lambda a: a["line"]), F.array().cast(G.VERTICES), lambda s, l: F.concat(s, F.when(F.size(s) > 0, F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0)))).otherwise(l)))
    rings = done.groupBy("fid", "part").agg(ring.alias("ring")).groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ring"))), lambda r: r["ring"]).alias("parts"))
    return df.join(rings, "fid").withColumn("geom", F.struct(F.col("geom")["kind"].alias("kind"), F.col("parts").alias("parts"))).select(*df.columns)


# V06


def self_crossings(df: DataFrame) -> DataFrame:
    """Features with two segments of one part that properly cross: (feature_id, part)."""
    from .network import crossings
    from .vector import cell_size

    parts = df.where(~F.col("geom")["kind"].contains("POINT")).select("fid", F.posexplode(F.col("geom")["parts"]).alias("part", "ring"))
    n = F.size("ring")
    seg = parts.where(n > 3).select("fid", "part", F.posexplode(F.arrays_zip(F.slice("ring", 1, n - 1).alias("p"), F.slice("ring", 2, n - 1).alias("q"))).alias("i", "s"))
    lines = seg.select(F.struct("fid", "part", "i").alias("fid"), F.array("s.p", "s.q").alias("vertices"))
    hit = crossings(lines, max(cell_size(df) / 4, 1e-6)).where("a.fid = b.fid and a.part = b.part")
    return hit.select(F.col("a.fid").alias("feature_id"), F.col("a.part").alias("part")).distinct()


def repair(df: DataFrame) -> DataFrame:
    """V06 -fix: repeated vertices go, rings are closed, then turned counter-clockwise."""
    def work(kind, parts):
        out = []
        for part in parts:
            p = [q for i, q in enumerate(part) if i == 0 or q != part[i - 1]]
            if "POLYGON" in kind and len(p) > 2:
                p = p if p[0] == p[-1] else [*p, p[0]]
                p = p[::-1] if _area2(p[:-1]) < 0 else p
            out.append(p)
        return [(kind, out)]

    return each_geometry(df, work)
