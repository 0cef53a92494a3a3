"""Triangulated surfaces and dense interpolants. A triangulation or a system of equations is made on the driver from a
bounded number of samples; everything after it, per triangle or per cell, is a distributed plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import Header, Raster, grid

MOST_NODES, MOST_CENTRES = 200_000, 5_000
_TINY = 1e-12


def _orient(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _in_circle(a, b, c, d) -> bool:
    m = [(p[0] - d[0], p[1] - d[1]) for p in (a, b, c)]
    s = [x * x + y * y for x, y in m]
    return m[0][0] * (m[1][1] * s[2] - m[2][1] * s[1]) - m[0][1] * (m[1][0] * s[2] - m[2][0] * s[1]) + s[0] * (m[1][0] * m[2][1] - m[2][0] * m[1][1]) > 1e-12


def triangulate(points: Sequence[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Delaunay triangles, counter-clockwise, by incremental insertion: each point removes the triangles whose circle holds
    it and is joined to the rim of the hole. Points beyond the hull meet a triangle with a vertex at infinity."""
    n = len(points)
    order = sorted(range(n), key=lambda i: (int((points[i][0] - min(p[0] for p in points)) * math.sqrt(n) / (max(p[0] for p in points) - min(p[0] for p in points) + _TINY)), points[i][1])) if n < 2000 else np.lexsort((np.array([p[1] for p in points]), np.array([p[0] for p in points]))).tolist()
    first = order[0]
    second = next((i for i in order if points[i] != points[first]), None)
    third = next((i for i in order if second is not None and abs(_orient(points[first], points[second], points[i])) > _TINY), None)
    if third is None:
        return []
    a, b, c = first, second, third
    if _orient(points[a], points[b], points[c]) < 0:
        b, c = c, b
    ghost = -1
    across: dict[tuple[int, int], int] = {}
    tris: dict[int, tuple[int, int, int]] = {}
    number = 0

    def add(p, q, r):
        nonlocal number
        tris[number] = (p, q, r)
        for u, v in ((p, q), (q, r), (r, p)):
            across[u, v] = number
        number += 1

    def drop(k):
        p, q, r = tris.pop(k)
        for e in ((p, q), (q, r), (r, p)):
            across.pop(e, None)

    for t in ((a, b, c), (b, a, ghost), (c, b, ghost), (a, c, ghost)):
        add(*t)

    def conflict(k, x) -> bool:
        t = tris[k]
        if ghost in t:
            i = t.index(ghost)
            u, v = points[t[(i + 1) % 3]], points[t[(i + 2) % 3]]
            o = _orient(u, v, x)
            return o > _TINY or abs(o) <= _TINY and min(u[0], v[0]) <= x[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= x[1] <= max(u[1], v[1])
        return _in_circle(*(points[i] for i in t), x)

    last = 0
    for i in order:
        if i in (a, b, c):
            continue
        x = points[i]
        at = last if last in tris else next(iter(tris))
        for _ in range(4 * len(tris) + 10):  # walk towards the point
            t = tris[at]
            if ghost in t:
                if conflict(at, x):
                    break
                j = t.index(ghost)
                at = across[t[(j + 2) % 3], t[(j + 1) % 3]]
                continue
            step = next(((v, u) for u, v in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])) if _orient(points[u], points[v], x) < -_TINY), None)
            if step is None:
                break
            at = across[step]
        if not conflict(at, x):
            at = next((k for k in tris if conflict(k, x)), None)
            if at is None:
                continue
        hole, stack, rim = {at}, [at], []
        while stack:
            k = stack.pop()
            t = tris[k]
            for u, v in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                o = across[v, u]
                if o in hole:
                    continue
                if conflict(o, x):
                    hole.add(o)
                    stack.append(o)
                else:
                    rim.append((u, v))
        rim = [(u, v) for u, v in rim if across[v, u] not in hole]
        for k in hole:
            drop(k)
        for u, v in rim:
            add(*((u, v, i) if ghost not in (u, v) else (v, i, u) if u == ghost else (i, u, v)))
            last = number - 1
    return sorted(tuple(t[(m := t.index(min(t))) :] + t[:m]) for t in tris.values() if ghost not in t)


def build(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R18 from samples (x, y, z): nodes (node, x, y, z), samples in one place averaged, and triangles (triangle, n1, n2, n3)
    with their corners."""
    spark = samples.sparkSession
    pts = samples.where("x is not null and y is not null and z is not null").groupBy("x", "y").agg(F.avg("z").alias("z"))
    if pts.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes for one triangulation")
    rows = [tuple(r) for r in pts.orderBy("x", "y").collect()]
    nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node int, x double, y double, z double")
    tri = triangulate([(r[0], r[1]) for r in rows])
    corners = [(i, *t, *rows[t[0]], *rows[t[1]], *rows[t[2]]) for i, t in enumerate(tri)]
    return nodes, spark.createDataFrame(corners, "triangle int, n1 int, n2 int, n3 int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double")


def topology(triangles: DataFrame) -> DataFrame:
    """(triangle, side, neighbour): neighbours across each side, null on the hull."""
    side = triangles.select("triangle", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("side"), F.col(f"n{i + 1}").alias("u"), F.col(f"n{(i + 1) % 3 + 1}").alias("v")) for i in range(3)])).alias("s")).select("triangle", "s.*")
    other = side.select(F.col("triangle").alias("neighbour"), F.col("u").alias("v"), F.col("v").alias("u"))
    return side.join(other, ["u", "v"], "left").select("triangle", "side", "neighbour")


def _area():
    return ((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / 2


def terrain(triangles: DataFrame) -> DataFrame:
    """Area, surface area, slope in degrees and aspect (clockwise from north; -1 flat) of each triangle's plane."""
    d = 2 * _area()
    gx = ((F.col("z2") - F.col("z1")) * (F.col("y3") - F.col("y1")) - (F.col("z3") - F.col("z1")) * (F.col("y2") - F.col("y1"))) / d
    gy = ((F.col("z3") - F.col("z1")) * (F.col("x2") - F.col("x1")) - (F.col("z2") - F.col("z1")) * (F.col("x3") - F.col("x1"))) / d
    steep = F.sqrt(gx * gx + gy * gy)
    aspect = F.when(steep < 1e-12, -1.0).otherwise(F.pmod(F.degrees(F.atan2(-gx, -gy)) + 360, F.lit(360.0)))
    return triangles.select("triangle", _area().alias("area"), (_area() * F.sqrt(1 + steep * steep)).alias("surface_area"), F.degrees(F.atan(steep)).alias("slope"), aspect.alias("aspect"))


def volume(triangles: DataFrame, level: float = 0.0) -> DataFrame:
    """Volumes above (cut) and below (fill) a level, exactly, also where the plane crosses it; one row."""
    h = F.array_sort(F.array(*[F.col(f"z{i}") - level for i in (1, 2, 3)]))
    a, b, c = h[0], h[1], h[2]
    all_ = _area() * (a + b + c) / 3
    # One corner on its own side cuts off a pyramid of its height over the square of its shares along both sides.
    top = _area() * F.pow(c, 3) / (3 * F.nullif((c - a) * (c - b), F.lit(0.0)))
    low = _area() * F.pow(-a, 3) / (3 * F.nullif((b - a) * (c - a), F.lit(0.0)))
    cut = F.when(a >= 0, all_).when(c <= 0, 0.0).when(b <= 0, top).otherwise(all_ + low)
    return triangles.agg(F.sum(cut).alias("cut"), F.sum(cut - all_).alias("fill"), F.sum(_area()).alias("area"))


def elevation(triangles: DataFrame, places: DataFrame) -> DataFrame:
    """Z at places (id, x, y) on the triangle that holds them; null outside. Places and triangles meet in cells of the
    mean triangle's size."""
    xs, ys = [F.array(*[F.col(f"{c}{i}") for i in (1, 2, 3)]) for c in "xy"]
    size = triangles.agg(F.avg(F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)))).first()[0] or 1.0
    line = lambda v: F.sequence(F.floor((F.array_min(v) - 1e-9) / size), F.floor((F.array_max(v) + 1e-9) / size))
    keyed = triangles.withColumn("cx", F.explode(line(xs))).withColumn("cy", F.explode(line(ys)))
    p = places.select(F.col("id"), F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    part = lambda i, j: ((F.col(f"x{i}") - F.col("px")) * (F.col(f"y{j}") - F.col("py")) - (F.col(f"x{j}") - F.col("px")) * (F.col(f"y{i}") - F.col("py"))) / (2 * _area())
    w = p.join(keyed, ["cx", "cy"]).withColumns({"w1": part(2, 3), "w2": part(3, 1), "w3": part(1, 2)}).where("w1 >= -1e-9 and w2 >= -1e-9 and w3 >= -1e-9")
    z = w.groupBy("id").agg(F.min_by(F.col("w1") * F.col("z1") + F.col("w2") * F.col("z2") + F.col("w3") * F.col("z3"), "triangle").alias("z"))
    return places.select("id").join(z, "id", "left")


def interpolate_linear(samples: DataFrame, header: Header) -> Raster:
    """R09 linear: the triangulated surface at cell centres; no data outside the hull."""
    _, tri = build(samples)
    cells = grid(samples.sparkSession, header).select((F.col("r").cast("long") * header.ncols + F.col("c")).alias("id"), header.x(F.col("c")).alias("x"), header.y(F.col("r")).alias("y"))
    z = elevation(tri, cells)
    return Raster(header, z.select(F.floor(F.col("id") / header.ncols).cast("int").alias("r"), (F.col("id") % header.ncols).cast("int").alias("c"), F.col("z").alias("v")))


_KERNELS = {
    "gaussian": lambda r, s: np.exp(-((r / s) ** 2)), "multiquadric": lambda r, s: np.sqrt(1 + (r / s) ** 2), "inverse_multiquadric": lambda r, s: 1 / np.sqrt(1 + (r / s) ** 2),
    "thin_plate": lambda r, s: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0), "linear": lambda r, s: r,
}


def interpolate_rbf(samples: DataFrame, header: Header, function: str = "thin_plate", sigma: float | None = None) -> Raster:
    """R09 rbf: a radial function at each sample and a linear term, solved on the driver for at most MOST_CENTRES samples;
    cells are evaluated in Arrow batches. sigma is the mean distance to the nearest sample unless given."""
    import pyarrow as pa

    pts = samples.groupBy("x", "y").agg(F.avg("z").alias("z")).limit(MOST_CENTRES + 1).collect()
    if len(pts) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} samples")
    p = np.array(sorted(tuple(r) for r in pts), float)
    xy, z, n = p[:, :2], p[:, 2], len(p)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    s = sigma or (float(np.where(d > 0, d, np.inf).min(1).mean()) if n > 1 else 1.0)
    f = _KERNELS[function]
    tail = np.column_stack([np.ones(n), xy])
    m = np.block([[f(d, s), tail], [tail.T, np.zeros((3, 3))]])
    weights = np.linalg.lstsq(m, np.concatenate([z, np.zeros(3)]), rcond=None)[0]
    shared = samples.sparkSession.sparkContext.broadcast((xy, weights))
    nrows, xll, yll, cs = header.nrows, header.xll, header.yll, header.cellsize

    def run(batches):
        xy, w = shared.value
        for b in batches:
            r, c = (np.asarray(b.column(i), float) for i in (0, 1))
            at = np.column_stack([xll + (c + 0.5) * cs, yll + (nrows - 1 - r + 0.5) * cs])
            v = np.concatenate([f(np.sqrt(((q[:, None] - xy[None]) ** 2).sum(-1)), s) @ w[:-3] + w[-3] + q @ w[-2:] for q in np.array_split(at, max(1, len(at) // 500))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v)], ["r", "c", "v"])

    return Raster(header, grid(samples.sparkSession, header).mapInArrow(run, "r int, c int, v double"))


