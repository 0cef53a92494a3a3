"""Linear referencing. A network is a table of vertices (route_id, seq, x, y, m) and one of routes (route_id, total_length,
calibrated). Operators are windows over a route's vertices and joins by route; two ways of merging events are folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP, TOLERANCE = 1e-9, 1e-3


def _along(order: str = "seq") -> Window:
    return Window.partitionBy("route_id").orderBy(order)


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def create(vertices: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Measures along each route from 0 to its length, or evenly from `from_measure` to `to_measure` (ends by
    route_id) where both are numbers. Routes under two vertices or without an id are left out."""
    w = _along()
    d = F.coalesce(hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    whole = Window.partitionBy("route_id")
    v = vertices.where("route_id is not null and cast(route_id as string) <> ''").withColumn("step", d)
    v = v.withColumn("m", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumns({"n": F.count("*").over(whole), "length": F.max("m").over(whole)}).where("n >= 2")
    if ends is not None:
        v = v.join(ends.select("route_id", F.col("from_measure").try_cast("double").alias("a"), F.col("to_measure").try_cast("double").alias("b")), "route_id", "left")
        share = F.when(F.col("length") > 0, F.col("m") / F.nullif(F.col("length"), F.lit(0.0))).otherwise(0.0)
        v = v.withColumn("m", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") + share * (F.col("b") - F.col("a"))).otherwise(F.col("m")))
    return v.select("route_id", "seq", "x", "y", "m", F.col("length").alias("total_length"))


def segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices as (route_id, seq, x0, y0, m0, x1, y1, m1)."""
    w = _along()
    return vertices.select("route_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("m").alias("m0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.lead("m").over(w).alias("m1")).where("x1 is not null")


def project(x: Column, y: Column) -> dict[str, Column]:
    """Where a point falls on a segment's columns: its share t, distance and measure."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x0")) * dx + (y - F.col("y0")) * dy) / F.nullif(length, F.lit(0.0))))).otherwise(0.0)
    return {"px": F.col("x0") + t * dx, "py": F.col("y0") + t * dy, "d": hypot(x - F.col("x0") - t * dx, y - F.col("y0") - t * dy), "pm": F.col("m0") + t * (F.col("m1") - F.col("m0"))}


def locate(vertices: DataFrame, events: DataFrame, max_dist: float = 0.01) -> DataFrame:
    """Events (id, route_id, x, y) on their own route's nearest segment, the first of equals; status found or
    not_found, with zeros. max_dist of 0 or less accepts any distance."""
    seg = segments(vertices)
    e = events.select("id", "route_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    hit = e.join(seg, "route_id").withColumns(project(F.col("ex"), F.col("ey")))
    best = hit.groupBy("id").agg(F.min_by(F.struct("px", "py", "pm", "d"), F.struct("d", "seq")).alias("b"))
    near = F.col("b").isNotNull() & (F.lit(max_dist <= 0) | (F.col("b.d") <= max_dist))
    zero = lambda c: F.when(near, F.col(c)).otherwise(0.0)
    return events.select("id", "route_id").join(best, "id", "left").select("id", "route_id", zero("b.pm").alias("measure"), zero("b.d").alias("offset"), F.when(near, "found").otherwise("not_found").alias("status"), zero("b.px").alias("x"), zero("b.py").alias("y"))


def points_at(vertices: DataFrame, events: DataFrame) -> DataFrame:
    """L03 point events: (id, route_id, measure) to a place on the route; measures off the route are left out."""
    seg = segments(vertices)
    on = (F.col("measure") >= F.col("m0")) & (F.col("measure") <= F.col("m1")) & (F.col("m1") > F.col("m0"))
    t = (F.col("measure") - F.col("m0")) / (F.col("m1") - F.col("m0"))
    hit = events.join(seg, "route_id").where(on)
    return hit.groupBy("id", "route_id", "measure").agg(F.min_by(F.struct((F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y")), "seq").alias("p")).select("id", "route_id", "measure", "p.x", "p.y")


def sublines(vertices: DataFrame, events: DataFrame) -> DataFrame:
    """L03 linear events: (id, route_id, from_measure, to_measure) cut from the route and clipped to it: the vertices in
    order and the length. Only segments that overlap an event are joined to it."""
    seg = segments(vertices)
    span = vertices.groupBy("route_id").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    e = events.join(span, "route_id").withColumns({"a": F.greatest(F.least("from_measure", "to_measure"), "lo"), "b": F.least(F.greatest("from_measure", "to_measure"), "hi")}).where("a < b")
    at = lambda m, p, q: F.col(p) + (m - F.col("m0")) / F.nullif(F.col("m1") - F.col("m0"), F.lit(0.0)) * (F.col(q) - F.col(p))
    cut = e.join(seg, "route_id").where((F.col("m1") > F.col("a")) & (F.col("m0") < F.col("b")))
    u, v = F.greatest("m0", "a"), F.least("m1", "b")
    piece = cut.select("id", "route_id", "a", "b", "seq", at(u, "x0", "x1").alias("xa"), at(u, "y0", "y1").alias("ya"), at(v, "x0", "x1").alias("xb"), at(v, "y0", "y1").alias("yb"))
    rows = piece.groupBy("id", "route_id", "a", "b").agg(F.array_sort(F.collect_list(F.struct("seq", "xa", "ya", "xb", "yb"))).alias("s"), F.sum(hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))).alias("length"))
    line = F.concat(F.transform(F.slice("s", 1, 1), lambda p: F.struct(p["xa"].alias("x"), p["ya"].alias("y"))), F.transform("s", lambda p: F.struct(p["xb"].alias("x"), p["yb"].alias("y"))))
    return rows.select("id", "route_id", F.col("a").alias("from_measure"), F.col("b").alias("to_measure"), "length", line.alias("vertices"))


def offset_line(vertices: Column, distance: Column) -> Column:
    """A line moved sideways along the mean of its segments' normals at each vertex; positive is to the left. A
    distance of 0 or null leaves it."""
    n = F.size(vertices)

    def normal(i: Column) -> Column:
        a, b = F.try_element_at(vertices, i), F.try_element_at(vertices, i + 1)
        l = F.nullif(hypot(b["x"] - a["x"], b["y"] - a["y"]), F.lit(0.0))
        return F.struct((-(b["y"] - a["y"]) / l).alias("x"), ((b["x"] - a["x"]) / l).alias("y"))

    def move(v: Column, i: Column) -> Column:
        before, after = F.when(i > 0, normal(F.greatest(i, F.lit(1)))), F.when(i + 1 < n, normal(i + 1))
        mean = lambda c: F.coalesce((before[c] + after[c]) / 2, before[c], after[c], F.lit(0.0))
        size = F.nullif(hypot(mean("x"), mean("y")), F.lit(0.0))
        return F.struct((v["x"] + distance * F.coalesce(mean("x") / size, F.lit(0.0))).alias("x"), (v["y"] + distance * F.coalesce(mean("y") / size, F.lit(0.0))).alias("y"))

    return F.when((F.coalesce(distance, F.lit(0.0)) == 0) | (n < 2), vertices).otherwise(F.transform(vertices, move))


def merge_events(events: DataFrame, mode: str = "both", by: tuple[str, ...] = ()) -> DataFrame:
    """Events of one route (and further keys) joined where they touch (concatenate), overlap (dissolve) or either.
    For `both` islands come from a running maximum. In the others an island depends on the one before, so sorted events
    are folded in one pass that holds a batch and one island, however many events a route has."""
    keys = ["route_id", *by]
    if mode == "both":
        w = Window.partitionBy(*keys).orderBy("from_measure", "to_measure", "id")
        before = F.max("to_measure").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(before.isNull() | (F.col("from_measure") > before + GAP), 1).otherwise(0)
        rows = events.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy(*keys, "island").agg(F.min("from_measure").alias("from_measure"), F.max("to_measure").alias("to_measure"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from_measure", "to_measure", "id"))), lambda e: e["id"].cast("string")), ";").alias("source_event")).drop("island")
    names = [f"__k{i}" for i in range(len(keys))]  # extra columns may bear the names of the result
    rows = events.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.col("from_measure").cast("double").alias("a"), F.col("to_measure").cast("double").alias("b"), F.col("id").cast("string").alias("ids"))
    rows = rows.repartition(*names).sortWithinPartitions(*names, "a", "b", "ids")
    found = rows.mapInArrow(lambda batches: _islands(batches, len(keys), mode == "concatenate"), rows.schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keys, names)], F.col("a").alias("from_measure"), F.col("b").alias("to_measure"), F.col("ids").alias("source_event"))


def _islands(batches, keys: int, touching: bool):
    """Islands of events (keys, a, b, ids) that come in order; batches end anywhere."""
    import pyarrow as pa

    key, low, high, ids, schema = None, None, None, [], None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for t in batches:
        schema, out = t.schema, []
        for row in zip(*[c.to_pylist() for c in t.columns]):
            k, (a, b, i) = row[:keys], row[keys:]
            joins = k == key and a is not None and high is not None and (abs(a - high) <= GAP if touching else a < high - GAP)
            if joins:
                high = max(high, b) if b is not None else high
            else:
                if key is not None:
                    out.append((*key, low, high, ";".join(ids)))
                key, low, high, ids = k, a, b, []
            if i is not None:
                ids.append(i)
        if out:
            yield batch(out)
    if key is not None:
        yield batch([(*key, low, high, ";".join(ids))])


def calibrate(vertices: DataFrame, points: DataFrame, max_dist: float = 1.0) -> DataFrame:
    """Measures interpolated between calibration points (route_id, measure, x, y), which are projected on their
    route; beyond the first and last point the nearest slope goes on (1 for a single point). Points in one place with
    different measures, or measures that do not grow, fail the route, which is then left out."""
    geo = create(vertices.select("route_id", "seq", "x", "y"))
    seg = segments(geo)
    p = points.withColumn("pid", F.monotonically_increasing_id()).select("pid", "route_id", F.col("measure").cast("double").alias("measure"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    hit = p.join(seg, "route_id").withColumns(project(F.col("ex"), F.col("ey"))).groupBy("pid", "route_id", "measure").agg(F.min_by(F.struct("pm", "d"), F.struct("d", "seq")).alias("b")).where(F.col("b.d") <= max_dist)
    w = Window.partitionBy("route_id").orderBy("s", "pid")
    marks = hit.select("route_id", "pid", F.col("b.pm").alias("s"), "measure").withColumns({"ps": F.lag("s").over(w), "pm": F.lag("measure").over(w)})
    bad = marks.where("ps is not null and ((s - ps < 1e-9 and measure <> pm) or (s - ps >= 1e-9 and measure <= pm))").select("route_id").distinct()
    marks = marks.join(bad, "route_id", "left_anti").where("ps is null or s - ps >= 1e-9").select("route_id", "s", "measure")
    all_ = marks.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("s", "measure"))).alias("k"))
    both = geo.select("route_id", F.col("m").alias("s"), "x", "y", F.lit(0).alias("mark")).join(all_, "route_id")
    # Calibration points become vertices.
    inner = segments(geo).join(marks.withColumnRenamed("s", "ms"), "route_id").where("ms > m0 and ms < m1")
    t = (F.col("ms") - F.col("m0")) / (F.col("m1") - F.col("m0"))
    added = inner.select("route_id", F.col("ms").alias("s"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"), F.lit(1).alias("mark")).join(all_, "route_id")
    s, k = F.col("s"), F.col("k")
    n = F.size(k)
    i = F.least(F.greatest(F.size(F.filter(k, lambda c: c["s"] <= s)), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    a, b = F.element_at(k, i), F.try_element_at(k, i + 1)
    slope = F.when(n > 1, (b["measure"] - a["measure"]) / F.nullif(b["s"] - a["s"], F.lit(0.0))).otherwise(1.0)
    rows = both.unionByName(added).withColumn("m", a["measure"] + (s - a["s"]) * slope)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("route_id").orderBy("s", "mark")) - 1).select("route_id", "seq", "x", "y", "m")


def validate(vertices: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """(route_id, vertex, severity, issue). Routes may bring declared_length and calibrated."""
    w, whole = _along(), Window.partitionBy("route_id")
    v = vertices.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(whole), "dm": F.col("m") - F.lag("m").over(w), "d": hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))})
    v = v.withColumns({"glen": F.sum("d").over(whole), "span": F.max(F.struct("i", "m")).over(whole)["m"] - F.min(F.struct("i", "m")).over(whole)["m"]})
    if routes is not None:
        v = v.join(routes.select("route_id", F.col("declared_length").alias("declared"), F.coalesce("calibrated", F.lit(False)).alias("free")), "route_id", "left")
    else:
        v = v.withColumns({"declared": F.lit(None).cast("double"), "free": F.lit(False)})
    scale = F.when((F.col("glen") > 1e-12) & (F.col("span") > 0), F.col("span") / F.nullif(F.col("glen"), F.lit(0.0))).otherwise(1.0)
    tol = TOLERANCE * F.greatest(F.lit(1.0), scale)
    more = F.col("dm") - F.col("d") * scale
    fixed = ~F.coalesce("free", F.lit(False))
    issue = lambda test, severity, name, at="i": F.when(test, F.struct(F.col(at).cast("int").alias("vertex") if isinstance(at, str) else F.lit(at).alias("vertex"), F.lit(severity).alias("severity"), F.lit(name).alias("issue")))
    long_, first = F.col("n") >= 2, F.col("i") == 1
    found = F.array(
        issue(first & ~long_, "ERROR", "TOO_FEW_VERTICES", 0), issue(long_ & (F.col("m") < 0), "ERROR", "NEGATIVE_MEASURE"),
        issue(long_ & first & fixed & (F.abs("m") > TOLERANCE), "WARNING", "START_NOT_ZERO"), issue(F.col("d") < 1e-12, "WARNING", "ZERO_LENGTH_SEGMENT"),
        issue(F.col("dm") <= 0, "ERROR", "MEASURE_OVERLAP"), issue((F.col("dm") > 0) & fixed & (more > tol), "ERROR", "MEASURE_GAP"),
        issue((F.col("dm") > 0) & fixed & (-more > tol), "ERROR", "MEASURE_SHORT"), issue(long_ & first & (F.abs(F.col("glen") - F.col("declared")) > TOLERANCE), "ERROR", "LENGTH_MISMATCH", 0),
    )
    out = v.select("route_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("route_id", "x.*")
    if routes is None:
        return out
    twice = routes.groupBy("route_id").agg(F.count("*").alias("k")).where("k > 1").select("route_id", F.lit(0).alias("vertex"), F.lit("ERROR").alias("severity"), F.lit("DUPLICATE_ROUTE").alias("issue"))
    return out.unionByName(twice)
