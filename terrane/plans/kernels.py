"""Queries of operators that SQL cannot express; tests hold them against brute force and invariants. Where a result has a
part that SQL can express, the query returns that part and carries its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as N
from ..operators import raster as R
from ..operators import shapes as P
from ..operators import surfaces as S
from ..operators import tin as T
from ..operators import vector as O
from ..functions import geometry as G
from .layers import FACILITIES, PLOTS, RASTER, SAMPLES, ZONES, facilities, plots, raster, samples, table, zones
from .paths import LINES, network, streets_as_lines

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def surface(spark, sf) -> R.Raster:
    """The parts raster without gaps, all rows."""
    a = raster(spark, sf)
    return R.Raster(a.header, a.df.select("r", "c", F.coalesce("v", F.lit(25.0)).alias("v")))


@query(None)
def r11_fill(spark, sf):
    return S.fill(surface(spark, sf)).df


@query(None)
def r12_flow_direction(spark, sf):
    return S.flow_direction(S.fill(surface(spark, sf))).df


@query(None)
def r13_flow_accumulation(spark, sf):
    return S.flow_accumulation(S.flow_direction(S.fill(surface(spark, sf)))).df


@query(None)
def r14_watershed(spark, sf):
    d = S.flow_direction(S.fill(surface(spark, sf)))
    return S.watershed(d, [(0, 0), (3, 20)], S.flow_accumulation(d), 3).df


@query(None)
def r15_cost_distance(spark, sf):
    return S.cost_distance(surface(spark, sf), [(0, 0)]).df.select("r", "c", *r6("v"))


@query(None)
def r17_viewshed(spark, sf):
    return S.viewshed(surface(spark, sf), [(0, 0), (2, 30)], radius=15.0).df


@query(None)
def r08_contours(spark, sf):
    out = S.contours(surface(spark, sf), [10.5, 25.5, 40.5])
    return out.groupBy("level", "closed").agg(F.count("*").alias("lines"), F.sum(F.size("vertices")).alias("vertices"))


LEVELS = "(VALUES (10.5), (25.5), (40.5)) l(level)"


@query(
    f"WITH {RASTER}, z AS (SELECT r, c, coalesce(v, 25) AS v FROM ras), q AS (SELECT a.v AS a, b.v AS b, e.v AS e, d.v AS d FROM z a JOIN z b ON b.r = a.r AND b.c = a.c + 1 JOIN z e ON e.r = a.r + 1 AND e.c = a.c JOIN z d ON d.r = a.r + 1 AND d.c = a.c + 1), "
    f"s AS (SELECT CAST(level AS DOUBLE) AS level, CAST(a >= level AS INT) AS a, CAST(b >= level AS INT) AS b, CAST(d >= level AS INT) AS d, CAST(e >= level AS INT) AS e FROM q, {LEVELS}) SELECT level, CAST(sum((abs(a - b) + abs(b - d) + abs(d - e) + abs(e - a)) // 2) AS BIGINT) AS segments FROM s GROUP BY 1"
)
def r08_contour_segments(spark, sf):
    return S.contour_segments(surface(spark, sf), [10.5, 25.5, 40.5]).groupBy("level").agg(F.count("*").alias("segments"))


@query(
    f"WITH RECURSIVE {RASTER}, z AS (SELECT r * 50 + c AS k, c, coalesce(v, 25) AS v FROM ras), n AS (SELECT a.k AS a, b.k AS b FROM z a JOIN z b ON a.v = b.v AND (b.k = a.k + 1 AND b.c > 0 OR b.k = a.k - 1 AND a.c > 0 OR abs(b.k - a.k) = 50)), "
    "w(a, b) AS (SELECT k, k FROM z UNION SELECT w.a, n.b FROM w JOIN n ON n.a = w.b), l AS (SELECT a AS k, min(b) AS root FROM w GROUP BY 1) SELECT CAST(v AS DOUBLE) AS value, count(DISTINCT root) AS regions, count(*) AS cells FROM z JOIN l USING (k) GROUP BY 1"
)
def r08_regions(spark, sf):
    return S.regions(surface(spark, sf)).groupBy("value").agg(F.count("*").alias("regions"), F.sum("cell_count").alias("cells"))


@query(f"WITH {SAMPLES} SELECT count(DISTINCT (x, y)) AS nodes FROM smp")
def r18_tin_nodes(spark, sf):
    return T.build(samples(spark, sf))[0].agg(F.count("*").alias("nodes"))


@query(None)
def r18_tin_volume(spark, sf):
    return T.volume(T.build(samples(spark, sf))[1], 10.0).select(*r6("cut", "fill", "area"))


@query(None)
def r18_tin_terrain(spark, sf):
    return T.terrain(T.build(samples(spark, sf))[1]).agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("surface_area"), 6).alias("surface_area"))


@query(None)
def r09_linear(spark, sf):
    return T.interpolate_linear(samples(spark, sf), R.Header(20, 20, 0.0, 0.0, 5.0)).df.select("r", "c", *r6("v"))


@query(None)
def r09_rbf(spark, sf):
    return T.interpolate_rbf(samples(spark, sf), R.Header(20, 20, 0.0, 0.0, 5.0)).df.select("r", "c", F.round("v", 3).alias("v"))


@query(None)
def n05_centrality(spark, sf):
    nodes, edges = network(spark, sf)
    return N.centrality(nodes, edges).select("node_id", *r6("betweenness", "closeness"))


@query(None)
def n13_tour(spark, sf):
    nodes, edges = network(spark, sf)
    order, total = N.tour_exact(N.cost_matrix(nodes, edges.withColumn("oneway", F.lit(0)), [0, 7, 60, 104, 149, 33]))
    return spark.createDataFrame([(i, o, total) for i, o in enumerate(order)], "seq int, stop int, total double")


def _lines(spark, sf):
    return streets_as_lines(spark, sf).select("fid", G.linestring(F.col("vertices")).alias("geom"))


@query(f"WITH {LINES}, d AS (SELECT fid, xs[3] - xs[1] AS dx, ys[3] - ys[1] AS dy, xs[2] - xs[1] AS px, ys[2] - ys[1] AS py FROM ln), t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN sqrt(px * px + py * py) ELSE abs(dx * py - dy * px) / sqrt(dx * dx + dy * dy) END AS far FROM d) SELECT fid, CAST(CASE WHEN far > 20 OR dx = 0 AND dy = 0 THEN 3 ELSE 2 END AS BIGINT) AS vertices FROM t")
def v05_simplify(spark, sf):
    out = P.simplify(_lines(spark, sf), 20.0)
    return out.select("fid", F.size(G.vertices(F.col("geom"))).cast("long").alias("vertices"))


@query(f"WITH {PLOTS} SELECT fid, CAST((w + 4) * (h + 4) AS DOUBLE) AS area FROM plots")
def v03_buffer_polygons(spark, sf):
    return O.measure(P.buffer(plots(spark, sf), 2.0)).select("fid", F.round("area", 4).alias("area"))


@query(f"WITH {ZONES} SELECT CAST(fid AS BIGINT) AS fid, round(CAST(least(x0 + 20, 50) - greatest(x0, 10) AS DOUBLE) * (least(y0 + 20, 70) - greatest(y0, 5)), 6) AS area FROM zones WHERE least(x0 + 20, 50) > greatest(x0, 10) AND least(y0 + 20, 70) > greatest(y0, 5)")
def v04_clip_polygons(spark, sf):
    return O.measure(P.clip_to_box(zones(spark, sf), (10, 5, 50, 70))).select("fid", *r6("area"))


@query(f"WITH {LINES}, l AS (SELECT fid, i, px, py, qx, qy, qx - px AS dx, qy - py AS dy FROM sg), t AS (SELECT *, greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least((20 - px) / dx, (70 - px) / dx) END, CASE WHEN dy = 0 THEN 0 ELSE least((10 - py) / dy, (60 - py) / dy) END) AS a, least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest((20 - px) / dx, (70 - px) / dx) END, CASE WHEN dy = 0 THEN 1 ELSE greatest((10 - py) / dy, (60 - py) / dy) END) AS b FROM l) SELECT fid, round(sum((b - a) * sqrt(dx * dx + dy * dy)), 4) AS length FROM t WHERE b > a AND NOT (dx = 0 AND (px < 20 OR px >= 70)) AND NOT (dy = 0 AND (py < 10 OR py >= 60)) GROUP BY 1")
def v04_clip_lines(spark, sf):
    out = P.clip_to_box(_lines(spark, sf), (20, 10, 70, 60))
    length = F.aggregate(F.transform(F.col("geom")["parts"], G.line_length), F.lit(0.0), lambda a, b: a + b)
    return out.select("fid", F.round(length, 4).alias("length"))


def drawn(spark, sf):
    """Rings of suppliers: a box the right way round, the wrong way round, with a vertex twice, not closed, or crossing
    itself, in turn."""
    k = F.col("s_suppkey")
    x, y = k % 10 * 10, F.floor(k / 10) * 10
    v = lambda a, b: G.vertex(x + a, y + b)
    rings = [(v(0, 0), v(4, 0), v(4, 4), v(0, 4), v(0, 0)), (v(0, 0), v(0, 4), v(4, 4), v(4, 0), v(0, 0)), (v(0, 0), v(4, 0), v(4, 0), v(4, 4), v(0, 4), v(0, 0)), (v(0, 0), v(4, 0), v(4, 4), v(0, 4)), (v(0, 0), v(4, 4), v(4, 0), v(0, 4), v(0, 0))]
    ring = F.array(*rings[0])
    for i, r in enumerate(rings[1:], 1):
        ring = F.when(k % 5 == i, F.array(*r)).otherwise(ring)
    return table(spark, sf, "supplier").select(k.cast("long").alias("fid"), F.struct(F.lit("POLYGON").alias("kind"), F.array(ring).alias("parts")).alias("geom"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS feature_id FROM supplier WHERE s_suppkey % 5 = 4")
def v06_self_crossings(spark, sf):
    return P.self_crossings(drawn(spark, sf)).select("feature_id")


@query("SELECT CAST(s_suppkey AS BIGINT) AS feature_id, CASE s_suppkey % 5 WHEN 1 THEN 'cw_orientation' WHEN 2 THEN 'duplicate_vertex' ELSE 'unclosed_ring' END AS issue FROM supplier WHERE s_suppkey % 5 IN (1, 2, 3)")
def v06_validate(spark, sf):
    return O.validate(drawn(spark, sf)).select("feature_id", "issue")


@query(f"WITH {FACILITIES} SELECT p.fid AS i, min(f.fid) AS closest_id FROM fac p JOIN fac f ON p.fid <> f.fid GROUP BY 1")
def j11_matrix_faithful(spark, sf):
    return O.distance_matrix(facilities(spark, sf), faithful=True)[1].select("i", "closest_id")
