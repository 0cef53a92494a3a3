"""Queries over vector layers and rasters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import raster as R
from ..operators import vector as O
from .layers import CELLS, CUSTOMERS, FACILITIES, PLOTS, RASTER, SAMPLES, ZONES, customers, facilities, plots, raster, samples, zones

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


IN = "x >= x0 AND x < x0 + {w} AND y >= y0 AND y < y0 + {w}"
DIST = "sqrt(power(p.x - f.x, 2) + power(p.y - f.y, 2))"


@query(f"WITH {CUSTOMERS}, {ZONES} SELECT z.fid AS zone, z.name, count(*) AS customers, round(sum(acctbal), 2) AS balance FROM pts p JOIN zones z ON {IN.format(w=20)} GROUP BY 1, 2")
def j01_zone_totals(spark, sf):
    j = O.join(customers(spark, sf), zones(spark, sf), "within", attrs=["name"])
    return j.where("_join_type = 'within'").groupBy(F.col("_target_id").cast("int").alias("zone"), F.col("target_name").alias("name")).agg(F.count("*").alias("customers"), F.round(F.sum("acctbal"), 2).alias("balance"))


def first_in(w: int) -> str:
    return f"m AS (SELECT p.fid, min(z.fid) AS t FROM pts p JOIN zones z ON {IN.format(w=w)} WHERE z.fid % 2 = 0 GROUP BY 1)"


def even_zones(spark, sf, w=30):
    return zones(spark, sf, w).where("fid % 2 = 0")


@query(f"WITH {CUSTOMERS}, {ZONES}, {first_in(30)} SELECT p.fid, coalesce(z.name, '') AS target_name, CASE WHEN m.t IS NULL THEN 'none' ELSE 'within' END AS _join_type, coalesce(CAST(m.t AS VARCHAR), '') AS _target_id FROM pts p LEFT JOIN m USING (fid) LEFT JOIN zones z ON z.fid = m.t")
def j01_join_within(spark, sf):
    return O.join(customers(spark, sf), even_zones(spark, sf), "within", attrs=["name"]).select("fid", "target_name", "_join_type", "_target_id")


@query(f"WITH {CUSTOMERS}, {ZONES}, m AS (SELECT z.fid, min(p.fid) AS t FROM pts p JOIN zones z ON {IN.format(w=20)} GROUP BY 1) SELECT CAST(z.fid AS BIGINT) AS fid, CASE WHEN t IS NULL THEN 'none' ELSE 'contains' END AS _join_type, coalesce(CAST(t AS VARCHAR), '') AS _target_id FROM zones z LEFT JOIN m USING (fid)")
def j01_join_contains(spark, sf):
    return O.join(zones(spark, sf), customers(spark, sf), "contains", attrs=[]).select("fid", "_join_type", "_target_id")


@query(f"WITH {CUSTOMERS}, {ZONES}, {first_in(30)} SELECT p.fid, CASE WHEN m.t IS NULL THEN 'none' ELSE 'intersects' END AS _join_type, coalesce(CAST(m.t AS VARCHAR), '') AS _target_id FROM pts p LEFT JOIN m USING (fid)")
def j01_join_intersects(spark, sf):
    return O.join(customers(spark, sf), even_zones(spark, sf), "intersects", attrs=[]).select("fid", "_join_type", "_target_id")


NEAREST = f"d AS (SELECT p.fid, f.fid AS t, f.name, f.nation, {DIST} AS dist, row_number() OVER (PARTITION BY p.fid ORDER BY {DIST}, f.fid) AS k FROM pts p, fac f)"


@query(f"WITH {CUSTOMERS}, {FACILITIES}, {NEAREST} SELECT fid, name AS target_name, round(dist, 6) AS target_distance, 'nearest' AS _join_type, CAST(t AS VARCHAR) AS _target_id FROM d WHERE k = 1")
def j02_join_nearest(spark, sf):
    return O.join_nearest(customers(spark, sf), facilities(spark, sf), attrs=["name"]).select("fid", "target_name", *r6("target_distance"), "_join_type", "_target_id")


@query(f"WITH {CUSTOMERS}, {ZONES}, {first_in(30)} SELECT p.fid, 'within' AS _query_type, CAST(t AS VARCHAR) AS _target_id FROM pts p JOIN m USING (fid)")
def j03_query_within(spark, sf):
    return O.query(customers(spark, sf), even_zones(spark, sf), "within").select("fid", "_query_type", "_target_id")


@query(f"WITH {CUSTOMERS}, {ZONES}, {first_in(20)} SELECT p.fid, 'not_intersects' AS _query_type, '' AS _target_id FROM pts p ANTI JOIN m USING (fid)")
def j03_query_intersects_invert(spark, sf):
    return O.query(customers(spark, sf), even_zones(spark, sf, 20), "intersects", invert=True).select("fid", "_query_type", "_target_id")


@query(f"WITH {CUSTOMERS}, {FACILITIES}, d AS (SELECT p.fid, f.fid AS t, {DIST} AS dist, row_number() OVER (PARTITION BY p.fid ORDER BY f.fid) AS k FROM pts p JOIN fac f ON {DIST} <= 3) SELECT fid, 'distance' AS _query_type, CAST(t AS VARCHAR) AS _target_id, round(dist, 6) AS _query_distance FROM d WHERE k = 1")
def j04_query_distance(spark, sf):
    return O.query_distance(customers(spark, sf), facilities(spark, sf), 3.0).select("fid", "_query_type", "_target_id", *r6("_query_distance"))


@query(f"WITH {CUSTOMERS}, {FACILITIES}, {NEAREST} SELECT fid, 'not_distance' AS _query_type, '' AS _target_id, round(dist, 6) AS _query_distance FROM d WHERE k = 1 AND dist > 3")
def j04_query_distance_invert(spark, sf):
    return O.query_distance(customers(spark, sf), facilities(spark, sf), 3.0, invert=True).select("fid", "_query_type", "_target_id", *r6("_query_distance"))


@query(f"WITH {CUSTOMERS}, {FACILITIES}, {NEAREST} SELECT fid, CAST(t AS VARCHAR) AS _nearest_id, round(dist, 6) AS _nearest_distance, 'id=' || t || '|name=' || name || '|nation=' || nation AS _nearest_attrs FROM d WHERE k = 1")
def j05_query_nearest(spark, sf):
    return O.query_nearest(customers(spark, sf), facilities(spark, sf)).select("fid", "_nearest_id", *r6("_nearest_distance"), "_nearest_attrs")


@query(f"WITH {CUSTOMERS}, {ZONES}, {first_in(20)} SELECT p.fid, 'within' AS _diff_type FROM pts p ANTI JOIN m USING (fid)")
def j06_difference_within(spark, sf):
    return O.difference(customers(spark, sf), even_zones(spark, sf, 20), "within").select("fid", "_diff_type")


@query(f"WITH {CUSTOMERS}, {FACILITIES}, {NEAREST} SELECT fid, round(dist, 6) AS _min_distance FROM d WHERE k = 1 AND dist > 4")
def j07_difference_distance(spark, sf):
    return O.difference_distance(customers(spark, sf), facilities(spark, sf), 4.0).select("fid", *r6("_min_distance"))


@query(
    f"WITH {CUSTOMERS}, {ZONES}, e AS (SELECT * FROM zones WHERE fid % 2 = 0), m AS (SELECT DISTINCT p.fid FROM pts p JOIN e ON {IN.format(w=20)} ), "
    "c AS (SELECT fid, x0, y0 FROM e), v AS (SELECT fid, unnest([x0, x0 + 20, x0 + 20, x0]) AS x, unnest([y0, y0, y0 + 20, y0 + 20]) AS y FROM c), h AS (SELECT DISTINCT v.fid FROM v JOIN pts p ON p.x = v.x AND p.y = v.y) "
    "SELECT fid, 'symmetric_left' AS _diff_type, CAST(fid AS VARCHAR) AS _source_id, '' AS _target_id FROM pts WHERE fid NOT IN (SELECT fid FROM m) UNION ALL SELECT fid, 'symmetric_right', '', CAST(fid AS VARCHAR) FROM e WHERE fid NOT IN (SELECT fid FROM h)"
)
def j08_symmetric_difference(spark, sf):
    return O.symmetric_difference(customers(spark, sf), even_zones(spark, sf, 20)).select("fid", "_diff_type", "_source_id", "_target_id")


@query(f"WITH {CUSTOMERS}, {FACILITIES}, {NEAREST} SELECT fid, t AS nearest_id, round(dist, 6) AS nearest_distance FROM d WHERE k = 1")
def j09_distance_nearest(spark, sf):
    return O.distance_nearest(customers(spark, sf), facilities(spark, sf)).select("fid", "nearest_id", *r6("nearest_distance"))


@query(f"WITH {FACILITIES}, d AS (SELECT p.fid, f.fid AS t, {DIST} AS dist, row_number() OVER (PARTITION BY p.fid ORDER BY {DIST}, f.fid) AS k FROM fac p JOIN fac f ON p.fid <> f.fid) SELECT fid, round(dist, 6) AS min_distance, t AS closest_id FROM d WHERE k = 1")
def j10_distance_self(spark, sf):
    return O.distance_self(facilities(spark, sf)).select("fid", *r6("min_distance"), "closest_id")


@query(f"WITH {FACILITIES}, d AS (SELECT p.fid AS i, f.fid AS j, {DIST} AS dist FROM fac p JOIN fac f ON p.fid <> f.fid) SELECT i, round(min(dist), 6) AS min_dist, round(max(dist), 6) AS max_dist, round(avg(dist), 6) AS mean_dist, arg_min(j, (dist, j)) AS closest_id FROM d GROUP BY 1")
def j11_distance_matrix(spark, sf):
    return O.distance_matrix(facilities(spark, sf))[1].select("i", *r6("min_dist", "max_dist", "mean_dist"), "closest_id")


@query(f"WITH {CUSTOMERS} SELECT fid, round(sqrt(power(x - 12.5, 2) + power(y - 40, 2)), 6) AS distance_to_point FROM pts")
def j12_distance_point(spark, sf):
    return O.distance_point(customers(spark, sf), 12.5, 40.0).select("fid", *r6("distance_to_point"))


@query(f"WITH {CUSTOMERS} SELECT fid FROM pts WHERE acctbal > 1000 AND segment <> 'BUILDING' AND x <= 70")
def f01_filter_vector(spark, sf):
    return O.filter_vector(customers(spark, sf), "acctbal > 1000 AND segment != 'BUILDING' and x <= 70").select("fid")


@query(f"WITH {CUSTOMERS} SELECT fid, round(acctbal * 2 + x * x - CASE WHEN y > 50 THEN 10 ELSE CASE WHEN y = 50 THEN 0 ELSE CAST(x AS DOUBLE) / (y - 50) END END + greatest(x, y, 3) - power(2, 9), 6) AS score FROM pts")
def f04_calc_vector(spark, sf):
    return O.calc_vector(customers(spark, sf), "score", "acctbal * 2 + x^2 - (y > 50 ? 10 : x / (y - 50)) + max(x, y, 3) - 2^3^2").select("fid", *r6("score"))


@query(f"WITH {CUSTOMERS}, {FACILITIES} SELECT fid, 'a' AS side, x, y FROM pts UNION ALL SELECT fid, 'b', x, y FROM fac")
def u01_merge_vector(spark, sf):
    a, b = customers(spark, sf).withColumn("side", F.lit("a")), facilities(spark, sf).withColumn("side", F.lit("b"))
    v = F.element_at(G.vertices(F.col("geom")), 1)
    return O.merge([a.select("fid", "side", "geom"), b.select("fid", "side", "geom")]).select("fid", "side", v["x"].cast("long").alias("x"), v["y"].cast("long").alias("y"))


@query(f"WITH {CUSTOMERS} SELECT min(fid) AS fid, x, y FROM pts GROUP BY x, y")
def u02_drop_duplicates(spark, sf):
    v = F.element_at(G.vertices(F.col("geom")), 1)
    return O.merge([customers(spark, sf)], drop_dups=True).select("fid", v["x"].cast("long").alias("x"), v["y"].cast("long").alias("y"))


@query(f"WITH {CUSTOMERS} SELECT segment AS _union_group, min(fid) AS fid, count(*) AS _union_count FROM pts GROUP BY 1")
def a05_dissolve_group(spark, sf):
    return O.dissolve(customers(spark, sf), "segment").select("_union_group", "fid", "_union_count")


@query(f"WITH {CUSTOMERS} SELECT min(fid) AS fid, count(*) AS _union_count FROM pts")
def a05_dissolve_all(spark, sf):
    return O.dissolve(customers(spark, sf)).select("fid", "_union_count")


CHAINS = "ch AS (SELECT CAST(s_suppkey AS BIGINT) AS fid, s_suppkey % 10 * 4 + s_suppkey // 10 % 3 AS x0, s_suppkey // 10 * 10 AS y0, 3 + s_suppkey * 7 % 3 AS w FROM supplier)"


def chains(spark, sf):
    """Boxes in rows of ten, each wide enough to reach the next or not."""
    from .layers import table

    k = F.col("s_suppkey")
    x, y, w = k % 10 * 4 + F.floor(k / 10) % 3, F.floor(k / 10) * 10, 3 + k * 7 % 3
    return table(spark, sf, "supplier").select(k.cast("long").alias("fid"), G.box(x, y, x + w, y + 3).alias("geom"))


@query(f"WITH {CHAINS}, l AS (SELECT *, CASE WHEN y0 = lag(y0) OVER o AND x0 <= max(x0 + w) OVER (PARTITION BY y0 ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ch WINDOW o AS (ORDER BY y0, x0)), g AS (SELECT *, sum(new) OVER (ORDER BY y0, x0) AS g FROM l) SELECT min(fid) AS fid, CAST(max(g.g) OVER () AS VARCHAR) AS _union_group, count(*) AS _union_count FROM g GROUP BY g.g".replace("CAST(max(g.g) OVER () AS VARCHAR)", "(SELECT CAST(max(g) AS VARCHAR) FROM g)"))
def a05_union_connected(spark, sf):
    return O.union_connected(chains(spark, sf)).select("fid", "_union_group", "_union_count")


@query(f"WITH {CUSTOMERS}, v AS (SELECT CAST(x AS DOUBLE) AS v, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS n FROM pts WHERE x <> 0) SELECT (SELECT count(*) FROM v) AS count, (SELECT count(*) FROM pts) - (SELECT count(*) FROM v) AS nodata_count, (SELECT count(*) FROM pts) AS total_count, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, sum(v) AS sum, max(v) FILTER (k = n // 2) AS median, max(v) FILTER (k = n // 4) AS p25, max(v) FILTER (k = 3 * n // 4) AS p75 FROM v")
def a01_statistics(spark, sf):
    s = R.statistics(customers(spark, sf).select("x"), "x", nodata=0.0)
    return s.select("count", "nodata_count", "total_count", "min", "max", *r6("mean", "std"), "sum", "median", "p25", "p75")


@query("WITH v AS (SELECT CAST(p_size AS DOUBLE) AS v, (SELECT min(p_size) FROM part) AS lo, (SELECT max(p_size) FROM part) AS hi FROM part), b AS (SELECT least(7, CAST(floor((v - lo) / ((hi - lo) / 8.0)) AS INTEGER)) AS bin, lo, hi FROM v) SELECT CAST(s.bin AS INTEGER) AS bin, round((SELECT max(lo) FROM b) + s.bin * (SELECT max(hi - lo) FROM b) / 8.0, 6) AS bin_low, count(b.bin) AS count FROM range(8) s(bin) LEFT JOIN b ON b.bin = s.bin GROUP BY 1, 2")
def a02_histogram(spark, sf):
    from .layers import table

    return R.histogram(table(spark, sf, "part"), "p_size", 8).select("bin", *r6("bin_low"), "count")


ZONAL = f"{CELLS}, {ZONES}, i AS (SELECT z.fid AS zone, v FROM cells JOIN zones z ON x >= 2 * x0 / 4.0 AND x < 2 * x0 / 4.0 + 13 AND y >= y0 / 2.0 AND y < y0 / 2.0 + 13), k AS (SELECT zone, v, count(*) AS n FROM i WHERE v IS NOT NULL GROUP BY ALL), o AS (SELECT zone, v, row_number() OVER (PARTITION BY zone ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY zone) AS n FROM i WHERE v IS NOT NULL)"


@query(
    f"WITH {ZONAL}, a AS (SELECT zone, sum(v) AS sum, avg(v) AS mean, min(v) AS min, max(v) AS max, stddev_pop(v) AS std, count(v) AS count, count(*) - count(v) AS nodata_count, sum(v * v) AS sum_sq FROM i GROUP BY 1), "
    "m AS (SELECT zone, count(*) AS variety, arg_min(v, (-n, v)) AS majority, arg_min(v, (n, v)) AS rarest FROM k GROUP BY 1), q AS (SELECT zone, max(v) FILTER (k = n // 2) AS median, max(v) FILTER (k = n // 4) AS p25, max(v) FILTER (k = 3 * n // 4) AS p75 FROM o GROUP BY 1) "
    "SELECT CAST(z.fid AS BIGINT) AS zone, coalesce(sum, 0) AS sum, round(coalesce(mean, 0), 6) AS mean, coalesce(min, 0) AS min, coalesce(max, 0) AS max, round(coalesce(std, 0), 6) AS std, coalesce(count, 0) AS count, coalesce(nodata_count, 0) AS nodata_count, coalesce(median, 0) AS median, coalesce(p25, 0) AS p25, coalesce(p75, 0) AS p75, coalesce(variety, 0) AS variety, coalesce(majority, 0) AS majority, CASE WHEN coalesce(variety, 0) > 1 THEN rarest ELSE 0 END AS minority, coalesce(sum_sq, 0) AS sum_sq FROM zones z LEFT JOIN a ON a.zone = z.fid LEFT JOIN m ON m.zone = z.fid LEFT JOIN q ON q.zone = z.fid"
)
def a03_zonal(spark, sf):
    from .layers import table

    x, y = F.col("n_nationkey") % 5 * 10, F.floor(F.col("n_nationkey") / 5) * 10
    z = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("fid"), G.box(x, y, x + 13, y + 13).alias("geom"))
    out = R.zonal(raster(spark, sf), z)
    return out.select("zone", "sum", F.round("mean", 6).alias("mean"), "min", "max", F.round("std", 6).alias("std"), "count", "nodata_count", "median", "p25", "p75", "variety", "majority", "minority", "sum_sq")


@query(f"WITH {RASTER}, p AS (SELECT r, c, v, 0 AS o FROM ras UNION ALL SELECT r + 2, c + 10, v * 2, 1 FROM ras) SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(avg(v), 6) AS v FROM p WHERE v IS NOT NULL GROUP BY 1, 2")
def a06_mosaic_average(spark, sf):
    a = raster(spark, sf)
    from dataclasses import replace

    b = R.Raster(replace(a.header, xll=10.0, yll=-2.0), a.map(F.col("v") * 2).df)
    return R.mosaic([a, b], "average").df.select("r", "c", *r6("v"))


@query(f"WITH {RASTER}, p AS (SELECT r, c, v, 0 AS o FROM ras UNION ALL SELECT r + 2, c + 10, v * 2, 1 FROM ras) SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, arg_max(v, o) AS v FROM p WHERE v IS NOT NULL GROUP BY 1, 2")
def a06_mosaic_last(spark, sf):
    from dataclasses import replace

    a = raster(spark, sf)
    return R.mosaic([a, R.Raster(replace(a.header, xll=10.0, yll=-2.0), a.map(F.col("v") * 2).df)], "last").df


RC = "CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c"


@query(f"WITH {RASTER} SELECT {RC}, CASE WHEN v > 10 AND v <= 40 THEN v END AS v FROM ras")
def f03_filter_raster(spark, sf):
    return R.filter_raster(raster(spark, sf), "value > 10 AND value <= 40").df


@query(f"WITH {RASTER} SELECT {RC}, round(CASE WHEN v > 25 THEN w / v ELSE sqrt(v) * 2 + CASE WHEN v = 5 THEN 1 ELSE 0 END END, 6) AS v FROM ras")
def f05_map_algebra(spark, sf):
    return R.calc([raster(spark, sf), raster(spark, sf, "p_retailprice")], "raster1 > 25 ? raster2 / raster1 : sqrt(raster1) * 2 + (raster1 == 5)").df.select("r", "c", *r6("v"))


@query(f"WITH {RASTER} SELECT {RC}, CASE WHEN v BETWEEN 1 AND 10 THEN 1e0 WHEN v BETWEEN 5 AND 20 THEN 2e0 WHEN abs(v - 33) < 1e-9 THEN 3e0 END AS v FROM ras")
def f07_reclass(spark, sf):
    return R.reclass(raster(spark, sf), [(1, 10, 1.0), (5, 20, 2.0), (33, 33, 3.0)]).df


@query(f"WITH {RASTER} SELECT {RC}, CASE WHEN v BETWEEN 1 AND 10 THEN 1e0 WHEN v BETWEEN 5 AND 20 THEN 2e0 WHEN abs(v - 33) < 1e-9 THEN 3e0 END AS v FROM ras")
def f07_reclass_by_table(spark, sf):
    rules = spark.createDataFrame([(1, 1.0, 10.0, 1.0), (2, 5.0, 20.0, 2.0), (3, 33.0, 33.0, 3.0)], "ord int, lo double, hi double, new double")
    return R.reclass_by_table(raster(spark, sf), rules).df


@query(f"WITH {RASTER} SELECT CAST(r - (nrows - 1 - 2) AS INTEGER) AS r, CAST(c - 5 AS INTEGER) AS c, v FROM ras WHERE c BETWEEN 5 AND 20 AND r >= nrows - 3")
def r05_clip_raster(spark, sf):
    a = raster(spark, sf)
    return R.clip_box(a, (5.5, 0.2, 20.5, 2.5)).df.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


@query(f"WITH {RASTER}, g AS (SELECT i // 25 AS r, i % 25 AS c FROM range(25 * (SELECT max(nrows) // 2 FROM ras)) t(i)), p AS (SELECT g.r, g.c, least((SELECT max(nrows) FROM ras) - 1, CAST(floor((SELECT max(nrows) FROM ras) - ((SELECT max(nrows) // 2 FROM ras) - 1 - g.r + 0.5) * 2 + 0.5) AS BIGINT)) AS sr, least(49, CAST(floor((g.c + 0.5) * 2 + 0.5) AS BIGINT)) AS sc FROM g) SELECT CAST(p.r AS INTEGER) AS r, CAST(p.c AS INTEGER) AS c, v FROM p LEFT JOIN ras ON ras.r = sr AND ras.c = sc")
def r06_resample_nearest(spark, sf):
    return R.resample(raster(spark, sf), 2.0, "nearest").df


@query(f"WITH {FACILITIES} SELECT CAST(99 - y AS INTEGER) AS r, CAST(x AS INTEGER) AS c, CAST(arg_min(nation, fid) AS DOUBLE) AS v FROM fac GROUP BY 1, 2")
def r07_rasterize_points(spark, sf):
    out = R.rasterize(facilities(spark, sf), R.Header(100, 100, -0.5, -0.5), "nation")
    return out.df.where("v is not null")


@query(f"WITH {ZONES}, g AS (SELECT i // 50 AS r, i % 50 AS c, (i % 50 + 0.5) * 2 AS x, (49 - i // 50 + 0.5) * 2 AS y FROM range(2500) t(i)) SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(arg_min(region, fid) AS DOUBLE) AS v FROM g LEFT JOIN zones ON {IN.format(w=30)} GROUP BY 1, 2")
def r07_rasterize_polygons(spark, sf):
    return R.rasterize(zones(spark, sf, 30), R.Header(50, 50, 0.0, 0.0, 2.0), "region").df


@query(f"WITH {CELLS} SELECT CAST(r * 50 + c AS BIGINT) AS fid, v, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM cells WHERE v IS NOT NULL")
def r08_points(spark, sf):
    v = F.element_at(G.vertices(F.col("geom")), 1)
    return R.points(raster(spark, sf)).select("fid", "v", v["x"].alias("x"), v["y"].alias("y"))


GRID = "g AS (SELECT i // 20 AS r, i % 20 AS c, (i % 20 + 0.5) * 5 AS px, (19 - i // 20 + 0.5) * 5 AS py FROM range(400) t(i)), d AS (SELECT r, c, fid, z, sqrt(power(px - x, 2) + power(py - y, 2)) AS d FROM g, smp)"
HEADER = R.Header(20, 20, 0.0, 0.0, 5.0)


@query(f"WITH {SAMPLES}, {GRID} SELECT {RC}, arg_min(z, (d, fid)) AS v FROM d GROUP BY 1, 2")
def r09_nearest(spark, sf):
    return R.interpolate(samples(spark, sf), HEADER, "nearest").df


@query(f"WITH {SAMPLES}, {GRID} SELECT {RC}, round(sum(z / power(d, 2)) / sum(1 / power(d, 2)), 6) AS v FROM d GROUP BY 1, 2")
def r09_idw(spark, sf):
    return R.interpolate(samples(spark, sf), HEADER, "idw").df.select("r", "c", *r6("v"))


@query(f"WITH {SAMPLES}, {GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d, fid) AS k FROM d) SELECT {RC}, round(sum(z / power(d, 1.5)) / sum(1 / power(d, 1.5)), 6) AS v FROM k WHERE k <= 8 GROUP BY 1, 2")
def r09_kriging_alias(spark, sf):
    return R.interpolate(samples(spark, sf), HEADER, "kriging").df.select("r", "c", *r6("v"))


@query(f"WITH {SAMPLES}, d AS (SELECT a.fid, a.z AS t, b.z, b.fid AS o, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM smp a JOIN smp b ON a.fid <> b.fid), p AS (SELECT fid, t, coalesce(arg_min(z, (d, o)) FILTER (d < 1e-12), sum(z / power(greatest(d, 1e-300), 2)) / sum(1 / power(greatest(d, 1e-300), 2))) AS v FROM d GROUP BY 1, 2) SELECT round(avg(abs(v - t)), 6) AS mae, round(sqrt(avg((v - t) * (v - t))), 6) AS rmse, count(*) AS n FROM p")
def a13_cross_validate(spark, sf):
    return R.cross_validate(samples(spark, sf)).select(*r6("mae", "rmse"), "n")


def shifted(r: int, c: int, name: str) -> str:
    return f"LEFT JOIN ras {name} ON {name}.r = a.r + {r} AND {name}.c = a.c + {c}"


STENCIL = "FROM ras a " + " ".join(shifted(r, c, n) for n, r, c in (("kn", -1, 0), ("kne", -1, 1), ("ke", 0, 1), ("kse", 1, 1), ("ks", 1, 0), ("ksw", 1, -1), ("kw", 0, -1), ("knw", -1, -1)))
HORN = ", ".join(f"coalesce({n}.v, a.v) AS {n[1:]}" for n in ("kn", "kne", "ke", "kse", "ks", "ksw", "kw", "knw"))
SLOPE = f"s AS (SELECT a.r, a.c, a.v, {HORN} {STENCIL}), g AS (SELECT r, c, v, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 8 AS dx, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / 8 AS dy, e, w, n, s FROM s)"


@query(f"WITH {RASTER}, {SLOPE} SELECT {RC}, round(CASE WHEN v IS NOT NULL THEN degrees(atan(sqrt(dx * dx + dy * dy))) END, 6) AS v FROM g")
def r10_slope(spark, sf):
    return R.terrain(raster(spark, sf), "slope").df.select("r", "c", *r6("v"))


@query(f"WITH {RASTER}, {SLOPE}, t AS (SELECT r, c, v, dx, dy, degrees(atan2(dy, -dx)) AS t FROM g) SELECT {RC}, round(CASE WHEN v IS NULL THEN NULL WHEN abs(dx) < 1e-12 AND abs(dy) < 1e-12 THEN -1 WHEN t > 90 THEN 450 - t ELSE 90 - t END, 6) AS v FROM t")
def r10_aspect(spark, sf):
    return R.terrain(raster(spark, sf), "aspect").df.select("r", "c", *r6("v"))


@query(f"WITH {RASTER}, {SLOPE} SELECT {RC}, round(CASE WHEN v IS NOT NULL THEN -2 * ((w + e) / 2 - v + (n + s) / 2 - v) * 100 END, 6) AS v FROM g")
def r10_curvature(spark, sf):
    return R.terrain(raster(spark, sf), "curvature").df.select("r", "c", *r6("v"))


D8SQL = " ".join(f"({i}, {r}, {c}, {code}, {far})," for i, (r, c, code, far) in enumerate(((0, 1, 1, "1.0"), (1, 1, 2, "sqrt(2)"), (1, 0, 4, "1.0"), (1, -1, 8, "sqrt(2)"), (0, -1, 16, "1.0"), (-1, -1, 32, "sqrt(2)"), (-1, 0, 64, "1.0"), (-1, 1, 128, "sqrt(2)"))))[:-1]


@query(f"WITH {RASTER}, o(i, dr, dc, code, far) AS (VALUES {D8SQL}), d AS (SELECT a.r, a.c, i, code, (a.v - b.v) / far AS drop_ FROM ras a, o JOIN ras b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.v > b.v), m AS (SELECT r, c, arg_max(code, (drop_, -i)) AS code FROM d GROUP BY 1, 2) SELECT CAST(a.r AS INTEGER) AS r, CAST(a.c AS INTEGER) AS c, CASE WHEN a.v IS NOT NULL THEN CAST(coalesce(code, 0) AS DOUBLE) END AS v FROM ras a LEFT JOIN m ON m.r = a.r AND m.c = a.c")
def r12_flow_direction_steepest(spark, sf):
    return R.steepest(raster(spark, sf)).df


@query(f"WITH {RASTER}, t AS (SELECT r, c, v + w AS v FROM ras) SELECT {RC}, round(CASE WHEN v <= (SELECT min(v) FROM t) * 1.1 + 1e-9 THEN v END, 6) AS v FROM t")
def r16_corridor(spark, sf):
    return R.corridor(raster(spark, sf), raster(spark, sf, "p_retailprice")).df.select("r", "c", *r6("v"))


BREAKS = "class int, low double, high double"


def _breaks(spark, pairs):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], BREAKS).select("class", *r6("low", "high"))


@query(f"WITH {CUSTOMERS}, v AS (SELECT CAST(acctbal AS DOUBLE) AS v, row_number() OVER (ORDER BY acctbal) - 1 AS k, count(*) OVER () AS n FROM pts) SELECT CAST(i AS INTEGER) AS class, round(max(v) FILTER (k = i * (n // 5)), 6) AS low, round(max(v) FILTER (k = (i + 1) * (n // 5) - 1), 6) AS high FROM range(5) t(i), v GROUP BY i")
def a07_quantile(spark, sf):
    return _breaks(spark, R.breaks(customers(spark, sf), "acctbal", "quantile", 5))


@query(f"WITH {CUSTOMERS}, m AS (SELECT min(acctbal) AS lo, max(acctbal) AS hi FROM pts) SELECT CAST(i AS INTEGER) AS class, round(lo + (hi - lo) * i / 5.0, 6) AS low, round(lo + (hi - lo) * (i + 1) / 5.0, 6) AS high FROM range(5) t(i), m")
def a07_equal_interval(spark, sf):
    return _breaks(spark, R.breaks(customers(spark, sf), "acctbal", "equal_interval", 5))


@query(f"WITH {PLOTS} SELECT fid, CAST(w * h AS DOUBLE) AS area, CAST(2 * (w + h) AS DOUBLE) AS perimeter, CAST(5 AS BIGINT) AS vertices FROM plots")
def v01_measures(spark, sf):
    return O.measure(plots(spark, sf)).select("fid", *r6("area", "perimeter"), "vertices")


@query(f"WITH {PLOTS} SELECT fid, round(x0 + w / 2e0, 6) AS cx, round(y0 + h / 2e0, 6) AS cy FROM plots")
def v02_centroid(spark, sf):
    v = F.element_at(G.vertices(F.col("geom")), 1)
    return O.centroids(plots(spark, sf)).select("fid", F.round(v["x"], 6).alias("cx"), F.round(v["y"], 6).alias("cy"))


@query(f"WITH {CUSTOMERS} SELECT fid, CAST(i AS INTEGER) AS k, round(x + 2.5 * cos(i * 2 * pi() / 8), 6) AS bx, round(y + 2.5 * sin(i * 2 * pi() / 8), 6) AS by_ FROM pts, range(9) t(i)")
def v03_buffer_points(spark, sf):
    ring = O.buffer_points(customers(spark, sf), 2.5).select("fid", F.posexplode(G.vertices(F.col("geom"))).alias("k", "v"))
    return ring.select("fid", "k", F.round("v.x", 6).alias("bx"), F.round("v.y", 6).alias("by_"))


@query(f"WITH {CUSTOMERS} SELECT fid FROM pts WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 60")
def v04_clip_points(spark, sf):
    return O.clip_points(customers(spark, sf), (10, 5, 40, 60)).select("fid")


@query(f"WITH {CUSTOMERS} SELECT count(*) AS features, count(*) AS point, CAST(min(x) AS DOUBLE) AS minx, CAST(max(x) AS DOUBLE) AS maxx, CAST(min(y) AS DOUBLE) AS miny, CAST(max(y) AS DOUBLE) AS maxy FROM pts")
def s17_info_vector(spark, sf):
    return O.info(customers(spark, sf)).select("features", "point", "minx", "maxx", "miny", "maxy")


@query(f"WITH {RASTER} SELECT CAST(50 AS INTEGER) AS ncols, CAST(max(nrows) AS INTEGER) AS nrows, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, sum(v) AS sum, count(v) AS valid, count(*) - count(v) AS nodata FROM ras")
def s17_info_raster(spark, sf):
    return R.raster_info(raster(spark, sf)).select("ncols", "nrows", "min", "max", *r6("mean"), "sum", "valid", "nodata")
