"""Round trips through file formats: a whole table is written in the shared folder, read again and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.vector import ready_for_checkpoints
from ..sources import raster_files as RF
from ..sources import vector_files as VF
from .layers import CUSTOMERS, RASTER, ZONES, customers, raster, zones

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def folder(spark, name: str) -> str:
    ready_for_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def named_points(spark, sf) -> VF.VectorLayer:
    return VF.VectorLayer(customers(spark, sf).select("fid", F.col("id").cast("string").alias("id"), "segment", "geom"), "EPSG:5367")


def lowered(spark, sf) -> VF.VectorLayer:
    """The points 50 further south, where all are latitudes."""
    layer = named_points(spark, sf)
    return VF.VectorLayer(layer.df.withColumn("geom", G.point(corner(1, "x"), corner(1, "y") - 50)), "EPSG:4326")


def corner(i: int, k: str):
    return G.at(G.vertices(F.col("geom")), i)[k]


POINTS = f"WITH {CUSTOMERS} SELECT CAST(fid AS VARCHAR) AS id, segment, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pts"
LOWERED = POINTS.replace("CAST(y AS DOUBLE)", "CAST(y - 50 AS DOUBLE)")


@query(POINTS)
def s01_csv_round_trip(spark, sf):
    path = folder(spark, "csv")
    VF.write_spatial_csv(named_points(spark, sf), path)
    return VF.read_spatial_csv(spark, path).df.select("id", "segment", corner(1, "x").alias("x"), corner(1, "y").alias("y"))


@query(f"WITH {ZONES} SELECT name, CAST(region AS VARCHAR) AS region, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + 20 AS DOUBLE) AS x1, CAST(y0 + 20 AS DOUBLE) AS y1 FROM zones")
def s05_geojson_round_trip(spark, sf):
    path = folder(spark, "geojson")
    VF.write_geojson(VF.VectorLayer(zones(spark, sf).select("fid", "name", F.col("region").cast("string").alias("region"), "geom"), "EPSG:5367"), path)
    box = G.bounds(F.col("geom"))
    return VF.read_geojson(spark, path).df.select("name", "region", *[box[k].alias(n) for k, n in (("minx", "x0"), ("miny", "y0"), ("maxx", "x1"), ("maxy", "y1"))])


@query(f"WITH {RASTER} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM ras WHERE v IS NOT NULL")
def s03_ascii_grid_round_trip(spark, sf):
    path = folder(spark, "grid")
    RF.write_ascii_grid(raster(spark, sf), path)
    back, _ = RF.read_ascii_grid(spark, path)
    return back.df.where("v is not null").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


@query(LOWERED)
def s07_osm_round_trip(spark, sf):
    path = folder(spark, "osm")
    VF.write_osm(lowered(spark, sf), path)
    back = VF.read_osm(spark, path)
    return back.select(F.col("tags")["id"].alias("id"), F.col("tags")["segment"].alias("segment"), corner(1, "x").alias("x"), corner(1, "y").alias("y"))


@query(LOWERED)
def s11_xy_round_trip(spark, sf):
    path = folder(spark, "xy")
    customers(spark, sf).select(F.col("id").cast("string").alias("id"), "segment", F.col("x").alias("lon"), (F.col("y") - 50).alias("lat")).write.csv(path, header=True, sep=";")
    good, _ = VF.read_xy(spark, path)
    return good.df.select("id", "segment", corner(1, "x").alias("x"), corner(1, "y").alias("y"))
