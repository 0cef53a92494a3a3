"""Streams of points met with static layers. An extension: the operators without state work on streaming DataFrames as they
are; here are zone enrichment and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def in_zones(points: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Points (x, y and any columns) of a stream with the first zone that holds them: a stream-static join on grid cells,
    then the exact test. Zones must not overlap for one row a point; overlapping ones give a row each."""
    b = G.bounds(F.col("geom"))
    line = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    keyed = zones.withColumn("__cx", F.explode(line(b["minx"], b["maxx"]))).withColumn("__cy", F.explode(line(b["miny"], b["maxy"])))
    z = keyed.select("__cx", "__cy", F.col("fid").alias("zone"), F.col("geom").alias("__g"))
    p = points.withColumns({"__cx": F.floor(F.col("x") / size), "__cy": F.floor(F.col("y") / size)})
    return p.join(z, ["__cx", "__cy"]).where(G.in_feature(F.col("x"), F.col("y"), F.col("__g"))).drop("__cx", "__cy", "__g")


def counts(points: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows per zone and tumbling window; rows later than the watermark are dropped by Spark."""
    points = points.withColumn(time, F.col(time).cast("timestamp"))
    return points.withWatermark(time, late).groupBy(F.window(time, window), "zone").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "zone", "n")
