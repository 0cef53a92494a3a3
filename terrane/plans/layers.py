"""Layers over the driver's tables, by formulas with whole results, so that any engine gives the same geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.raster import Header, Raster


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customers(spark, sf) -> DataFrame:
    t = table(spark, sf, "customer")
    x, y = F.col("c_custkey") * 37 % 100, F.col("c_custkey") * 91 % 100
    return t.select(F.col("c_custkey").alias("fid"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"), x.alias("x"), y.alias("y"), G.point(x, y).alias("geom"))


def facilities(spark, sf) -> DataFrame:
    t = table(spark, sf, "supplier")
    x, y = F.col("s_suppkey") * 53 % 100, F.col("s_suppkey") * 17 % 100
    return t.select(F.col("s_suppkey").alias("fid"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), G.point(x, y).alias("geom"))


def zones(spark, sf, width: int = 20) -> DataFrame:
    """Squares in a 5 x 5 pattern with a pitch of 20; wider ones overlap."""
    t = table(spark, sf, "nation")
    x, y = F.col("n_nationkey") % 5 * 20, F.floor(F.col("n_nationkey") / 5) * 20
    return t.select(F.col("n_nationkey").cast("long").alias("fid"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), G.box(x, y, x + width, y + width).alias("geom"))


def raster(spark, sf, value: str = "p_size") -> Raster:
    """Parts as cells, 50 a row; sizes divisible by 17 are no data."""
    t = table(spark, sf, "part")
    rows = (t.agg(F.max("p_partkey")).first()[0] // 50) + 1
    v = F.when(F.col("p_size") % 17 != 0, F.col(value).cast("double"))
    return Raster(Header(50, int(rows)), t.select(F.floor(F.col("p_partkey") / 50).cast("int").alias("r"), (F.col("p_partkey") % 50).cast("int").alias("c"), v.alias("v")))


def samples(spark, sf) -> DataFrame:
    t = table(spark, sf, "supplier")
    return t.select(F.col("s_suppkey").alias("fid"), (F.col("s_suppkey") * 53 % 100).cast("double").alias("x"), (F.col("s_suppkey") * 17 % 100).cast("double").alias("y"), (F.col("s_suppkey") % 50).cast("double").alias("z"))


def plots(spark, sf) -> DataFrame:
    """A box of its own size for each nation."""
    t = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    x, y = k % 5 * 20, F.floor(k / 5) * 20
    return t.select(k.cast("long").alias("fid"), F.col("n_name").alias("name"), G.box(x, y, x + 1 + k % 7, y + 2 + k % 4).alias("geom"))


# The same layers for SQL.
CUSTOMERS = "pts AS (SELECT c_custkey AS fid, c_mktsegment AS segment, c_acctbal AS acctbal, (c_custkey * 37) % 100 AS x, (c_custkey * 91) % 100 AS y FROM customer)"
FACILITIES = "fac AS (SELECT s_suppkey AS fid, s_name AS name, s_nationkey AS nation, (s_suppkey * 53) % 100 AS x, (s_suppkey * 17) % 100 AS y FROM supplier)"
ZONES = "zones AS (SELECT n_nationkey AS fid, n_name AS name, n_regionkey AS region, 20 * (n_nationkey % 5) AS x0, 20 * (n_nationkey // 5) AS y0 FROM nation)"
RASTER = "ras AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CASE WHEN p_size % 17 <> 0 THEN CAST(p_size AS DOUBLE) END AS v, CASE WHEN p_size % 17 <> 0 THEN p_retailprice END AS w, max(p_partkey) OVER () // 50 + 1 AS nrows FROM part)"
CELLS = RASTER + ", cells AS (SELECT *, c + 0.5 AS x, nrows - 1 - r + 0.5 AS y FROM ras)"
SAMPLES = "smp AS (SELECT s_suppkey AS fid, CAST((s_suppkey * 53) % 100 AS DOUBLE) AS x, CAST((s_suppkey * 17) % 100 AS DOUBLE) AS y, CAST(s_suppkey % 50 AS DOUBLE) AS z FROM supplier)"
PLOTS = "plots AS (SELECT CAST(n_nationkey AS BIGINT) AS fid, 20 * (n_nationkey % 5) AS x0, 20 * (n_nationkey // 5) AS y0, 1 + n_nationkey % 7 AS w, 2 + n_nationkey % 4 AS h FROM nation)"
