"""Raster operators over cell tables (r, c, v): one row per cell, row 0 at the top, null for no data. All of them are
joins on cell numbers, windows over blocks of rows, or aggregations; none gathers a grid in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.condition import parse_condition
from ..functions.expression import compile_expression, names_in
from .vector import SMALL


@dataclass(frozen=True)
class Header:
    ncols: int
    nrows: int
    xll: float = 0.0
    yll: float = 0.0
    cellsize: float = 1.0
    nodata: float = -9999.0

    def x(self, c: Column) -> Column:
        return F.lit(self.xll) + (c + 0.5) * self.cellsize

    def y(self, r: Column) -> Column:
        return F.lit(self.yll) + (self.nrows - 1 - r + 0.5) * self.cellsize

    @property
    def xmax(self) -> float:
        return self.xll + self.ncols * self.cellsize

    @property
    def ymax(self) -> float:
        return self.yll + self.nrows * self.cellsize


@dataclass(frozen=True)
class Raster:
    header: Header
    df: DataFrame

    def cells(self) -> DataFrame:
        """Cells with their centres."""
        return self.df.select("r", "c", "v", self.header.x(F.col("c")).alias("x"), self.header.y(F.col("r")).alias("y"))

    def map(self, value: Column) -> "Raster":
        return Raster(self.header, self.df.select("r", "c", value.alias("v")))


def clean(value: Column, nodata: float | None = None) -> Column:
    """Null where a value is NaN, infinite or the no-data mark."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~(bad if nodata is None else bad | (F.abs(value - nodata) < 1e-9)), value)


def grid(spark, header: Header) -> DataFrame:
    """All (r, c) of a header, made where they are used."""
    n = header.nrows * header.ncols
    return spark.range(n).select(F.floor(F.col("id") / header.ncols).cast("int").alias("r"), (F.col("id") % header.ncols).cast("int").alias("c"))


# Per cell


def filter_raster(raster: Raster, condition: str) -> Raster:
    """cells that fail become no data; any name means the cell's value."""
    test = F.lit(True)
    for _, op, value in parse_condition(condition):
        v = float(value)
        near = F.abs(F.col("v") - v) < 1e-9
        test = test & {"=": near, "!=": ~near, ">": F.col("v") > v, "<": F.col("v") < v, ">=": F.col("v") >= v, "<=": F.col("v") <= v}[op]
    return raster.map(F.when(test, F.col("v")))


def calc(rasters: Sequence[Raster], expression: str, stems: Sequence[str] = ()) -> Raster:
    """map algebra over rasters of equal dimensions; `value`, `raster` and `raster1` are the first one, `rasterN` the
    others, or their stems. A cell with no data in any input has none; NaN and infinity are no data."""
    first = rasters[0].header
    if any((x.header.ncols, x.header.nrows) != (first.ncols, first.nrows) for x in rasters):
        raise ValueError("rasters differ in dimensions")
    names = {"value": 0, "raster": 0, **{f"raster{i + 1}": i for i in range(len(rasters))}, **{s: i for i, s in enumerate(stems)}}
    unknown = [n for n in names_in(expression) if n not in names]
    if unknown:
        raise KeyError(unknown[0])
    df = rasters[0].df.select("r", "c", F.col("v").cast("double").alias("v0"))
    for i, x in enumerate(rasters[1:], 1):
        df = df.join(x.df.select("r", "c", F.col("v").cast("double").alias(f"v{i}")), ["r", "c"])
    all_ = F.lit(True)
    for i in range(len(rasters)):
        all_ = all_ & F.col(f"v{i}").isNotNull()
    value = compile_expression(expression, lambda n: F.col(f"v{names[n]}"))
    return Raster(first, df.select("r", "c", F.when(all_, clean(value)).alias("v")))


def reclass(raster: Raster, rules: Sequence[tuple[float, float, float]]) -> Raster:
    """(from, to, new) with both ends inside, or (value, value, new) within 1e-9; the first rule that fits wins."""
    out = None
    for lo, hi, new in rules:
        test = F.abs(F.col("v") - lo) < 1e-9 if lo == hi else F.col("v").between(lo, hi)
        out = F.when(test, float(new)) if out is None else out.when(test, float(new))
    return raster.map(out if out is not None else F.lit(None).cast("double"))


def reclass_by_table(raster: Raster, rules: DataFrame) -> Raster:
    """F07 for long tables (ord, lo, hi, new): a range join reduced to the first rule of each cell."""
    rules = rules.select(F.col("ord"), F.col("lo"), F.col("hi"), F.col("new"))
    value = raster.df.select(F.col("v")).where("v is not null").distinct()
    fits = value.join(rules, (F.col("v") >= F.col("lo") - F.when(F.col("lo") == F.col("hi"), 1e-9).otherwise(0.0)) & (F.col("v") <= F.col("hi") + F.when(F.col("lo") == F.col("hi"), 1e-9).otherwise(0.0)))
    new = fits.groupBy("v").agg(F.min_by("new", "ord").alias("new"))
    return Raster(raster.header, raster.df.join(new, "v", "left").select("r", "c", F.col("new").alias("v")))


# Statistics


def ranked(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Values with `first` and `last` rank from 0 and `n` in each group, by counts per distinct value: the ranks of a
    value are known from the counts below it, so a group of any size is ordered over its distinct values only. Without
    groups the distinct values are ordered in ranges between approximate percentiles, as many as the session has shuffle
    partitions, and each range starts at the total of those below it; where the bounds lie changes no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    if by:
        w = Window.partitionBy(*by)
        upto = F.sum("k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumns({"last": upto - 1, "first": upto - F.col("k"), "n": F.sum("k").over(w)})
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("__bounds"))
    dealt = counts.crossJoin(F.broadcast(bounds)).withColumn("__part", F.size(F.filter("__bounds", lambda b: b < F.col(value)))).drop("__bounds")
    few = Window.orderBy("__part")  # one row a range
    totals = dealt.groupBy("__part").agg(F.sum("k").alias("__k"))
    totals = totals.select("__part", (F.sum("__k").over(few) - F.col("__k")).alias("__below"), F.sum("__k").over(Window.partitionBy()).alias("n"))
    upto = F.col("__below") + F.sum("k").over(Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(totals), "__part").withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("k") + 1).select(value, "k", "last", "first", "n")


def statistics(df: DataFrame, value: str, by: Sequence[str] = (), nodata: float | None = None) -> DataFrame:
    """Count, nodata_count, total_count, min, max, mean, population std, sum, and the elements at n/2, n/4 and 3n/4
    of the sorted values. For attributes nodata is 0, so zeros count as no data."""
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.lit(True) if nodata is None else F.abs(v - nodata) >= 1e-9)
    df = df.withColumn("__v", F.when(ok, v))
    x = F.col("__v")
    total = df.groupBy(*by).agg(
        F.count(x).alias("count"), (F.count("*") - F.count(x)).alias("nodata_count"), F.count("*").alias("total_count"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sum(x).alias("sum"),
    )
    r = ranked(df, "__v", by)
    at = lambda k: F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), x))
    n = F.col("n")
    parts = r.groupBy(*by).agg(at(F.floor(n / 2)).alias("median"), at(F.floor(n / 4)).alias("p25"), at(F.floor(3 * n / 4)).alias("p75"))
    return total.join(parts, list(by), "left") if by else total.crossJoin(parts)


def statistics_by_zone(raster: "Raster", zones: DataFrame, zone: str = "fid") -> DataFrame:
    """Statistics of the cells of each zone; what `zonal` (A03) gives, not the whole raster's for every zone."""
    return zonal(raster, zones, zone)


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, "Observation"]:
    """Run counters. The rows pass by unchanged; once they have been used, `.get` of the observation has `rows` and
    how many of them satisfy each condition, without a pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal bins over the range; the maximum falls in the last; empty bins stay."""
    spark = df.sparkSession
    values = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    edge = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if edge["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_low double, bin_high double, count long")
    lo, hi = edge["lo"], edge["hi"]
    if hi - lo < 1e-12:
        bins, hi = 1, lo + 1
    width = (hi - lo) / bins
    counts = values.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), ((F.col("v") - lo) / width).cast("int"))).alias("bin")).agg(F.count("*").alias("k"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_high"), F.coalesce("k", F.lit(0)).alias("count"))


def cells_in_zones(raster: Raster, zones: DataFrame, zone: str = "fid") -> DataFrame:
    """(zone, r, c, v) for every cell whose centre lies in the zone's rings. Zones and cells meet in square blocks of
    cells, so neither side is compared with all of the other; rows with under three vertices are skipped."""
    h = raster.header
    block = max(1, int(math.sqrt(h.ncols * h.nrows) / 32))
    g = F.col("geom")
    b = G.bounds(g)
    col = lambda x: F.floor((x - h.xll) / h.cellsize)
    row = lambda y: F.floor((F.lit(h.ymax) - y) / h.cellsize)
    line = lambda lo, hi, n: F.sequence(F.floor(F.greatest(lo - 1, F.lit(0)) / block).cast("int"), F.greatest(F.floor(F.least(hi + 1, F.lit(n - 1)) / block), F.floor(F.greatest(lo - 1, F.lit(0)) / block)).cast("int"))
    area = zones.where(F.size(G.vertices(g)) >= 3).select(F.col(zone).alias("zone"), g.alias("zg"), F.explode(line(row(b["maxy"]), row(b["miny"]), h.nrows)).alias("br"), line(col(b["minx"]), col(b["maxx"]), h.ncols).alias("bcs"))
    area = area.select("zone", "zg", "br", F.explode("bcs").alias("bc"))
    cells = raster.cells().withColumns({"br": F.floor(F.col("r") / block).cast("int"), "bc": F.floor(F.col("c") / block).cast("int")})
    return cells.join(area, ["br", "bc"]).where(F.exists(F.col("zg")["parts"], lambda p: G.in_ring(F.col("x"), F.col("y"), p))).select("zone", "r", "c", "v")


def zonal(raster: Raster, zones: DataFrame, zone: str = "fid") -> DataFrame:
    """Per zone sum, mean, min, max, range, std, variance, cv, count, nodata_count, median, p25, p75, variety,
    diversity, majority, minority and sum_sq. Ties of majority and minority go to the smallest value; a zone with one
    distinct value has minority 0; a zone without cells has zeros."""
    inside = cells_in_zones(raster, zones, zone)
    base = inside.groupBy("zone").agg(
        F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"), F.var_pop("v").alias("variance"),
        F.count("v").alias("count"), (F.count("*") - F.count("v")).alias("nodata_count"), F.sum(F.col("v") * F.col("v")).alias("sum_sq"),
    )
    r = ranked(inside, "v", ["zone"])
    n = F.col("n")
    at = lambda k: F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), F.col("v")))
    kinds = r.groupBy("zone").agg(
        at(F.floor(n / 2)).alias("median"), at(F.floor(n / 4)).alias("p25"), at(F.floor(3 * n / 4)).alias("p75"), F.count("*").alias("variety"),
        F.min_by("v", F.struct(-F.col("k"), F.col("v"))).alias("majority"), F.min_by("v", F.struct(F.col("k"), F.col("v"))).alias("rarest"),
    )
    all_ = zones.where(F.size(G.vertices(F.col("geom"))) >= 3).select(F.col(zone).alias("zone")).join(base, "zone", "left").join(kinds, "zone", "left")
    some = F.col("count") > 0
    out = all_.select(
        "zone", "sum", "mean", "min", "max", (F.col("max") - F.col("min")).alias("range"), "std", "variance", F.when(F.abs("mean") > 1e-12, 100 * F.col("std") / F.abs(F.nullif(F.col("mean"), F.lit(0.0)))).otherwise(0.0).alias("cv"),
        "count", "nodata_count", "median", "p25", "p75", "variety", F.when(some, F.col("variety") / F.nullif(F.col("count"), F.lit(0))).otherwise(0.0).alias("diversity"),
        "majority", F.when(F.col("variety") > 1, F.col("rarest")).otherwise(0.0).alias("minority"), "sum_sq",
    )
    return out.fillna(0)


# Geometry of grids


def clip_box(raster: Raster, box: tuple[float, float, float, float]) -> Raster:
    """The window by truncation, last column and row included; an empty raster if the box lies outside."""
    h = raster.header
    x0, y0, x1, y1 = box
    c0, c1 = max(0, int((x0 - h.xll) / h.cellsize)), min(h.ncols - 1, int((x1 - h.xll) / h.cellsize))
    r0, r1 = max(0, int((h.ymax - y1) / h.cellsize)), min(h.nrows - 1, int((h.ymax - y0) / h.cellsize))
    if x0 >= h.xmax or x1 <= h.xll or y0 >= h.ymax or y1 <= h.yll or c1 < c0 or r1 < r0:
        return Raster(replace(h, ncols=0, nrows=0), raster.df.limit(0))
    head = replace(h, ncols=c1 - c0 + 1, nrows=r1 - r0 + 1, xll=h.xll + c0 * h.cellsize, yll=h.yll + (h.nrows - 1 - r1) * h.cellsize)
    return Raster(head, raster.df.where(F.col("c").between(c0, c1) & F.col("r").between(r0, r1)).select((F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), "v"))


def clip_polygon(raster: Raster, area: Column, box: tuple[float, float, float, float], invert: bool = False) -> Raster:
    """R05 mask: inside the polygon's box, cells whose centre is not in any ring (or, inverted, is) lose their value."""
    cut = clip_box(raster, box)
    x, y = cut.header.x(F.col("c")), cut.header.y(F.col("r"))
    hit = F.exists(area["parts"], lambda p: G.in_ring(x, y, p))
    return cut.map(F.when(~hit if invert else hit, F.col("v")))


def mosaic(rasters: Sequence[Raster], method: str = "first") -> Raster:
    """One grid over all extents; cells by first, last, min, max, average or sum in input order."""
    h = rasters[0].header
    if any(abs(x.header.cellsize - h.cellsize) > 1e-9 for x in rasters):
        raise ValueError("cell sizes differ")
    xll, yll = min(x.header.xll for x in rasters), min(x.header.yll for x in rasters)
    xmax, ymax = max(x.header.xmax for x in rasters), max(x.header.ymax for x in rasters)
    head = replace(h, xll=xll, yll=yll, ncols=math.ceil((xmax - xll) / h.cellsize - 1e-9), nrows=math.ceil((ymax - yll) / h.cellsize - 1e-9))
    every = None
    for i, x in enumerate(rasters):
        dc, dr = round((x.header.xll - xll) / h.cellsize), round((ymax - x.header.ymax) / h.cellsize)
        part = x.df.where("v is not null").select((F.col("r") + dr).cast("int").alias("r"), (F.col("c") + dc).cast("int").alias("c"), "v", F.lit(i).alias("o"))
        every = part if every is None else every.unionByName(part)
    pick = {"last": F.max_by("v", "o"), "min": F.min("v"), "max": F.max("v"), "average": F.avg("v"), "sum": F.sum("v")}.get(method, F.min_by("v", "o"))
    return Raster(head, every.groupBy("r", "c").agg(pick.alias("v")))


def resample(raster: Raster, cellsize: float, method: str = "nearest") -> Raster:
    """Nearest (with its half-cell shift), bilinear (cubic is the same; nearest at the rim or beside no data), or
    average, min and max over the covered index window, both ends included."""
    h = raster.header
    head = replace(h, cellsize=cellsize, ncols=max(1, int((h.xmax - h.xll) / cellsize)), nrows=max(1, int((h.ymax - h.yll) / cellsize)))
    cells = grid(raster.df.sparkSession, head).withColumns({"px": (head.x(F.col("c")) - h.xll) / h.cellsize, "py": (F.lit(h.ymax) - head.y(F.col("r"))) / h.cellsize})
    source = raster.df.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    clamp = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1)).cast("int")
    near = cells.withColumns({"sr": clamp(F.floor(F.col("py") + 0.5), h.nrows), "sc": clamp(F.floor(F.col("px") + 0.5), h.ncols)})
    if method == "nearest":
        return Raster(head, near.join(source, ["sr", "sc"], "left").select("r", "c", "v"))
    if method in ("bilinear", "cubic"):
        near = near.withColumns({"r0": F.floor("py").cast("int"), "c0": F.floor("px").cast("int"), "fy": F.col("py") - F.floor("py"), "fx": F.col("px") - F.floor("px")})
        corners = F.explode(F.array(*[F.struct((F.col("r0") + i).alias("sr"), (F.col("c0") + j).alias("sc"), ((F.col("fy") if i else 1 - F.col("fy")) * (F.col("fx") if j else 1 - F.col("fx"))).alias("w")) for i in (0, 1) for j in (0, 1)]))
        four = near.select("r", "c", corners.alias("k")).select("r", "c", F.col("k.sr").alias("sr"), F.col("k.sc").alias("sc"), F.col("k.w").alias("w")).join(source, ["sr", "sc"])
        smooth = four.groupBy("r", "c").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.count("v").alias("k")).where("k = 4")
        plain = near.select("r", "c", "sr", "sc").join(source, ["sr", "sc"], "left").select("r", "c", "v")
        return Raster(head, plain.join(smooth, ["r", "c"], "left").select("r", "c", F.coalesce("s", "v").alias("v")))
    ratio = cellsize / h.cellsize
    span = lambda p, n: F.sequence(clamp(F.floor(p - ratio / 2), n), clamp(F.floor(p + ratio / 2), n))
    window = cells.select("r", "c", F.explode(span(F.col("py"), h.nrows)).alias("sr"), span(F.col("px"), h.ncols).alias("scs")).select("r", "c", "sr", F.explode("scs").alias("sc"))
    pick = {"min": F.min("v"), "max": F.max("v")}.get(method, F.avg("v"))
    return Raster(head, window.join(source, ["sr", "sc"], "left").groupBy("r", "c").agg(pick.alias("v")))


def rasterize(features: DataFrame, header: Header, value: str) -> Raster:
    """Points cover cells whose centre is under half a cell away, lines likewise from a segment, polygons the
    centres inside; of several features the first in file order wins; multi-part features are left out."""
    spark = features.sparkSession
    g, half = F.col("geom"), header.cellsize / 2
    b = G.bounds(g)
    col = lambda x: F.floor((x - header.xll) / header.cellsize)
    row = lambda y: F.floor((F.lit(header.ymax) - y) / header.cellsize)
    span = lambda lo, hi, n: F.sequence(F.greatest(lo - 1, F.lit(0)).cast("int"), F.greatest(F.least(hi + 1, F.lit(n - 1)), F.greatest(lo - 1, F.lit(0))).cast("int"))
    single = features.where(g["kind"].isin("POINT", "LINESTRING", "POLYGON") & (F.size(G.vertices(g)) > 0))
    near = single.select("fid", g.alias("g"), F.col(value).try_cast("double").alias("v"), F.explode(span(row(b["maxy"]), row(b["miny"]), header.nrows)).alias("r"), span(col(b["minx"]), col(b["maxx"]), header.ncols).alias("cs"))
    near = near.select("fid", "g", "v", "r", F.explode("cs").alias("c")).where(F.col("r").between(0, header.nrows - 1) & F.col("c").between(0, header.ncols - 1))
    x, y, part = header.x(F.col("c")), header.y(F.col("r")), G.at(F.col("g")["parts"], 1)
    p = G.at(part, 1)
    hit = (
        F.when(F.col("g")["kind"] == "POINT", F.sqrt(F.pow(p["x"] - x, 2) + F.pow(p["y"] - y, 2)) < half)
        .when(F.col("g")["kind"] == "LINESTRING", G.line_distance(x, y, part) <= half)
        .otherwise(G.in_ring(x, y, part))
    )
    won = near.where(hit).groupBy("r", "c").agg(F.min_by("v", "fid").alias("v"))
    return Raster(header, grid(spark, header).join(won, ["r", "c"], "left").select("r", "c", "v"))


def points(raster: Raster) -> DataFrame:
    """R08 points: a point for each cell with data."""
    return raster.cells().where("v is not null").select((F.col("r") * raster.header.ncols + F.col("c")).cast("long").alias("fid"), "v", G.point(F.col("x"), F.col("y")).alias("geom"))


# Neighbourhoods


def neighbours(raster: Raster) -> DataFrame:
    """Each cell with its eight neighbours n, ne, e, se, s, sw, w, nw (null outside and for no data). Rows go to
    blocks with a rim of one row on either side, so windows are over blocks and columns, not over a whole raster."""
    h = raster.header
    block = 64
    b = F.floor(F.col("r") / block).cast("int")
    home = raster.df.select("r", "c", "v", F.explode(F.array_distinct(F.array(b, F.floor((F.col("r") - 1) / block).cast("int"), F.floor((F.col("r") + 1) / block).cast("int")))).alias("b"))
    vert = Window.partitionBy("b", "c").orderBy("r")
    at = lambda f, step: F.when(f("r").over(vert) == F.col("r") + step, f("v").over(vert))
    tall = home.withColumns({"n": at(F.lag, -1), "s": at(F.lead, 1)}).where(F.floor(F.col("r") / block) == F.col("b")).drop("b")
    across = Window.partitionBy("r", F.floor(F.col("c") / h.ncols)).orderBy("c")
    west = lambda k: F.when(F.lag("c").over(across) == F.col("c") - 1, F.lag(k).over(across))
    east = lambda k: F.when(F.lead("c").over(across) == F.col("c") + 1, F.lead(k).over(across))
    return tall.withColumns({"w": west("v"), "nw": west("n"), "sw": west("s"), "e": east("v"), "ne": east("n"), "se": east("s")})


def terrain(raster: Raster, operation: str, z_factor: float = 1.0, units: str = "degrees", flat_value: float = -1.0, azimuth: float = 315.0, altitude: float = 45.0, kind: str = "general") -> Raster:
    """Slope, aspect and hillshade by Horn's weights, curvature by Zevenbergen and Thorne (times 100). A missing
    neighbour takes the centre's value."""
    cs = raster.header.cellsize
    k = {n: F.coalesce(F.col(n), F.col("v")) * z_factor for n in ("n", "ne", "e", "se", "s", "sw", "w", "nw")}
    z = F.col("v") * z_factor
    dx = ((k["ne"] + 2 * k["e"] + k["se"]) - (k["nw"] + 2 * k["w"] + k["sw"])) / (8 * cs)
    dy = ((k["sw"] + 2 * k["s"] + k["se"]) - (k["nw"] + 2 * k["n"] + k["ne"])) / (8 * cs)
    steep = F.sqrt(dx * dx + dy * dy)
    if operation == "slope":
        value = 100 * steep if units == "percent" else F.degrees(F.atan(steep))
    elif operation == "aspect":
        turn = F.degrees(F.atan2(dy, -dx))
        compass = F.when(turn < 0, 90 - turn).when(turn > 90, 450 - turn).otherwise(90 - turn)
        value = F.when((F.abs(dx) < 1e-12) & (F.abs(dy) < 1e-12), flat_value).otherwise(compass)
    elif operation == "hillshade":
        zenith, sun = math.radians(90 - altitude), math.radians((360 - azimuth + 90) % 360)
        slope = F.atan(steep)
        look = F.when(steep > 0, F.atan2(dy, -dx)).otherwise(0.0)
        value = F.greatest(F.lit(0.0), 255 * (math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(F.lit(sun) - look)))
    elif operation == "curvature":
        d = ((k["w"] + k["e"]) / 2 - z) / (cs * cs)
        e = ((k["n"] + k["s"]) / 2 - z) / (cs * cs)
        f = (-k["nw"] + k["ne"] + k["sw"] - k["se"]) / (4 * cs * cs)
        g, h = (-k["w"] + k["e"]) / (2 * cs), (k["n"] - k["s"]) / (2 * cs)
        flat = g * g + h * h
        safe = F.when(flat < 1e-12, 1.0).otherwise(flat)
        profile = F.when(flat < 1e-12, 0.0).otherwise(-2 * (d * g * g + e * h * h + f * g * h) / safe)
        plan = F.when(flat < 1e-12, 0.0).otherwise(2 * (d * h * h + e * g * g - f * g * h) / safe)
        value = {"profile": profile, "planform": plan}.get(kind, -2 * (d + e)) * 100
    else:
        raise ValueError(operation)
    return Raster(raster.header, neighbours(raster).select("r", "c", F.when(F.col("v").isNotNull(), value).alias("v")))


#: D8 codes in the order in which equal drops are decided: name, code, distance in cells.
D8 = (("e", 1, 1.0), ("se", 2, math.sqrt(2)), ("s", 4, 1.0), ("sw", 8, math.sqrt(2)), ("w", 16, 1.0), ("nw", 32, math.sqrt(2)), ("n", 64, 1.0), ("ne", 128, math.sqrt(2)))


def steepest(raster: Raster) -> Raster:
    """R12 without flats: the code of the steepest falling neighbour, the first of equals; 0 where none falls."""
    best, code = F.lit(0.0), F.lit(0)
    for n, number, far in D8:
        drop = F.coalesce((F.col("v") - F.col(n)) / (far * raster.header.cellsize), F.lit(-1.0))
        code = F.when(drop > best, number).otherwise(code)
        best = F.greatest(best, drop)
    return Raster(raster.header, neighbours(raster).select("r", "c", F.when(F.col("v").isNotNull(), code.cast("double")).alias("v")))


def corridor(a: Raster, b: Raster, threshold: float | None = None) -> Raster:
    """The sum of two cost surfaces where it is at most the threshold (1.1 times the least sum)."""
    total = a.df.join(b.df.select("r", "c", F.col("v").alias("w")), ["r", "c"]).select("r", "c", (F.col("v") + F.col("w")).alias("v"))
    limit = threshold if threshold is not None else (total.agg(F.min("v")).first()[0] or 0.0) * 1.1
    return Raster(a.header, total.select("r", "c", F.when(F.col("v") <= limit + 1e-9, F.col("v")).alias("v")))


# Interpolation


def interpolate(samples: DataFrame, header: Header, method: str = "idw", power: float = 2.0, neighbors: int = 8) -> Raster:
    """R09 for samples (fid, x, y, z): nearest, idw over all samples, idw_neighbors over the k nearest; natural and
    kriging are inverse distance with k = 10, power 1 and k = 8, power 1.5. A sample at the very place gives its value."""
    if method == "natural":
        method, neighbors, power = "idw_neighbors", 10, 1.0
    if method == "kriging":
        method, neighbors, power = "idw_neighbors", 8, 1.5
    cells = grid(samples.sparkSession, header).withColumns({"px": header.x(F.col("c")), "py": header.y(F.col("r"))})
    return Raster(header, predict(cells, ["r", "c"], samples, method, power, neighbors))


def predict(places: DataFrame, key: Sequence[str], samples: DataFrame, method: str, power: float, neighbors: int, but_self: str | None = None) -> DataFrame:
    """Values at places (key, px, py) from samples; `but_self` names the key that holds the id of a sample to leave out.
    Plain idw weighs every place of samples, as its definition asks, in partial sums: samples in one place weigh as one
    with their sum. The other methods look for the k nearest in grid cells. Samples that lack a coordinate or a
    value are left out."""
    named = samples.where("x is not null and y is not null and z is not null").select(F.col("fid").alias("sid"), "x", "y", "z")
    if method == "idw":
        return _weighed(places, key, named, power, but_self)
    k = 1 if method == "nearest" else neighbors
    near = _k_nearest(places, key, named, k, but_self)
    d = F.col("d")
    if method == "nearest":
        return near.groupBy(*key).agg(F.min_by("z", F.struct("d", "sid")).alias("v"))
    weight = 1 / F.pow(F.when(d < 1e-12, 1.0).otherwise(d), power)
    total = near.groupBy(*key).agg(F.min_by(F.when(d < 1e-12, F.col("z")), F.struct("d", "sid")).alias("hit"), F.sum(weight * F.col("z")).alias("a"), F.sum(weight).alias("b"))
    return total.select(*key, _mean())


def _mean() -> Column:
    return F.coalesce("hit", F.when(F.col("b") >= 1e-12, F.col("a") / F.nullif(F.col("b"), F.lit(0.0)))).alias("v")


def _distance() -> Column:
    return F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))


def _weighed(places: DataFrame, key: Sequence[str], samples: DataFrame, power: float, but_self: str | None) -> DataFrame:
    """Inverse distances to all samples. A place's first two samples are kept, so that one can be left out."""
    two = F.row_number().over(Window.partitionBy("x", "y").orderBy("sid"))
    first = samples.withColumn("i", two).where(F.col("i") <= 2).groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("sid", "z"))).alias("first"))
    stacked = samples.groupBy("x", "y").agg(F.sum("z").alias("z"), F.count("*").alias("n")).join(first, ["x", "y"])
    pairs = places.crossJoin(stacked).withColumn("d", _distance())
    d, at = F.col("d"), F.col("d") < 1e-12
    other = F.filter("first", lambda s: s["sid"] != F.col(but_self)) if but_self else F.col("first")
    pairs = pairs.withColumn("here", F.when(at, F.try_element_at(other, F.lit(1))))
    weight = F.when(~at, 1 / F.pow(d, power))
    total = pairs.groupBy(*key).agg(
        F.min_by("here.z", F.when(F.col("here").isNotNull(), F.struct("d", "here.sid"))).alias("hit"), F.sum(weight * F.col("z")).alias("a"), F.sum(weight * F.col("n")).alias("b")
    )
    return total.select(*key, _mean())


def _k_nearest(places: DataFrame, key: Sequence[str], samples: DataFrame, k: int, but_self: str | None) -> DataFrame:
    """(key, sid, z, d) of the k samples nearest to each place, ties to the lowest id. Samples lie in grid cells as wide
    as the reach; a place that finds k within reach is settled, the others look again with twice the reach. Of samples in
    one place only as many as can matter go on."""
    stacked = F.row_number().over(Window.partitionBy("x", "y").orderBy("sid"))
    samples = samples.withColumn("__i", stacked).where(F.col("__i") <= k + bool(but_self)).drop("__i").persist()
    other = F.col(but_self) != F.col("sid") if but_self else F.lit(True)
    best = Window.partitionBy(*key).orderBy("d", "sid")

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= k).select(*key, "sid", "z", "d")

    span = lambda df, x, y: df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n")).first()
    b = span(samples, "x", "y")
    if b["n"] <= SMALL:
        return least(places.join(F.broadcast(samples), other).withColumn("d", _distance()))
    p = span(places, "px", "py")
    if p["x0"] is None:
        return least(places.join(samples, F.lit(False)).withColumn("d", _distance()))
    side = max(b["x1"] - b["x0"], b["y1"] - b["y0"], 1e-9)
    whole = max(max(b["x1"], p["x1"]) - min(b["x0"], p["x0"]), max(b["y1"], p["y1"]) - min(b["y0"], p["y0"]), 1e-9)
    reach = max(side * (k / b["n"]) ** 0.5, 1e-9)
    wanted = min(k, b["n"] - bool(but_self))
    left, settled = places.select(*key, "px", "py"), None
    while True:
        cell = lambda v: F.floor(v / F.lit(reach))
        line = lambda v: F.explode(F.sequence(cell(F.col(v) - reach), cell(F.col(v) + reach)))
        wide = left.withColumn("cx", line("px")).withColumn("cy", line("py"))
        pairs = wide.join(samples.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))}), ["cx", "cy"]).where(other).withColumn("d", _distance())
        if reach > 2 * whole:
            got = least(pairs)
            return got if settled is None else settled.unionByName(got)
        got = least(pairs.where(F.col("d") <= 0.999 * reach)).persist()  # a cell's edge may be a rounding off
        done = got.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") >= wanted).select(*key)
        full = got.join(done, list(key), "left_semi")
        settled = full if settled is None else settled.unionByName(full)
        left = left.join(done, list(key), "left_anti").persist()
        if left.isEmpty():
            return settled
        reach *= 2


def cross_validate(samples: DataFrame, method: str = "idw", power: float = 2.0, neighbors: int = 8) -> DataFrame:
    """Mean absolute and root mean square error of leaving each sample out."""
    places = samples.select(F.col("fid").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("truth"))
    got = predict(places.drop("truth"), ["pid"], samples, method, power, neighbors, "pid").join(places.select("pid", "truth"), "pid")
    e = F.col("v") - F.col("truth")
    return got.where(F.col("v").isNotNull() & ~F.isnan("v")).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


# Class breaks


def breaks(df: DataFrame, value: str, method: str, classes: int = 5, interval: float | None = None, manual: Sequence[float] = ()) -> list[tuple[float, float]]:
    """(low, high) of each class. Only counts per distinct value or moments leave the cluster, through windows and
    aggregations; natural breaks iterate over the distinct values' counts."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    m = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")).first()
    if not m["n"]:
        return []
    lo, hi, n = m["lo"], m["hi"], m["n"]
    span = lambda edges: list(zip(edges[:-1], edges[1:]))
    equal = span([lo + (hi - lo) * i / classes for i in range(classes)] + [hi])
    if method == "quantile":
        size = max(1, n // classes)
        want = sorted({min(n - 1, i * size) for i in range(classes)} | {min(n - 1, (i + 1) * size - 1) for i in range(classes)})
        r = ranked(v, "v")
        hit = F.explode(F.filter(F.array(*[F.lit(k) for k in want]), lambda k: k.between(F.col("first"), F.col("last"))))
        at = {x["k"]: x["v"] for x in r.select("v", hit.alias("k")).collect()}  # two ranks a class
        return [(at[min(n - 1, i * size)], at[min(n - 1, (i + 1) * size - 1)]) for i in range(classes)]
    if method == "standard_deviation" and (m["sd"] or 0.0) >= 1e-12:
        steps = [m["mean"] + (i - classes / 2) * m["sd"] for i in range(classes + 1)]
        return span([lo, *[s for s in steps if lo < s < hi], hi])
    if method == "geometric_interval":
        shift = 1 - lo if lo <= 0 else 0.0
        ratio = ((hi + shift) / (lo + shift)) ** (1 / classes)
        return span([(lo + shift) * ratio**i - shift for i in range(classes)] + [hi])
    if method == "defined_interval" and interval:
        first = math.floor(lo / interval) * interval
        return span([first + i * interval for i in range(math.ceil((hi - first) / interval) + 1)])
    if method == "pretty_breaks":
        step = nice((hi - lo) / classes, True)
        first = math.floor(lo / step) * step
        return span([first + i * step for i in range(min(500, math.ceil((hi - first) / step)) + 1)])
    if method == "manual":
        return span([lo, *sorted(manual), hi])
    if method == "natural_breaks" and classes < n:
        return _natural(v, classes, breaks(df, value, "quantile", classes))
    if method == "single":
        return [(lo, hi)]
    return equal if method != "natural_breaks" else breaks(df, value, "quantile", classes)


def nice(x: float, round_: bool) -> float:
    """The nearest of 1, 2, 5 and 10 times a power of ten (or the next above)."""
    if x <= 0:
        return 1.0
    power = 10 ** math.floor(math.log10(x))
    f = x / power
    pick = (1 if f < 1.5 else 2 if f < 3 else 5 if f < 7 else 10) if round_ else (1 if f <= 1 else 2 if f <= 2 else 5 if f <= 5 else 10)
    return pick * power


def _natural(values: DataFrame, classes: int, start: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """One-dimensional k-means, at most 100 rounds; each is one aggregation over counts of distinct values."""
    counts = values.groupBy("v").agg(F.count("*").alias("k")).persist()
    centres = sorted({(a + b) / 2 for a, b in start})
    for _ in range(100):
        nearest = F.expr("0")
        for i in range(1, len(centres)):
            nearest = F.when(F.col("v") > (centres[i - 1] + centres[i]) / 2, i).otherwise(nearest)
        got = {x["g"]: x for x in counts.groupBy(nearest.alias("g")).agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        now = [got[g]["m"] for g in sorted(got)]
        if len(now) == len(centres) and max(abs(a - b) for a, b in zip(now, centres)) < 1e-12:
            break
        centres = now
    counts.unpersist()
    return [(got[g]["lo"], got[g]["hi"]) for g in sorted(got)]


def classify(df: DataFrame, value: str, classes: Sequence[tuple[float, float]]) -> DataFrame:
    """The class number from 0 of each value: the first class whose upper end is not below it."""
    v = F.col(value).cast("double")
    out = None
    for i, (_, hi) in enumerate(classes):
        out = F.when(v <= hi, i) if out is None else out.when(v <= hi, i)
    return df.withColumn("class", out.otherwise(len(classes) - 1) if out is not None else F.lit(None).cast("int"))


def raster_info(raster: Raster) -> DataFrame:
    """S17 for rasters: dimensions, min, max, mean, sum, valid and no-data counts."""
    h = raster.header
    return raster.df.agg(F.lit(h.ncols).alias("ncols"), F.lit(h.nrows).alias("nrows"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.sum("v").alias("sum"), F.count("v").alias("valid"), (F.count("*") - F.count("v")).alias("nodata"))


def join_rat(raster: Raster, rat: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Cells with the attribute row of their value, matched by the value rounded to the tolerance on both
    sides of a boundary, then within the tolerance."""
    step = lambda v: F.round(v / tolerance).cast("long")
    near = rat.select(F.explode(F.array(*[(step(F.col("value")) + i) for i in (-1, 0, 1)])).alias("k"), F.struct(*rat.columns).alias("rat"))
    cells = raster.df.withColumn("k", step(F.col("v")))
    hit = (cells["k"] == near["k"]) & (F.abs(F.col("v") - F.col("rat.value")) < tolerance)
    return cells.join(near, hit, "left").select("r", "c", "v", "rat.*")


def palette(colours: Sequence[str], classes: int) -> list[str]:
    """The first colours, or linear interpolation where there are more classes than colours."""
    if classes <= len(colours):
        return list(colours[:classes])
    rgb = [tuple(int(c[i : i + 2], 16) for i in (1, 3, 5)) for c in colours]
    out = []
    for i in range(classes):
        t = i * (len(rgb) - 1) / (classes - 1)
        k = min(int(t), len(rgb) - 2)
        out.append("#" + "".join(f"{round(a + (b - a) * (t - k)):02x}" for a, b in zip(rgb[k], rgb[k + 1])))
    return out
