"""Distances on the sphere and map projections, as closed-form columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Radii, ellipsoid, and the transverse Mercator zones by name.
EARTH_MEAN_RADIUS = 6371008.8
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


@dataclass(frozen=True)
class Zone:
    lon0: float
    k0: float
    false_easting: float
    false_northing: float = 0.0
    lat0: float = 0.0


ZONES = {"crtm05": Zone(-84.0, 0.9999, 500000.0), "utm16n": Zone(-87.0, 0.9996, 500000.0), "utm17n": Zone(-81.0, 0.9996, 500000.0)}
NAMES = {
    "wgs84": ("wgs84", "geographic", "geo", "epsg:4326", "4326"),
    "crtm05": ("crtm05", "epsg:5367", "5367", "epsg:8908", "8908"),
    "utm16n": ("utm16n", "utm16", "epsg:32616", "32616"),
    "utm17n": ("utm17n", "utm17", "epsg:32617", "32617"),
    "webmercator": ("webmercator", "web_mercator", "mercator", "pseudomercator", "epsg:3857", "3857"),
}


def system(name: str) -> str:
    """The system that a name or code stands for."""
    for key, names in NAMES.items():
        if name.strip().lower() in names:
            return key
    raise ValueError(f"unknown coordinate system {name!r}")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MEAN_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


_E2 = WGS84_F * (2 - WGS84_F)
_EP2 = _E2 / (1 - _E2)
# The meridian arc's series in the squared eccentricity: coefficients of phi, sin 2 phi, sin 4 phi and sin 6 phi.
_ARC = (
    1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256,
    3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024,
    15 * _E2**2 / 256 + 45 * _E2**3 / 1024,
    35 * _E2**3 / 3072,
)


def _arc(phi: Column) -> Column:
    return WGS84_A * (_ARC[0] * phi - _ARC[1] * F.sin(2 * phi) + _ARC[2] * F.sin(4 * phi) - _ARC[3] * F.sin(6 * phi))


def to_zone(lon: Column, lat: Column, z: Zone) -> tuple[Column, Column]:
    """Easting and northing, by Snyder's series."""
    phi = F.radians(lat)
    t, c = F.pow(F.tan(phi), 2), _EP2 * F.pow(F.cos(phi), 2)
    n = WGS84_A / F.sqrt(1 - _E2 * F.pow(F.sin(phi), 2))
    a = (F.radians(lon) - math.radians(z.lon0)) * F.cos(phi)
    east = a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * _EP2) * F.pow(a, 5) / 120
    up = F.pow(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * _EP2) * F.pow(a, 6) / 720
    north = _arc(phi) - _arc(F.lit(math.radians(z.lat0))) + n * F.tan(phi) * up
    return z.k0 * n * east + z.false_easting, z.k0 * north + z.false_northing


def from_zone(x: Column, y: Column, z: Zone) -> tuple[Column, Column]:
    """Longitude and latitude."""
    mu = (_arc(F.lit(math.radians(z.lat0))) + (y - z.false_northing) / z.k0) / (WGS84_A * _ARC[0])
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    terms = (3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512)
    foot = mu
    for k, v in enumerate(terms, 1):
        foot = foot + v * F.sin(2 * k * mu)
    t, c = F.pow(F.tan(foot), 2), _EP2 * F.pow(F.cos(foot), 2)
    w = 1 - _E2 * F.pow(F.sin(foot), 2)
    n, r = WGS84_A / F.sqrt(w), WGS84_A * (1 - _E2) / F.pow(w, 1.5)
    d = (x - z.false_easting) / (n * z.k0)
    drop = F.pow(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * _EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * _EP2 - 3 * c * c) * F.pow(d, 6) / 720
    turn = d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * _EP2 + 24 * t * t) * F.pow(d, 5) / 120
    return F.degrees(math.radians(z.lon0) + turn / F.cos(foot)), F.degrees(foot - n * F.tan(foot) / r * drop)


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """H03."""
    return WGS84_A * F.radians(lon), WGS84_A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / WGS84_A), F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Between any two systems, by way of longitude and latitude."""
    a, b = system(source), system(target)
    if a == b:
        return x, y
    lon, lat = (x, y) if a == "wgs84" else from_web_mercator(x, y) if a == "webmercator" else from_zone(x, y, ZONES[a])
    return (lon, lat) if b == "wgs84" else to_web_mercator(lon, lat) if b == "webmercator" else to_zone(lon, lat, ZONES[b])


def reproject(df: DataFrame, source: str, target: str, geom: str = "geom") -> DataFrame:
    """Every vertex."""
    def move(v: Column) -> Column:
        x, y = transform(v["x"], v["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    g = F.col(geom)
    return df.withColumn(geom, F.struct(g["kind"].alias("kind"), F.transform(g["parts"], lambda p: F.transform(p, move)).alias("parts")))


# Codes and words of systems in degrees.
GEOGRAPHIC_CODES = (4326, 4269, 4258, 4283, 4617, 4674, 4019, 4322, 4167, 4230, 4267, 4979)
GEOGRAPHIC_WORDS = ("wgs84", "wgs 84", "wgs_84", "longlat", "lonlat", "latlon", "geographic", "degree")


def is_geographic(crs: Column) -> Column:
    """Whether a reference system is in degrees, by its EPSG code if it has one, else by its words; null and empty
    are not."""
    name = F.lower(F.trim(F.coalesce(crs, F.lit(""))))
    code = F.regexp_extract(name, r"epsg:\s*(\d+)", 1)
    by_word = F.lit(False)
    for word in GEOGRAPHIC_WORDS:
        by_word = by_word | name.contains(word)
    return F.when(name.contains("epsg:"), code.isin(*map(str, GEOGRAPHIC_CODES))).otherwise(by_word)


def georeference(points: DataFrame) -> DataFrame:
    """The least-squares line of each axis through control points (px, py, gx, gy) and its root mean square error, in
    one row. Two points at least must differ in each axis; else the result is an error."""
    fit = points.agg(
        F.count("*").alias("n"), *[f.alias(f"{k}_{axis}") for axis in "xy" for k, f in (("slope", F.regr_slope(f"g{axis}", f"p{axis}")), ("intercept", F.regr_intercept(f"g{axis}", f"p{axis}")), ("syy", F.regr_syy(f"g{axis}", f"p{axis}")), ("sxy", F.regr_sxy(f"g{axis}", f"p{axis}")))]
    )
    rms = lambda axis: F.sqrt(F.greatest(F.col(f"syy_{axis}") - F.col(f"slope_{axis}") * F.col(f"sxy_{axis}"), F.lit(0.0)) / F.col("n"))
    usable = (F.col("n") >= 2) & F.col("slope_x").isNotNull() & F.col("slope_y").isNotNull() & (F.abs("slope_x") >= 1e-12) & (F.abs("slope_y") >= 1e-12)
    return fit.select(
        F.when(usable, F.col("slope_x")).otherwise(F.raise_error(F.lit("control points do not determine both axes")).cast("double")).alias("slope_x"),
        "intercept_x", "slope_y", "intercept_y", rms("x").alias("rms_x"), rms("y").alias("rms_y"), "n",
    )
