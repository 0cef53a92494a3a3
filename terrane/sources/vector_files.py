"""Readers and writers of vector formats. Lines and rows are parsed by columns where the format allows, documents and
binary files in Arrow batches, one file a row; writers format by columns and leave files to Spark, except formats that are
one binary file by definition."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G

GEOMETRY_NAMES = ("geometry", "geom", "wkt")


@dataclass
class VectorLayer:
    """A layer: attributes as strings, row number fid, geometry geom."""

    df: DataFrame
    crs: str = ""
    geometry_column: str = "geometry"


def split_line(line: Column, sep: str = ",") -> Column:
    """Values of a line; separators inside quotes or parentheses don't split; doubled quotes are one."""
    # A value is a run of quoted strings, parenthesised groups up to three deep, and other characters.
    deep = r"\((?:[^()]|\((?:[^()]|\((?:[^()])*\))*\))*\)"
    value = rf'((?:"(?:[^"]|"")*"|{deep}|[^{sep}"(])*)'
    found = F.regexp_extract_all(line, F.lit(rf"(?:^|{sep}){value}"), F.lit(1))
    plain = lambda v: F.when(F.trim(v).rlike('^".*"$'), F.regexp_replace(F.regexp_replace(F.trim(v), '^"|"$', ""), '""', '"')).otherwise(F.trim(v))
    return F.transform(found, plain)


def read_spatial_csv(spark: SparkSession, path: str) -> VectorLayer:
    """`#` comments (one may name the CRS), header, rows; commas inside parentheses don't split. Rows with too few
    values are left out; unreadable geometry is null. fid is the row's place in its file."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("line"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at")).where("trim(line) <> ''")
    head = lines.where("line like '#%' or at >= 0").orderBy("at")
    crs = [r["line"] for r in lines.where(F.col("line").startswith("#") & F.col("line").contains("CRS:")).limit(1).collect()]
    first = head.where(~F.col("line").startswith("#")).select("line", split_line(F.col("line")).alias("v")).limit(1).collect()
    if not first:
        return VectorLayer(spark.createDataFrame([], f"fid long, geom {G.SCHEMA}"))
    names = first[0]["v"]
    geometry = next((n for n in names if n.lower() in GEOMETRY_NAMES), None)
    rows = lines.where(~F.col("line").startswith("#") & (F.col("line") != first[0]["line"])).withColumn("v", split_line(F.col("line"))).where(F.size("v") >= len(names))
    cols = [F.element_at("v", i + 1).alias(n) for i, n in enumerate(names) if n != geometry]
    geom = G.from_wkt(F.element_at("v", names.index(geometry) + 1)) if geometry else F.lit(None).cast(G.SCHEMA)
    return VectorLayer(rows.select(F.col("at").alias("fid"), *cols, geom.alias("geom")), crs[0].split(":", 1)[1].strip() if crs else "", geometry or "geometry")


def write_spatial_csv(layer: VectorLayer, path: str, comments: Sequence[str] = (), close: bool = False) -> None:
    """Rows in order of fid, six decimals; values that need it are quoted."""
    df = layer.df
    names = [c for c in df.columns if c not in ("fid", "geom")]
    quote = lambda c: F.when(F.coalesce(c, F.lit("")).rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = F.concat_ws(",", *[quote(F.col(n).cast("string")) for n in names], F.concat(F.lit('"'), F.coalesce(G.to_wkt(F.col("geom"), close=close), F.lit("")), F.lit('"')))
    head = [f"# CRS: {layer.crs}"] * bool(layer.crs) + [f"# {c}" for c in comments] + [f"# Geometry column: {layer.geometry_column}", ",".join([*names, layer.geometry_column])]
    top = df.sparkSession.createDataFrame([(i - len(head), t) for i, t in enumerate(head)], "k long, value string")
    top.unionByName(df.select(F.col("fid").alias("k"), line.alias("value"))).repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


_POSITION = "array<double>"


def read_geojson(spark: SparkSession, path: str, props: Sequence[str] | None = None, include_type: bool = False) -> VectorLayer:
    """A collection, a feature or a bare geometry a file; properties are the sorted union of names; the id is the
    feature's, or its number from 1."""
    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for text in pdf["value"]:
                doc = json.loads(text)
                crs = ((doc.get("crs") or {}).get("properties") or {}).get("name", "")
                features = doc.get("features") if doc.get("type") == "FeatureCollection" else [doc] if doc.get("type") == "Feature" else [{"geometry": doc, "properties": {}}]
                for i, f in enumerate(features):
                    kind, parts = _from_coordinates(f.get("geometry"))
                    values = {k: v if isinstance(v, str) else "" if v is None else json.dumps(v) for k, v in (f.get("properties") or {}).items()}
                    out.append((i, str(f.get("id", i + 1)), values, {"kind": kind, "parts": parts} if kind else None, crs))
            yield pd.DataFrame(out, columns=["fid", "id", "p", "geom", "crs"])

    rows = spark.read.text(path, wholetext=True).mapInPandas(parse, f"fid long, id string, p map<string, string>, geom {G.SCHEMA}, crs string")
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("p"))).distinct().collect()) if props is None else list(props)
    crs = rows.agg(F.max("crs")).first()[0] or ""
    kind = [F.col("geom")["kind"].alias("geometry_type")] if include_type else []
    cols = [F.coalesce(F.col("p")[n], F.lit("")).alias(n if n not in ("id", "fid", "geom") else f"{n}_") for n in names]
    return VectorLayer(rows.select("fid", "id", *cols, *kind, "geom"), crs)


def _from_coordinates(g: dict | None):
    if not g or not g.get("type"):
        return None, None
    kind, c = g["type"].upper(), g.get("coordinates") or []
    v = lambda p: {"x": float(p[0]), "y": float(p[1])}
    if kind == "POINT":
        return kind, [[v(c)]] if c else []
    if kind in ("LINESTRING",):
        return kind, [[v(p) for p in c]]
    if kind == "MULTIPOINT":
        return kind, [[v(p)] for p in c]
    if kind == "MULTILINESTRING":
        return kind, [[v(p) for p in l] for l in c]
    if kind == "POLYGON":
        return kind, [[v(p) for ring in c for p in ring]]
    if kind == "MULTIPOLYGON":
        return kind, [[v(p) for ring in poly for p in ring] for poly in c]
    return None, None


JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def features(layer: VectorLayer, props: Sequence[str] | None = None) -> DataFrame:
    """One GeoJSON feature a row, as text; values that read as JSON numbers, true, false or null are unquoted."""
    g = F.col("geom")
    pair = lambda v: F.concat(F.lit("["), F.format_string("%.6f", v["x"]), F.lit(","), F.format_string("%.6f", v["y"]), F.lit("]"))
    ring = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, pair), ","), F.lit("]"))
    wrap = lambda c, n: F.concat(F.lit("[" * n), c, F.lit("]" * n))
    each = lambda f, sep=",": F.array_join(F.transform(g["parts"], f), sep)
    coordinates = (
        F.when(g["kind"] == "POINT", F.coalesce(pair(G.at(G.vertices(g), 1)), F.lit("[]"))).when(g["kind"] == "LINESTRING", each(ring)).when(g["kind"] == "MULTIPOINT", wrap(F.array_join(F.transform(G.vertices(g), pair), ","), 1))
        .when(g["kind"].isin("POLYGON", "MULTILINESTRING"), wrap(each(ring), 1)).otherwise(wrap(each(lambda p: wrap(ring(p), 1)), 1))
    )
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[g["kind"]]
    own = [c for c in layer.df.columns if c not in ("fid", "geom") and (props is None or c in props)]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bare = lambda c: F.when(text(c).rlike(JSON_NUMBER) | text(c).isin("true", "false", "null"), text(c)).otherwise(F.to_json(F.array(text(c))).substr(F.lit(2), F.length(F.to_json(F.array(text(c)))) - 2))
    properties = F.concat_ws(",", *[F.concat(F.lit(json.dumps(c) + ":"), bare(c)) for c in own])
    body = F.concat(F.lit('{"type":"Feature","properties":{'), properties, F.lit('},"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))
    return layer.df.select("fid", body.alias("value"))


def write_geojson(layer: VectorLayer, path: str, props: Sequence[str] | None = None) -> None:
    """One collection in one file, in order of fid."""
    rows = features(layer, props)
    crs = f'"crs":{{"type":"name","properties":{{"name":{json.dumps(layer.crs)}}}}},' if layer.crs else ""
    last = rows.agg(F.max("fid")).first()[0]
    body = rows.select("fid", F.when(F.col("fid") == last, F.col("value")).otherwise(F.concat("value", F.lit(","))).alias("value"))
    ends = layer.df.sparkSession.createDataFrame([(-(2**62), f'{{"type":"FeatureCollection",{crs}"features":['), (2**62, "]}")], "fid long, value string")
    ends.unionByName(body).repartitionByRange(1, "fid").sortWithinPartitions("fid").select("value").write.mode("overwrite").text(path)


def read_xy(spark: SparkSession, path: str, x: str | None = None, y: str | None = None, sep: str | None = None) -> tuple[VectorLayer, DataFrame]:
    """A plain table with coordinates. The separator is sniffed from the header, columns are found by name, a decimal
    comma is read where the separator isn't one. Returns the layer and the rows left out, with the reason."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    line = head[0]["value"].lstrip("﻿") if head else ""
    sep = sep or max((";", "\t", ","), key=line.count)
    df = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"')
    df = df.select([F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in df.columns])
    low = {c.lower(): c for c in df.columns}
    pick = lambda given, names: given or next((low[n] for n in names if n in low), None)
    x = pick(x, ("lon", "longitude", "lng", "long", "longitud", "x", "este", "easting"))
    y = pick(y, ("lat", "latitude", "latitud", "y", "norte", "northing"))
    if not x or not y:
        raise ValueError("no coordinate columns")
    number = lambda c: (F.regexp_replace(F.trim(F.col(c)), ",", ".") if sep != "," else F.trim(F.col(c))).try_cast("double")
    degrees = x.lower().startswith(("lon", "lng")) or y.lower().startswith("lat")
    nx, ny = number(x), number(y)
    reason = F.when(nx.isNull() | ny.isNull(), "not a number")
    if degrees:
        reason = reason.when((F.abs(nx) > 180) | (F.abs(ny) > 90), F.when((F.abs(nx) <= 90) & (F.abs(ny) <= 180), "out of range: x and y may be swapped").otherwise("out of range"))
    rows = df.withColumn("fid", F.monotonically_increasing_id()).withColumn("__reason", reason)
    good = rows.where("__reason is null").select("fid", *df.columns, G.point(nx, ny).alias("geom"))
    return VectorLayer(good, "EPSG:4326" if degrees else ""), rows.where("__reason is not null").withColumnRenamed("__reason", "reason")


# OpenStreetMap XML

_TAG = "array<struct<_k: string, _v: string>>"
_OSM = {
    "node": "_id long, _lat double, _lon double, tag " + _TAG,
    "way": "_id long, nd array<struct<_ref: long>>, tag " + _TAG,
    "relation": "_id long, member array<struct<_type: string, _ref: long, _role: string>>, tag " + _TAG,
}


def read_osm(spark: SparkSession, path: str, filters: Sequence[str] = ()) -> DataFrame:
    """(osm_id, element, tags, geom). A closed way of four references or more is a polygon, another a line; missing
    nodes are skipped; a relation takes its first usable way; of elements with one id the last stays. Filters are alternatives: key, key=value, key=* or a pattern."""
    def load(kind: str) -> DataFrame:
        df = spark.read.format("xml").option("rowTag", kind).schema(_OSM[kind]).load(path)
        tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast(_TAG)), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))))
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        last = df.withColumn("tags", tags).select("*", place.alias("at")).groupBy("_id")
        return last.agg(F.max_by(F.struct(*df.columns, "tags"), "at").alias("e")).select("e.*")

    nodes, ways, relations = (load(k) for k in _OSM)
    points = nodes.where(F.size("tags") > 0).select(F.col("_id").alias("osm_id"), F.lit("node").alias("element"), "tags", G.point(F.col("_lon"), F.col("_lat")).alias("geom"))
    refs = ways.select("_id", F.posexplode("nd._ref").alias("i", "ref"))
    found = refs.join(nodes.select(F.col("_id").alias("ref"), "_lon", "_lat"), "ref").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("_lon").alias("x"), F.col("_lat").alias("y")))).alias("v"))
    line = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = (F.size("nd") >= 4) & (F.col("nd")[0]["_ref"] == F.element_at("nd", -1)["_ref"])
    shapes = ways.join(found, "_id").select("_id", "tags", F.struct(F.when(closed, "POLYGON").otherwise("LINESTRING").alias("kind"), F.array(line).alias("parts")).alias("geom"))
    lines = shapes.select(F.col("_id").alias("osm_id"), F.lit("way").alias("element"), "tags", "geom")
    member = relations.select("_id", "tags", F.posexplode("member").alias("i", "m")).where("m._type = 'way'").join(shapes.select(F.col("_id").alias("w"), "geom"), F.col("m._ref") == F.col("w"))
    rels = member.groupBy("_id").agg(F.first("tags").alias("tags"), F.min_by("geom", "i").alias("geom")).select(F.col("_id").alias("osm_id"), F.lit("relation").alias("element"), "tags", "geom")
    out = points.unionByName(lines).unionByName(rels)
    if not filters:
        return out
    test = F.lit(False)
    for f in filters:
        k, _, v = f.partition("=")
        value = F.col("tags")[k]
        test = test | (value.isNotNull() if v in ("", "*") else value.rlike(v.replace("*", ".*")) if "*" in v else value == v)
    return out.where(F.coalesce(test, F.lit(False)))


def osm_xml(layer: VectorLayer, exclude: Sequence[str] = ()) -> DataFrame:
    """Lines of OSM XML (ord, value) for points, lines and polygons: ids count down from -1, nodes before ways, a
    ring's last vertex is its first node; multi-part and out-of-range rows are left out."""
    df = layer.df.where(F.col("geom")["kind"].isin("POINT", "LINESTRING", "POLYGON"))
    v = G.vertices(F.col("geom"))
    df = df.where((F.size(v) > 0) & F.forall(v, lambda p: (F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90)))
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    names = sorted(c for c in df.columns if c not in ("fid", "geom", *exclude))
    tags = F.concat_ws("", *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f'<tag k="{c}" v="'), esc(F.col(c).cast("string")), F.lit('"/>'))) for c in names])
    ring = F.when((F.col("geom")["kind"] == "POLYGON") & (F.size(v) > 1) & (G.at(v, 1) == G.at(v, -1)), G._but_last(v)).otherwise(v)
    rows = df.select("fid", F.col("geom")["kind"].alias("kind"), tags.alias("tags"), ring.alias("v"))
    from ..operators.network import numbered

    nodes = numbered(rows.select("fid", "kind", "tags", F.posexplode("v").alias("i", "p")).withColumn("at", F.struct("fid", "i")), "at", "n")
    id_ = -(F.col("n") + 1)
    node = nodes.select(F.col("n").alias("ord"), F.concat(F.lit('<node id="'), id_.cast("string"), F.lit('" lat="'), F.format_string("%.7f", F.col("p.y")), F.lit('" lon="'), F.format_string("%.7f", F.col("p.x")), F.lit('">'), F.when(F.col("kind") == "POINT", F.col("tags")).otherwise(""), F.lit("</node>")).alias("value"))
    ways = nodes.where("kind <> 'POINT'").groupBy("fid", "kind", "tags").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    refs = F.when(F.col("kind") == "POLYGON", F.concat("ns", F.slice("ns", 1, 1))).otherwise(F.col("ns"))
    body = F.concat(F.array_join(F.transform(refs, lambda n: F.concat(F.lit('<nd ref="'), (-(n + 1)).cast("string"), F.lit('"/>'))), ""), F.col("tags"), F.when(F.col("kind") == "POLYGON", '<tag k="area" v="yes"/>').otherwise(""))
    way = ways.select((F.lit(1 << 40) + F.col("fid")).alias("ord"), F.concat(F.lit('<way id="'), (-(F.lit(1 << 40) + F.col("fid"))).cast("string"), F.lit('">'), body, F.lit("</way>")).alias("value"))
    return node.unionByName(way)


def write_osm(layer: VectorLayer, path: str, exclude: Sequence[str] = ()) -> None:
    """One document in one file, elements in order."""
    lines = osm_xml(layer, exclude)
    ends = layer.df.sparkSession.sql("SELECT * FROM VALUES (-1L, '<osm version=\"0.6\">'), (9223372036854775807L, '</osm>') AS t(ord, value)")
    lines.unionByName(ends).repartitionByRange(1, "ord").sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)


# Shapefiles

_SHAPES = {0: None, 1: "POINT", 3: "LINESTRING", 5: "POLYGON", 8: "MULTIPOINT"}


def shapes_of(data: bytes):
    """(record number, kind, parts) of an .shp file; Z and M are dropped, multi-patches are empty."""
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (code,) = struct.unpack("<i", body[:4])
        kind = _SHAPES.get(code % 10 if code < 30 else -1)
        xy = lambda raw, n: [dict(zip("xy", p)) for p in struct.iter_unpack("<dd", raw[: 16 * n])]
        if kind == "POINT":
            yield number, kind, [xy(body[4:20], 1)]
        elif kind == "MULTIPOINT":
            (n,) = struct.unpack("<i", body[36:40])
            yield number, kind, [[p] for p in xy(body[40:], n)]
        elif kind:
            parts, n = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            points = xy(body[44 + 4 * parts :], n)
            split = [points[a:b] for a, b in zip(starts, starts[1:])]
            yield number, kind if parts == 1 else f"MULTI{kind}", split
        else:
            yield number, None, None


def table_of(data: bytes) -> tuple[list[str], list[list[str]]]:
    """Names and rows of a .dbf file."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        rec, k, row = data[head + i * size : head + (i + 1) * size], 1, []
        for _, width in fields:
            row.append(rec[k : k + width].decode("utf-8", "replace").strip())
            k += width
        rows.append(row)
    return [f[0] for f in fields], rows


def read_shapefile(spark: SparkSession, path: str) -> VectorLayer:
    """Path without suffix, or a pattern of such; a file is decoded in one task."""
    stem = path[:-4] if path.endswith(".shp") else path
    files = spark.read.format("binaryFile").load([f"{stem}.shp", f"{stem}.dbf"]).select(F.regexp_replace("path", r"\.[^.]+$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("kind"), "content")
    both = files.groupBy("stem").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for shp, dbf in zip(pdf["shp"], pdf["dbf"]):
                names, rows = table_of(bytes(dbf)) if dbf is not None else ([], [])
                for i, (number, kind, parts) in enumerate(shapes_of(bytes(shp))):
                    out.append((number - 1, dict(zip(names, rows[i])) if i < len(rows) else {}, {"kind": kind, "parts": parts} if kind else None))
            yield pd.DataFrame(out, columns=["fid", "p", "geom"])

    rows = both.mapInPandas(parse, f"fid long, p map<string, string>, geom {G.SCHEMA}")
    names = [r[0] for r in rows.select(F.explode(F.map_keys("p"))).distinct().orderBy(F.col("col")).collect()]
    own = [F.col("p")[n].alias(n if n.lower() not in ("fid", "geom") else f"{n}_") for n in names]
    extra = [] if any(n.lower() == "id" for n in names) else [(F.col("fid") + 1).cast("string").alias("id")]
    return VectorLayer(rows.select("fid", *extra, *own, "geom"))


def shapefile_bytes(layer: VectorLayer, exclude: Sequence[str] = ()) -> dict[str, bytes]:
    """The .shp, .shx and .dbf of a layer. The first row's family of kinds decides, others are left out; names are cut
    to ten characters and kept apart; widths come from one aggregation; rings are closed and clockwise."""
    df = layer.df.where(F.size(G.vertices(F.col("geom"))) > 0)
    first = df.orderBy("fid").select(F.col("geom")["kind"]).first()
    family = (first[0] if first else "POINT").replace("MULTI", "")
    names = [c for c in df.columns if c not in ("fid", "geom", *exclude)]
    short: dict[str, str] = {}
    for n in names:
        s, k = "".join(c if c.isalnum() or c == "_" else "_" for c in n)[:10], 1
        while s.upper() in {x.upper() for x in short.values()}:
            s, k = f"{s[: 10 - len(str(k))]}{k}", k + 1
        short[n] = s
    df = df.where(F.regexp_replace(F.col("geom")["kind"], "MULTI", "") == family)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    widths = df.agg(F.count("*").alias("n"), *[F.max(F.octet_length(text(c))).alias(f"w{i}") for i, c in enumerate(names)]).first() if names else None
    width = [max(1, min(254, widths[f"w{i}"] or 1)) for i in range(len(names))]
    multi = family == "POINT" and df.where(F.col("geom")["kind"] == "MULTIPOINT").limit(1).count() > 0
    code = {"POINT": 8 if multi else 1, "LINESTRING": 3, "POLYGON": 5}[family]
    shapes, index, table, box, at = [], [], [], [math.inf, math.inf, -math.inf, -math.inf], 100
    for i, r in enumerate(df.orderBy("fid").toLocalIterator()):  # a file of this kind is one stream by definition
        parts = [[(p["x"], p["y"]) for p in part] for part in r["geom"]["parts"]]
        if family == "POLYGON":
            parts = [p if p[0] == p[-1] else [*p, p[0]] for p in parts]
            parts = [p[::-1] if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:])) > 0 else p for p in parts]
        points = [p for part in parts for p in part]
        own = [min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)]
        box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
        flat = struct.pack(f"<{2 * len(points)}d", *[c for p in points for c in p])
        if code == 1:
            body = struct.pack("<i", 1) + flat[:16]
        elif code == 8:
            body = struct.pack("<i4di", 8, *own, len(points)) + flat
        else:
            starts = [sum(len(p) for p in parts[:k]) for k in range(len(parts))]
            body = struct.pack(f"<i4dii{len(parts)}i", code, *own, len(parts), len(points), *starts) + flat
        shapes.append(struct.pack(">ii", i + 1, len(body) // 2) + body)
        index.append(struct.pack(">ii", at // 2, len(body) // 2))
        at += 8 + len(body)
        table.append(b" " + b"".join(str("" if r[n] is None else r[n]).encode()[:w].ljust(w) for n, w in zip(names, width)))
    if not shapes:
        box = [0.0] * 4
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, code, *box, 0, 0, 0, 0)
    fields = b"".join(short[n].encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in zip(names, width))
    dbf = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(table), 32 + len(fields) + 1, 1 + sum(width)) + fields + b"\r" + b"".join(table) + b"\x1a"
    return {"shp": head(at) + b"".join(shapes), "shx": head(100 + 8 * len(index)) + b"".join(index), "dbf": dbf}


def schema_of(layer: VectorLayer) -> T.StructType:
    return layer.df.schema
