"""Text files of networks, routes and styles, as tables and dictionaries, and drawings as SVG text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from .vector_files import split_line

_NODE = "node_id long, x double, y double, name string, degree int, degree_centrality double, betweenness double, closeness double"
_EDGE = "edge_id long, source long, target long, length double, travel_time double, speed double, oneway int"


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file in `@NAME` sections: (at, section, line). A section's name is carried forward over its lines."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).where("line <> '' and line not like '#%'")
    marks = lines.where("line like '@%'").orderBy("at").collect()  # a handful of headings
    section = F.lit("")
    for m in marks:
        section = F.when(F.col("at") >= m["at"], m["line"].split()[0]).otherwise(section)
    return lines.withColumn("section", section).where("line not like '@%'")


def _typed(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a section by its header line, and the lines that can't be read."""
    first = rows.orderBy("at").limit(1).collect()
    names = [n.strip().lower() for n in first[0]["line"].split(",")] if first else []
    body = rows.where(F.col("at") != (first[0]["at"] if first else -1)).withColumn("v", split_line(F.col("line")))
    cols = []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        value = F.try_element_at("v", F.lit(names.index(name) + 1)) if name in names else F.lit(None)
        cols.append((value if kind == "string" else value.cast("string").try_cast(kind)).alias(name))
    out = body.select("at", "line", *cols)
    key = schema.split(" ")[0]
    return out.where(F.col(key).isNotNull()).drop("at", "line"), out.where(F.col(key).isNull()).select("line", F.lit("BAD_ROW").alias("issue"))


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the rows with problems (unreadable, repeated node numbers, unknown ends)."""
    lines = sections(spark, path)
    nodes, bad_n = _typed(lines.where("section = '@NODES'"), _NODE)
    edges, bad_e = _typed(lines.where("section = '@EDGES'"), _EDGE)
    twice = nodes.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node_id").cast("string").alias("line"), F.lit("DUPLICATE_NODE_ID").alias("issue"))
    ids = nodes.select("node_id").distinct()
    known = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    lost = edges.join(known.select("edge_id"), "edge_id", "left_anti").select(F.col("edge_id").cast("string").alias("line"), F.lit("UNKNOWN_NODE").alias("issue"))
    return nodes.dropDuplicates(["node_id"]), known, bad_n.unionByName(bad_e).unionByName(twice).unionByName(lost)


def _csv_lines(df: DataFrame, columns: Sequence[str]):
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def write_sections(spark: SparkSession, path: str, parts: Sequence[tuple[str, DataFrame, Sequence[str], str]], meta: Mapping[str, str] | None = None) -> None:
    """Tables as sections of one text file: (name, table, columns, order column)."""
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(["@META", *[f"{k}={v}" for k, v in (meta or {}).items()]])], "s int, k long, value string")
    for i, (name, df, cols, order) in enumerate(parts, 1):
        head = spark.createDataFrame([(i, -2, f"@{name}"), (i, -1, ",".join(cols))], "s int, k long, value string")
        rows = rows.unionByName(head).unionByName(df.select(F.lit(i).alias("s"), F.col(order).cast("long").alias("k"), _csv_lines(df, cols).alias("value")))
    rows.repartitionByRange(1, "s", "k").sortWithinPartitions("s", "k").select("value").write.mode("overwrite").text(path)


def write_network(nodes: DataFrame, edges: DataFrame, path: str, crs: str = "") -> None:
    """S13."""
    fill = lambda df, schema: df.select(*[F.col(f.split(" ")[0]) if f.split(" ")[0] in df.columns else F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in schema.split(", ")])
    n, e = fill(nodes, _NODE), fill(edges, _EDGE)
    write_sections(nodes.sparkSession, path, [("NODES", n, n.columns, "node_id"), ("EDGES", e, e.columns, "edge_id")], {"version": "2", "crs": crs})


def write_lrs(vertices: DataFrame, path: str, crs: str = "") -> None:
    """Routes with totals, and their vertices."""
    from pyspark.sql import Window

    routes = vertices.groupBy("route_id").agg(F.max("m").alias("total_length"), F.count("*").alias("vertices"))
    v = vertices.withColumn("k", F.row_number().over(Window.partitionBy("route_id").orderBy("seq")) + F.xxhash64("route_id").bitwiseAND(0x3FFFFFFFFF) * 1_000_000)
    r = routes.withColumn("k", F.xxhash64("route_id").bitwiseAND(0x3FFFFFFFFF))
    write_sections(vertices.sparkSession, path, [("ROUTES", r, ["route_id", "total_length", "vertices"], "k"), ("NODES", v, ["route_id", "seq", "x", "y", "m"], "k")], {"crs": crs})


def read_lrs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, routes)."""
    lines = sections(spark, path)
    vertices, _ = _typed(lines.where("section = '@NODES'"), "route_id string, seq long, x double, y double, m double")
    routes, _ = _typed(lines.where("section = '@ROUTES'"), "route_id string, total_length double, vertices long")
    return vertices, routes


def read_style(text: str) -> dict[str, str]:
    """`key=value` lines; # starts a comment."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip() for k, v in pairs}


def write_style(layer: int, settings: Mapping[str, str], classes: Sequence[tuple[float, float, str, str]]) -> str:
    """A layer's settings and its classes (min, max, color, label)."""
    lines = [f"layer.{layer}.{k}={v}" for k, v in settings.items()]
    for i, (lo, hi, color, label) in enumerate(classes):
        lines += [f"layer.{layer}.class.{i}.{k}={v}" for k, v in (("min", lo), ("max", hi), ("color", color), ("label", label))]
    return "\n".join(lines) + "\n"


def svg_shapes(df: DataFrame, extent: tuple[float, float, float, float], width: int = 800, height: int = 600, attribute: str | None = None, classes: Sequence[tuple[float, float, str]] = (), fill: str = "#88aadd", stroke: str = "#333333", margin: int = 40) -> DataFrame:
    """One SVG element a feature (fid, value), fitted to the page; classes colour by the classified attribute."""
    x0, y0, x1, y1 = extent
    pad = 0.05 * max(x1 - x0, y1 - y0, 1e-9)
    scale = min((width - 2 * margin) / (x1 - x0 + 2 * pad), (height - 2 * margin) / (y1 - y0 + 2 * pad))
    px = lambda v: F.format_string("%.2f %.2f", margin + (v["x"] - (x0 - pad)) * scale, height - margin - (v["y"] - (y0 - pad)) * scale)
    colour = F.lit(fill)
    if attribute:
        for lo, hi, c in reversed(classes):
            colour = F.when(F.col(attribute).try_cast("double").between(lo, hi), c).otherwise(colour)
    g = F.col("geom")
    path = lambda p: F.concat(F.lit("M "), F.array_join(F.transform(p, px), " L "), F.when(g["kind"].contains("POLYGON"), " Z").otherwise(""))
    place = F.split(px(G.at(G.vertices(g), 1)), " ")
    point = F.format_string('<circle cx="%s" cy="%s" r="4" fill="%s"/>', place[0], place[1], colour)
    line = F.format_string('<path d="%s" fill="%s" stroke="%s"/>', F.array_join(F.transform(g["parts"], path), " "), F.when(g["kind"].contains("POLYGON"), colour).otherwise("none"), F.lit(stroke))
    return df.where(F.size(G.vertices(g)) > 0).select("fid", F.when(g["kind"].contains("POINT"), point).otherwise(line).alias("value"))


def svg(shapes: DataFrame, width: int = 800, height: int = 600, title: str = "") -> str:
    """The drawing; what is drawn is a picture's worth of rows, brought here one by one."""
    body = "\n".join(r["value"] for r in shapes.orderBy("fid").toLocalIterator())
    head = f"<title>{title.replace('&', '&amp;').replace('<', '&lt;')}</title>\n" if title else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">\n{head}{body}\n</svg>\n'
