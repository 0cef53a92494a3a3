"""Triangulated surfaces, radial functions, text models and drawings."""

import math

import numpy as np
import pytest

from terrane.operators import raster as R
from terrane.operators import tin
from terrane.sources import text_models as M
from tests.test_operators import cells, layer, small_network


def test_triangulation_is_delaunay_and_complete():
    rng = np.random.default_rng(1)
    for pts in ([tuple(p) for p in rng.random((60, 2))], [(x, y) for x in range(6) for y in range(6)]):
        pts = [(float(x), float(y)) for x, y in pts]
        tris = tin.triangulate(pts)
        area = sum(tin._orient(*(pts[i] for i in t)) / 2 for t in tris)
        hull = sorted(pts)

        def half(p):
            out = []
            for q in p:
                while len(out) > 1 and tin._orient(out[-2], out[-1], q) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]

        ring = half(hull) + half(hull[::-1])
        assert area == pytest.approx(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip([ring[-1], *ring[:-1]], ring))) / 2)
        edges = {frozenset(e) for t in tris for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        assert len({i for t in tris for i in t}) - len(edges) + len(tris) == 1
        assert not any(tin._in_circle(*(pts[i] for i in t), p) for t in tris for k, p in enumerate(pts) if k not in t)
    assert tin.triangulate([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) == []


def plane(spark, n=40):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, float(x), float(y), float(2 * x - y + 1)) for i, (x, y) in enumerate(rng.random((n, 2)) * 10)] + [(100 + k, x, y, 2 * x - y + 1) for k, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (10.0, 10.0)])], "fid int, x double, y double, z double")


def test_surface_of_a_plane(spark):
    nodes, tri = tin.build(plane(spark))
    t = tin.terrain(tri).collect()
    assert sum(r["area"] for r in t) == pytest.approx(100) and all(r["slope"] == pytest.approx(math.degrees(math.atan(math.sqrt(5)))) for r in t)
    got = {r["id"]: r["z"] for r in tin.elevation(tri, spark.createDataFrame([(1, 3.0, 4.0), (2, 50.0, 0.0)], "id int, x double, y double")).collect()}
    assert got[1] == pytest.approx(3.0) and got[2] is None
    v = tin.volume(tri, 0.0).first()
    assert v["cut"] - v["fill"] == pytest.approx(sum(2 * x - y + 1 for x in np.arange(0.005, 10, 0.01) for y in (5.0,)) * 0.01 * 10, rel=1e-3)
    sides = tin.topology(tri).collect()
    assert len(sides) == 3 * tri.count() and 0 < sum(r["neighbour"] is None for r in sides) < len(sides)
    h = R.Header(5, 5, 0.0, 0.0, 2.0)
    for out in (tin.interpolate_linear(plane(spark), h), tin.interpolate_rbf(plane(spark), h), tin.interpolate_rbf(plane(spark), h, "multiquadric")):
        for (r, c), z in cells(out).items():
            assert z == pytest.approx(2 * (c * 2 + 1) - ((4 - r) * 2 + 1) + 1, abs=1e-6)


def test_volume_of_one_triangle(spark):
    s = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0)], "x double, y double, z double")
    v = tin.volume(tin.build(s)[1]).first()
    assert (v["cut"], v["fill"]) == (0.5, 0)
    s = spark.createDataFrame([(0.0, 0.0, -1.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0)], "x double, y double, z double")
    v = tin.volume(tin.build(s)[1]).first()
    assert v["fill"] == pytest.approx(1 / 24) and v["cut"] - v["fill"] == pytest.approx(1 / 6)


def test_network_file(spark, tmp_path):
    nodes, edges, _ = small_network(spark)
    M.write_network(nodes, edges, str(tmp_path / "n"), "EPSG:5367")
    n, e, issues = M.read_network(spark, str(tmp_path / "n"))
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(n, "node_id", "x", "y", "name") == key(nodes, "node_id", "x", "y", "name") and key(e, "edge_id", "source", "target", "length", "oneway") == key(edges, "edge_id", "source", "target", "length", "oneway") and issues.count() == 0
    (tmp_path / "b").write_text("@META\nversion=2\n@NODES\nnode_id,x,y\n1,0,0\n1,5,5\nx,1,1\n@EDGES\nedge_id,source,target,length\n7,1,9,3\n")
    assert {r["issue"] for r in M.read_network(spark, str(tmp_path / "b"))[2].collect()} == {"DUPLICATE_NODE_ID", "BAD_ROW", "UNKNOWN_NODE"}


def test_lrs_file(spark, tmp_path):
    v = spark.createDataFrame([(r, s, float(s), 0.0, float(s * 2)) for r in ("a", "b") for s in range(3)], "route_id string, seq long, x double, y double, m double")
    M.write_lrs(v, str(tmp_path / "l"))
    vertices, routes = M.read_lrs(spark, str(tmp_path / "l"))
    assert sorted(map(tuple, vertices.collect())) == sorted(map(tuple, v.collect())) and {(r["route_id"], r["total_length"]) for r in routes.collect()} == {("a", 4), ("b", 4)}


def test_style_and_svg(spark):
    text = M.write_style(0, {"file": "a.csv"}, [(0, 5, "#ff0000", "low")])
    assert M.read_style("# c\n" + text)["layer.0.class.0.color"] == "#ff0000"
    df = layer(spark, [(1, "3", "POINT (1 1)"), (2, "9", "POLYGON ((0 0, 4 0, 4 4, 0 0))"), (3, "", "LINESTRING (0 0, 1 1)")], "v string")
    out = M.svg(M.svg_shapes(df, (0, 0, 4, 4), attribute="v", classes=[(0, 5, "#ff0000")]), title="a<b")
    assert out.count("<path") == 2 and out.count("<circle") == 1 and "#ff0000" in out and " Z" in out and "a&lt;b" in out
