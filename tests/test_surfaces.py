"""Whole-grid operators, shapes and files: invariants, hand-computed cases and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import raster as R
from terrane.operators import shapes as P
from terrane.operators import surfaces as S
from terrane.sources import raster_files as RF
from terrane.sources import vector_files as VF
from tests.test_operators import cells, layer, raster


def bowl(n=12, seed=0):
    return np.random.default_rng(seed).random((n, n)).round(3) * 10


def test_filled_surface_has_no_sinks(spark):
    z = S.fill(raster(spark, bowl()))
    f = cells(z)
    d = cells(S.flow_direction(z))
    assert all(v > 0 for v in d.values()) and all(f[k] >= v for k, v in cells(raster(spark, bowl())).items())
    acc = cells(S.flow_accumulation(S.flow_direction(z)))
    assert min(acc.values()) >= 1
    pit = bowl()
    pit[5, 5] = -100
    assert cells(S.fill(raster(spark, pit), max_depth=20))[5, 5] == -100


def test_steepest_agrees_with_windows(spark):
    z = raster(spark, bowl(seed=3))
    a, b = cells(S.flow_direction(z)), cells(R.steepest(z))
    assert all(a[k] == v for k, v in b.items() if v)


def test_watershed_is_as_large_as_its_accumulation(spark):
    d = S.flow_direction(S.fill(raster(spark, bowl(seed=5))))
    acc = cells(S.flow_accumulation(d))
    pour = max(acc, key=acc.get)
    assert sum(v == 1 for v in cells(S.watershed(d, [pour])).values()) == acc[pour]


def test_cost_and_corridor(spark):
    f = raster(spark, [[1, 1, 1], [np.nan, np.nan, 1], [1, 1, 1]])
    c = cells(S.cost_distance(f, [(0, 0)]))
    assert c[0, 2] == 2 and c[1, 1] is None and c[2, 0] == pytest.approx(1 + 2 * math.sqrt(2) + 1)
    a, b = S.cost_distance(f, [(0, 0)]), S.cost_distance(f, [(2, 0)])
    assert min(v for v in cells(R.corridor(a, b)).values() if v is not None) == pytest.approx(c[2, 0])


def test_viewshed(spark):
    flat = raster(spark, np.zeros((5, 5)))
    assert set(cells(S.viewshed(flat, [(0, 0), (4, 4)])).values()) == {2}
    wall = np.zeros((3, 5))
    wall[:, 2] = 10
    v = cells(S.viewshed(raster(spark, wall), [(1, 0)]))
    assert v[1, 1] == v[1, 2] == 1 and v[1, 3] == v[1, 4] == 0


def test_contours_close_around_a_peak(spark):
    z = np.zeros((7, 7))
    z[3, 3] = 10
    out = S.contours(raster(spark, z), [5.0, 50.0]).collect()
    assert len(out) == 1 and out[0]["closed"] and out[0]["vertices"][0] == out[0]["vertices"][-1]
    ramp = raster(spark, np.tile(np.arange(6.0), (4, 1)))
    line = S.contours(ramp, [2.5]).collect()
    assert len(line) == 1 and not line[0]["closed"] and {p["x"] for p in line[0]["vertices"]} == {3.0}


def test_regions(spark):
    got = {r["region"]: r for r in S.regions(raster(spark, [[1, 1, 1], [1, 2, 1], [1, 1, 1], [3, np.nan, 3]])).collect()}
    assert sorted(r["cell_count"] for r in got.values()) == [1, 1, 1, 8]
    ring = next(r for r in got.values() if r["cell_count"] == 8)
    assert len(ring["rings"]) == 2 and len(ring["rings"][0]) == 5 and {(p["x"], p["y"]) for p in ring["rings"][1]} == {(1.0, 2.0), (2.0, 2.0), (2.0, 3.0), (1.0, 3.0)}


def geom(spark, df):
    return [(r["fid"], r["geom"]["kind"], [[(p["x"], p["y"]) for p in part] for part in r["geom"]["parts"]]) for r in df.orderBy("fid").collect()]


SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"


def test_buffers(spark):
    got = geom(spark, P.buffer(layer(spark, [(1, "a", SQUARE), (2, "b", "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))"), (3, "c", "LINESTRING (0 0, 10 0)"), (4, "d", "POINT (1 1)")]), 1.0))
    assert {tuple(round(c, 6) for c in p) for p in got[0][2][0]} == {tuple(round(c, 6) for c in p) for p in got[1][2][0]} == {(-1, -1), (11, -1), (11, 11), (-1, 11)}
    ring = got[2][2][0]
    assert max(math.dist(p, (10, 0)) for p in ring if p[0] > 10) == pytest.approx(1) and min(p[1] for p in ring) == -1 and len(got[3][2][0]) == 9


def test_clipping(spark):
    df = layer(spark, [(1, "a", "LINESTRING (-5 5, 15 5)"), (2, "b", "POLYGON ((5 5, 15 5, 15 15, 5 15, 5 5))"), (3, "c", "POINT (3 3)"), (4, "d", "POINT (33 3)")])
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    got = geom(spark, P.clip(df, ring))
    assert got[0][2] == [[(0, 5), (10, 5)]] and {*got[1][2][0]} == {(5, 5), (10, 5), (10, 10), (5, 10)} and [g[0] for g in got] == [1, 2, 3]
    out = geom(spark, P.clip(df, ring, invert=True))
    assert [g[0] for g in out] == [1, 2, 4] and out[0][2] == [[(-5, 5), (0, 5)], [(10, 5), (15, 5)]]
    notch = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)]
    area = sum(abs(P._area2(p[:-1])) / 2 for p in geom(spark, P.clip(layer(spark, [(1, "a", SQUARE)]), notch))[0][2])
    assert area == pytest.approx(abs(P._area2(notch[:-1])) / 2)


def test_simplification(spark):
    zigzag = "LINESTRING (0 0, 1 0.1, 2 0, 3 0.1, 4 0, 5 4, 6 0)"
    for method, tolerance in (("douglas", 0.5), ("visvalingam", 0.5), ("radial", 1.5), ("nth", 2)):
        (_, _, parts), = geom(spark, P.simplify(layer(spark, [(1, "a", zigzag)]), tolerance, method))
        assert 2 <= len(parts[0]) < 7 and parts[0][0] == (0, 0) and parts[0][-1] == (6, 0)
    tiny = geom(spark, P.simplify(layer(spark, [(1, "a", "POLYGON ((0 0, 1 0, 0 1, 0 0))")]), 100))
    assert len(tiny[0][2][0]) == 4


def test_shared_borders_stay_joined(spark):
    wavy = ", ".join(f"{5 + 0.2 * (-1) ** i:g} {i}" for i in range(11))
    back = ", ".join(f"{5 + 0.2 * (-1) ** i:g} {i}" for i in range(10, -1, -1))
    df = layer(spark, [(1, "l", f"POLYGON ((0 0, {wavy}, 0 10, 0 0))"), (2, "r", f"POLYGON ((10 0, 10 10, {back}, 10 0))")])
    a, b = (set(g[2][0]) for g in geom(spark, P.simplify_topology(df, 1.0)))
    assert len(a & b) == 2 and len(a) == len(b) == 4


def test_crossings_and_repair(spark):
    df = layer(spark, [(1, "a", "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))"), (2, "b", SQUARE), (3, "c", "POLYGON ((0 0, 0 4, 0 4, 4 4, 4 0))")])
    assert [(r[0], r[1]) for r in P.self_crossings(df).collect()] == [(1, 0)]
    fixed = geom(spark, P.repair(df))[2][2][0]
    assert fixed[0] == fixed[-1] and len(fixed) == 5 and P._area2(fixed[:-1]) > 0


def test_spatial_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("# CRS: EPSG:4326\n# note\nname,wkt,pop\nSan José,POINT (1 2),5\n\"A, \"\"B\"\"\",\"POLYGON ((0 0, 1 0, 1 1, 0 0))\",6\nshort\nbad,POINT (x y),7\n")
    a = VF.read_spatial_csv(spark, str(f))
    rows = a.df.orderBy("fid").collect()
    assert a.crs == "EPSG:4326" and [r["name"] for r in rows] == ["San José", 'A, "B"', "bad"] and rows[0]["geom"]["parts"][0][0]["y"] == 2 and rows[2]["geom"] is None and rows[1]["pop"] == "6"
    VF.write_spatial_csv(a, str(tmp_path / "out"))
    b = VF.read_spatial_csv(spark, str(tmp_path / "out"))
    assert [r["name"] for r in b.df.orderBy("fid").collect()] == ["San José", 'A, "B"', "bad"] and b.crs == a.crs


def test_geojson(spark, tmp_path):
    df = layer(spark, [(1, "5", "POINT (1 2)"), (2, 'q"x', "MULTIPOLYGON (((0 0, 1 0, 0 1, 0 0)), ((5 5, 6 5, 5 6, 5 5)))"), (3, "007", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))"), (4, None, "POLYGON ((0 0, 1 0, 0 1, 0 0))"), (5, "true", "LINESTRING (0 0, 1 1)")], "v string")
    VF.write_geojson(VF.VectorLayer(df, "EPSG:5367"), str(tmp_path / "g"))
    back = VF.read_geojson(spark, str(tmp_path / "g"))
    rows = back.df.orderBy("fid").collect()
    assert back.crs == "EPSG:5367" and [r["v"] for r in rows] == ["5", 'q"x', "007", "", "true"]
    assert [r["geom"] for r in rows] == [r["geom"] for r in df.orderBy("fid").collect()]


def test_xy(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("nombre;lon;lat\na;-84,5;9,9\nb;9,9;-184\nc;x;1\n")
    good, bad = VF.read_xy(spark, str(f))
    assert [r["geom"]["parts"][0][0]["x"] for r in good.df.collect()] == [-84.5] and {r["nombre"]: r["reason"] for r in bad.collect()} == {"b": "out of range", "c": "not a number"}


def test_osm(spark, tmp_path):
    f = tmp_path / "m.osm"
    f.write_text('<osm><node id="1" lat="1" lon="1"><tag k="amenity" v="bar"/></node><node id="2" lat="1" lon="2"/><node id="3" lat="2" lon="2"/><way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way>'
                 '<way id="11"><nd ref="1"/><nd ref="99"/><nd ref="3"/><tag k="highway" v="primary"/></way><relation id="20"><member type="way" ref="10" role="outer"/><tag k="type" v="multipolygon"/></relation></osm>')
    got = {(r["element"], r["osm_id"]): r["geom"]["kind"] for r in VF.read_osm(spark, str(f)).collect()}
    assert got == {("node", 1): "POINT", ("way", 10): "POLYGON", ("way", 11): "LINESTRING", ("relation", 20): "POLYGON"}
    assert {r["osm_id"] for r in VF.read_osm(spark, str(f), ["highway=pri*", "amenity"]).collect()} == {1, 11}
    f.write_text('<osm><node id="1" lat="1" lon="1"><tag k="a" v="old"/></node><node id="1" lat="5" lon="6"><tag k="a" v="new"/></node></osm>')
    assert [(r["tags"]["a"], r["geom"]["parts"][0][0]["y"]) for r in VF.read_osm(spark, str(f)).collect()] == [("new", 5.0)]
    VF.write_osm(VF.VectorLayer(layer(spark, [(1, "a&b", "POINT (1 2)"), (2, "", SQUARE)], "name string")), str(tmp_path / "w"))
    assert sorted((r["element"], r["tags"].get("name")) for r in VF.read_osm(spark, str(tmp_path / "w")).collect()) == [("node", "a&b"), ("way", None)]
    lines = [r["value"] for r in VF.osm_xml(VF.VectorLayer(layer(spark, [(1, "a&b", "POINT (1 2)"), (2, "", SQUARE)], "name string"))).orderBy("ord").collect()]
    assert sum(x.startswith("<node") for x in lines) == 5 and 'v="a&amp;b"' in lines[0] and 'k="area"' in lines[-1] and lines[-1].count("<nd") == 5


def test_shapefile(spark, tmp_path):
    for rows in ([(1, "x", "POINT (1 2)"), (2, "ñandú", "POINT (3 4)")], [(1, "x", SQUARE), (2, "y", "MULTIPOLYGON (((0 0, 1 0, 0 1, 0 0)), ((5 5, 6 5, 5 6, 5 5)))"), (3, "no", "POINT (1 1)")], [(1, "l", "LINESTRING (0 0, 1 1, 2 0)")]):
        files = VF.shapefile_bytes(VF.VectorLayer(layer(spark, rows, "a_long_column_name string")))
        for k, data in files.items():
            (tmp_path / f"s.{k}").write_bytes(data)
        back = VF.read_shapefile(spark, str(tmp_path / "s.shp")).df.orderBy("fid").collect()
        assert [r["a_long_col"] for r in back] == [r[1] for r in rows if r[1] != "no"] and back[0]["geom"]["kind"] == rows[0][2].split(" ")[0]
    assert struct_ok(tmp_path)


def struct_ok(tmp_path):
    return (tmp_path / "s.shp").read_bytes()[:4] == b"\x00\x00\x27\x0a"


def test_ascii_grid(spark, tmp_path):
    z = raster(spark, [[1.5, np.nan, 3], [4, 5, 6]])
    rat = spark.createDataFrame([(4.0, "four"), (5.0, "five")], "value double, label string")
    RF.write_ascii_grid(z, str(tmp_path / "g"), 2, rat)
    back, table = RF.read_ascii_grid(spark, str(tmp_path / "g"))
    assert cells(back) == cells(z) and back.header == z.header and {r["label"] for r in table.collect()} == {"four", "five"}
    assert {(r["v"], r["label"]) for r in R.join_rat(back, table).collect() if r["label"]} == {(4.0, "four"), (5.0, "five")}


def test_tiff(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    a[1, 1] = np.nan
    (tmp_path / "t.tif").write_bytes(RF.tiff_bytes(a, 2.0, 100.0, 50.0))
    back = RF.read_tiff(spark, str(tmp_path / "t.tif"))
    assert cells(back) == cells(raster(spark, a)) and (back.header.xll, back.header.yll, back.header.cellsize) == (100, 44, 2)
    part = RF.read_tiff(spark, str(tmp_path / "t.tif"), box=(102, 44, 106, 48))
    assert cells(part) == {(0, 0): None, (0, 1): 6.0, (1, 0): 9.0, (1, 1): 10.0}
    assert RF._packbits(bytes([2, 1, 2, 3, 254, 9])) == bytes([1, 2, 3, 9, 9, 9])
    assert RF._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
