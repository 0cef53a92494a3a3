"""Expression language, conditions, geometry columns, numbers and projections on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import geodesy as D
from terrane.functions import geometry as G
from terrane.functions import text as T
from terrane.functions.condition import ConditionError, compile_condition
from terrane.functions.expression import ExpressionError, compile_expression, names_in
from terrane.functions.numbers import format_g, prefix_number, strict_number


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("-2^2", -4), ("2^3^2", 512), ("1/0", 0), ("3>2>0", 1), ("0.1+0.2==0.3", 1), ("1 ? 2 : 3", 2), ("0 ? 2 : 1 ? 5 : 6", 5), ("min(3,1,2)+max(1,4)", 5), ("mean(1,2,6)", 3), ("2*-3", -6),
    ("log(0)<5", 1), ("log(-1)==log(-1)", 0), ("atan(1)*4", math.pi), ("sqrt(16)+abs(-2)", 6), ("(1+2)*3", 9), ("1!=1.0000000000001", 0), ("10-2-3", 5), (".5+1.", 1.5),
])
def test_expressions(spark, text, want):
    assert value(spark, compile_expression(text, {})) == pytest.approx(want)


@pytest.mark.parametrize("text", ["1 +", "nope(1)", "1 $ 2", "(1", "pow(1)", "1 2"])
def test_bad_expressions(spark, text):
    with pytest.raises(ExpressionError):
        compile_expression(text, {})


def test_names(spark):
    assert names_in("a + sin(b) * a - c2") == ["a", "b", "c2"]


def test_conditions(spark):
    df = spark.createDataFrame([("12abc", "Nick"), ("4", "Mary"), (None, "Zoe"), ("x", "Adam")], "n string, name string")
    look = lambda c: F.col(c) if c in df.columns else None
    pick = lambda t: [r["name"] for r in df.where(compile_condition(t, look)).collect()]
    assert pick("n > 5") == ["Nick", "Adam"] and pick("name > M") == ["Nick", "Mary", "Zoe"] and pick("n == 4 AND name = 'Mary'") == ["Mary"] and pick("gone = 1") == []
    with pytest.raises(ConditionError):
        compile_condition("nonsense", look)


def test_numbers(spark):
    df = spark.createDataFrame([("12abc",), (" -3.5e2x",), ("abc",), ("inf",), ("",), (None,), (".5",)], "s string")
    got = [tuple(r) for r in df.select(prefix_number(F.col("s")), strict_number(F.col("s"))).collect()]
    assert [g[0] for g in got] == [12.0, -350.0, None, math.inf, None, None, 0.5] and got[0][1] is None and got[6][1] == 0.5
    for x in (1.0, 0.1, 123456.789, 1e-7, 2.5e12, -0.25, 1 / 3):
        assert float(value(spark, format_g(F.lit(x)))) == pytest.approx(float("%.10g" % x), rel=1e-9)


def test_wkt_round_trip(spark):
    for text in ("POINT (1.000000 2.000000)", "LINESTRING (0.000000 0.000000, 1.000000 1.500000)", "MULTIPOLYGON (((0.000000 0.000000, 1.000000 0.000000, 0.000000 1.000000)), ((5.000000 5.000000, 6.000000 5.000000, 5.000000 6.000000)))", "MULTILINESTRING ((0.000000 0.000000, 1.000000 1.000000), (2.000000 2.000000, 3.000000 3.000000))", "POINT EMPTY"):
        assert value(spark, G.to_wkt(G.from_wkt(F.lit(text)))) == text
    assert value(spark, G.from_wkt(F.lit("POINT Z (1 2 3)"))["parts"])[0][0]["y"] == 2.0
    assert value(spark, F.size(G.vertices(G.from_wkt(F.lit("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))"))))) == 9
    assert value(spark, G.from_wkt(F.lit("POINT (a b)"))) is None and value(spark, G.from_wkt(F.lit("nothing"))) is None


def test_box_edges(spark):
    box = G.box(F.lit(0), F.lit(0), F.lit(20), F.lit(20))
    for x in (0, 10, 20, -1, 21):
        for y in (0, 10, 20, -1, 21):
            assert value(spark, G.in_feature(F.lit(float(x)), F.lit(float(y)), box)) == (0 <= x < 20 and 0 <= y < 20)


def test_predicates(spark):
    g = lambda t: G.from_wkt(F.lit(t))
    square = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    assert value(spark, G.within(g("POINT EMPTY"), g(square))) and not value(spark, G.within(g("POINT (1 1)"), g("POINT (1 1)")))
    assert value(spark, G.intersects(g("LINESTRING (5 5, 50 50)"), g(square))) and not value(spark, G.intersects(g("LINESTRING (-5 5, 15 5)"), g(square)))
    assert value(spark, G.intersects(g("POINT (1 1)"), g("LINESTRING (0 0, 2 2)"))) and not value(spark, G.intersects(g("POINT (1 1)"), g("MULTIPOINT (1 1)")))
    assert not value(spark, G.intersects(g(square), g("POINT (5 5)"))) and value(spark, G.intersects(g(square), g("POINT (5 5)"), point_in_area=True))
    assert value(spark, G.vertex_distance(g("POINT (0 0)"), g("LINESTRING (3 4, 0 100)"))) == 5


def test_measures_and_centroids(spark):
    g = lambda t: G.from_wkt(F.lit(t))
    m = G.measures(g("POLYGON ((0 0, 3 0, 3 4, 0 0))"))
    assert value(spark, m["area"]) == 6 and value(spark, m["perimeter"]) == 12
    c = value(spark, G.centroid(g("LINESTRING (0 0, 10 0, 10 2)")))
    assert (c["x"], c["y"]) == (6, 0)
    c = value(spark, G.centroid(g("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))")))
    assert c["x"] == pytest.approx(6) and c["y"] == pytest.approx(1)


def test_text(spark):
    assert value(spark, T.standard_street(F.lit("main  STREET."))) == "Main St" and value(spark, T.title_case(F.lit("o'NEIL-smith  x"))) == "O'Neil-Smith X"
    assert value(spark, T.similarity(F.lit("abcd"), F.lit("abxd"))) == 0.75 and value(spark, T.house_number(F.lit("12"))) == 12 and value(spark, T.house_number(F.lit("12.5"))) is None


def test_projections_round_trip(spark):
    for name in ("crtm05", "utm16n", "utm17n", "webmercator"):
        x, y = D.transform(F.lit(-84.1), F.lit(9.93), "wgs84", name)
        lon, lat = D.transform(x, y, name, "wgs84")
        assert value(spark, lon) == pytest.approx(-84.1, abs=1e-8) and value(spark, lat) == pytest.approx(9.93, abs=1e-8)
    assert value(spark, D.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))) == pytest.approx(math.pi * D.EARTH_MEAN_RADIUS)
    with pytest.raises(ValueError):
        D.system("mars")
