"""Strong components, report limits and fits on small cases."""

import pytest
from pyspark.sql import functions as F

from terrane.functions import geodesy as D
from terrane.operators import network as N
from terrane.operators import raster as R


@pytest.mark.parametrize("most", [5_000_000, 0])
def test_strong_components(spark, monkeypatch, most):
    monkeypatch.setattr(N, "MOST_ARCS", most)
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(8)], "node_id long, x double, y double")
    pairs = [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 0), (5, 4, 1), (6, 6, 1)]
    edges = spark.createDataFrame([(i, a, b, 1.0, 1.0, o) for i, (a, b, o) in enumerate(pairs)], "edge_id long, source long, target long, length double, travel_time double, oneway int")
    got = {r["node_id"]: (r["component"], r["size"]) for r in N.strong_components(nodes, edges).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (1, 2), 4: (1, 2), 5: (2, 1), 6: (3, 1), 7: (4, 1)}
    assert [r["id"] for r in N.strong_issues(nodes, edges).collect()] == ["5"]


def test_report_limits(spark):
    issues = spark.createDataFrame([("warning", "A", "node", str(i)) for i in range(30)] + [("error", "B", "edge", "7")], "severity string, issue string, element string, id string")
    got = [(r["issue"], r["id"], r["total"]) for r in N.limited(issues, 3).collect()]
    assert sorted(got) == [("A", "0", 30), ("A", "1", 30), ("A", "2", 30), ("B", "7", 1)]


def test_georeference_needs_two_points(spark):
    line = spark.createDataFrame([(0.0, 0.0, 10.0, 5.0), (10.0, 10.0, 30.0, -5.0)], "px double, py double, gx double, gy double")
    r = D.georeference(line).first()
    assert (r["slope_x"], r["intercept_x"], r["slope_y"], r["intercept_y"], r["rms_x"]) == (2.0, 10.0, -1.0, 5.0, 0.0)
    with pytest.raises(Exception, match="control points"):
        D.georeference(line.limit(1)).collect()


def test_counters(spark):
    df, seen = R.counted(spark.range(10), "run", even=F.col("id") % 2 == 0, large=F.col("id") > 7)
    df.collect()
    assert seen.get["even"] == 5 and seen.get["large"] == 2
