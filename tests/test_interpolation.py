"""Interpolation, ranks and event folds against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import lrs as L
from terrane.operators import raster as R

SAMPLES = "fid long, x double, y double, z double"


def scattered(n: int, seed: int):
    """Clusters, far outliers, and many samples in one place."""
    r = random.Random(seed)
    rows = [(i, r.gauss(0, 1) if i % 3 else r.uniform(-50, 50), r.gauss(0, 1) if i % 3 else r.uniform(-50, 50), float(r.randint(0, 20))) for i in range(n - 22)]
    rows += [(n - 22 + i, 7.0, 7.0, float(i)) for i in range(20)] + [(n - 2, 900.0, -900.0, 3.0), (n - 1, 900.0, -900.0, 5.0)]
    return rows


def brute(place, rows, method, k, power, skip=None):
    near = sorted((((x - place[0]) ** 2 + (y - place[1]) ** 2) ** 0.5, i, z) for i, x, y, z in rows if i != skip)
    if method != "idw":
        near = near[:k]
    if method == "nearest" or near[0][0] < 1e-12:
        return near[0][2]
    return sum(z / d**power for d, _, z in near) / sum(1 / d**power for d, _, z in near)


@pytest.mark.parametrize("method, k", [("nearest", 1), ("idw_neighbors", 3), ("idw_neighbors", 30), ("idw", 0)])
def test_interpolation_is_brute_force(spark, method, k):
    rows = scattered(180, 1)
    places = [(0.0, 0.0), (7.0, 7.0), (900.0, -900.0), (-3000.0, 10.0), (rows[0][1], rows[0][2]), (0.5, 0.25), (40.0, -40.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "pid long, px double, py double")
    got = {r["pid"]: r["v"] for r in R.predict(df, ["pid"], spark.createDataFrame(rows + [(999, None, 1.0, 1.0)], SAMPLES), method, 2.0, k).collect()}
    assert got == pytest.approx({i: brute(p, rows, method, k, 2.0) for i, p in enumerate(places)})


@pytest.mark.parametrize("method, k", [("idw_neighbors", 4), ("idw", 0)])
def test_leaving_one_out_is_brute_force(spark, method, k):
    rows = scattered(120, 2)
    samples = spark.createDataFrame(rows, SAMPLES)
    places = samples.select(F.col("fid").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    got = {r["pid"]: r["v"] for r in R.predict(places, ["pid"], samples, method, 2.0, k, "pid").collect()}
    assert got == pytest.approx({i: brute((x, y), rows, method, k, 2.0, i) for i, x, y, z in rows})


def test_interpolation_edges(spark):
    none = spark.createDataFrame([], SAMPLES)
    h = R.Header(3, 2, 0.0, 0.0, 1.0)
    few = spark.createDataFrame([(1, 0.0, 0.0, 4.0)], SAMPLES)
    for method in ("nearest", "idw", "idw_neighbors"):
        assert R.interpolate(none, h, method).df.count() == 0
        assert {r["v"] for r in R.interpolate(few, h, method).df.collect()} == {4.0}
        assert R.cross_validate(few, method).first()["n"] == 0


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_ungrouped_ranks(spark, n):
    r = random.Random(n)
    values = [float(r.randint(0, n)) if r.random() < 0.7 else 3.0 for _ in range(n)]
    got = {x["v"]: (x["first"], x["last"], x["n"]) for x in R.ranked(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").collect()}
    order = sorted(values)
    assert got == {v: (order.index(v), n - 1 - order[::-1].index(v), n) for v in set(values)}


@pytest.mark.parametrize("mode", ["concatenate", "dissolve"])
def test_event_folds(spark, mode):
    r = random.Random(5)
    rows = [(f"r{r.randint(0, 3)}", i, float(a := r.randint(0, 60)), float(a + r.randint(0, 4))) for i in range(120)]
    want = []
    for route in sorted({x[0] for x in rows}):
        done = []
        for _, i, a, b in sorted((x for x in rows if x[0] == route), key=lambda x: (x[2], x[3], str(x[1]))):
            if done and (abs(a - done[-1][1]) <= 1e-9 if mode == "concatenate" else a < done[-1][1] - 1e-9):
                done[-1] = (done[-1][0], max(done[-1][1], b), done[-1][2] + f";{i}")
            else:
                done.append((a, b, str(i)))
        want += [(route, *d) for d in done]
    df = spark.createDataFrame(rows, "route_id string, id int, from_measure double, to_measure double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(x) for x in L.merge_events(df.withColumn("a", F.lit("x")), mode).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)
    assert L.merge_events(df.limit(0), mode).count() == 0
