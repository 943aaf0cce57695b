"""Operators against plain NumPy: curves, interpolation of features, resizing, snow, clustering with a graph of one's own."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import curves
from geoloom.operators import clustering, masking, neighbourhood, sampling, timeseries
from geoloom.patchset import PatchSet
from geoloom.types import FeatureType

T = FeatureType
POINTS = st.lists(st.floats(-50, 50), min_size=4, max_size=12)
DAYS = [datetime(2024, 1, 1) + timedelta(days=k) for k in range(6)]


def series(y):
    x = np.cumsum(0.5 + np.abs(np.sin(np.arange(len(y)))))
    return x, np.array(y), np.linspace(x[0], x[-1], 41)


@settings(max_examples=60, deadline=None)
@given(POINTS)
def test_cubic_is_the_natural_spline(y):
    """All conditions of the natural spline as one dense system for the coefficients of its pieces."""
    x, y, t = series(y)
    n = len(x) - 1
    a, r = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for k in range(n):
        for at, v in ((0.0, y[k]), (x[k + 1] - x[k], y[k + 1])):
            a[row, 4 * k : 4 * k + 4], r[row] = [1, at, at**2, at**3], v
            row += 1
    for k in range(n - 1):
        h = x[k + 1] - x[k]
        a[row, 4 * k : 4 * k + 4], a[row, 4 * k + 5] = [0, 1, 2 * h, 3 * h**2], -1
        a[row + 1, 4 * k : 4 * k + 4], a[row + 1, 4 * k + 6] = [0, 0, 2, 6 * h], -2
        row += 2
    a[row, 2] = 2
    a[row + 1, 4 * n - 2 : 4 * n] = [2, 6 * (x[-1] - x[-2])]
    c = np.linalg.solve(a, r).reshape(n, 4)
    k = np.clip(np.searchsorted(x, t, "right") - 1, 0, n - 1)
    want = sum(c[k, p] * (t - x[k]) ** p for p in range(4))
    assert np.allclose(curves.cubic(x, y, t), want, atol=1e-7)


@settings(max_examples=60, deadline=None)
@given(POINTS)
def test_akima_by_its_formula(y):
    x, y, t = series(y)
    n = len(x)
    m = {k: (y[k + 1] - y[k]) / (x[k + 1] - x[k]) for k in range(n - 1)}
    m[-1], m[n - 1] = 2 * m[0] - m[1], 2 * m[n - 2] - m[n - 3]
    m[-2], m[n] = 2 * m[-1] - m[0], 2 * m[n - 1] - m[n - 2]
    d = []
    for k in range(n):
        a, b = abs(m[k + 1] - m[k]), abs(m[k - 1] - m[k - 2])
        d.append((m[k - 1] + m[k]) / 2 if a + b < 1e-12 else (a * m[k - 1] + b * m[k]) / (a + b))
    want = []
    for at in t:
        k = min(max(int(np.searchsorted(x, at, "right")) - 1, 0), n - 2)
        h, u = x[k + 1] - x[k], (at - x[k]) / (x[k + 1] - x[k])
        want.append((1 + 2 * u) * (1 - u) ** 2 * y[k] + u * (1 - u) ** 2 * h * d[k] + u * u * (3 - 2 * u) * y[k + 1] + u * u * (u - 1) * h * d[k + 1])
    assert np.allclose(curves.akima(x, y, t), want, atol=1e-6)


@settings(max_examples=60, deadline=None)
@given(POINTS, st.integers(1, 3))
def test_spline_meets_its_points_and_keeps_polynomials(y, degree):
    x, y, t = series(y)
    assert np.allclose(curves.spline(x, y, x, degree), y, atol=1e-6)
    p = np.polynomial.Polynomial([1, -2, 0.5, 0.25][: degree + 1])
    assert np.allclose(curves.spline(x, p(x), t, degree), p(t), atol=1e-6)
    if degree == 1:
        assert np.allclose(curves.spline(x, y, t, 1), np.interp(t, x, y), atol=1e-6)


@settings(max_examples=30, deadline=None)
@given(POINTS)
def test_kriging_by_its_formula(y):
    x, y, t = series(y)
    s, u = (x - x[0]) / (x[-1] - x[0]), (t - x[0]) / (x[-1] - x[0])
    kernel = np.array([[np.exp(-0.5 * ((a - b) / 0.1) ** 2) for b in s] for a in s]) + 1e-6 * np.eye(len(s))
    weights = np.linalg.inv(kernel) @ (y - y.mean())
    want = [y.mean() + sum(w * np.exp(-0.5 * ((a - b) / 0.1) ** 2) for w, b in zip(weights, s, strict=True)) for a in u]
    assert np.allclose(curves.kriging(x, y, t), want, atol=1e-4)


def test_tridiagonal_systems_in_linear_time():
    n = 200_000
    m, s, r = np.full(n, 4.0), np.full(n - 1, 1.0), np.arange(n) / n
    got = curves.tridiagonal(m, s, r)
    back = m * got + np.append(s * got[1:], 0) + np.append(0, s * got[:-1])
    assert np.allclose(back, r)


@pytest.fixture
def patches(spark):
    """Two pixels of two bands over six days; the middle days of pixel 0 are masked, the last day of pixel 1 is missing."""
    rows = [(0, t, 0, x, [float(10 * x + k), float("nan") if x and k == 5 else float(k * k)]) for k, t in enumerate(DAYS) for x in range(2)]
    rows.append((0, DAYS[0], 0, 0, [2.0, 4.0]))
    data = spark.createDataFrame(rows, "patch_id long, ts timestamp_ntz, y int, x int, bands array<double>")
    mask = spark.createDataFrame([(0, t, 0, x, [int(x == 1 or k not in (2, 3))]) for k, t in enumerate(DAYS) for x in range(2)], "patch_id long, ts timestamp_ntz, y int, x int, bands array<int>")
    still = spark.createDataFrame([(0, 0, x, [x]) for x in range(2)], "patch_id long, y int, x int, bands array<int>")
    frame = spark.createDataFrame([(0, t, [int(k != 1)]) for k, t in enumerate(DAYS)], "patch_id long, ts timestamp_ntz, bands array<int>")
    return PatchSet({(T.DATA, "d"): data, (T.MASK, "m"): mask, (T.MASK_TIMELESS, "m"): still, (T.LABEL, "l"): frame}, frames=spark.createDataFrame([(0, t) for t in DAYS], "patch_id long, ts timestamp_ntz"))


def values(patches, feature):
    return {(r.ts.day, r.x): [None if v is None or v != v else round(v, 4) for v in r.bands] for r in patches[feature].collect()}


def test_interpolation_of_a_feature(spark, patches):
    out = timeseries.interpolate(patches, (T.DATA, "d", "new"), mask=(T.MASK, "m"), copy=[(T.MASK, "m"), (T.MASK_TIMELESS, "m", "still")])
    assert out.names() == [(T.DATA, "new"), (T.MASK, "m"), (T.MASK_TIMELESS, "still")] and out.frames.count() == 6
    got = values(out, (T.DATA, "new"))
    assert got[1, 0] == [1.0, 2.0] and got[3, 0] == [2.0, 6.0] and got[4, 0] == [3.0, 11.0] and got[6, 1] == [15.0, None] and len(got) == 12
    clipped = values(timeseries.interpolate(patches, (T.DATA, "d"), clip=(0, 12), unknown=-1), (T.DATA, "d"))
    assert clipped[6, 1] == [12.0, -1.0] and clipped[5, 0] == [4.0, 12.0]
    assert values(timeseries.interpolate(patches, (T.DATA, "d"), mask=(T.MASK_TIMELESS, "m"), unknown=0), (T.DATA, "d"))[3, 0] == [0.0, 0.0]
    assert values(timeseries.interpolate(patches, (T.DATA, "d"), mask=(T.LABEL, "l")), (T.DATA, "d"))[2, 1] == [11.0, 2.0]
    grid = spark.createDataFrame([(0, DAYS[1] + timedelta(hours=12)), (0, datetime(2025, 1, 1))], "patch_id long, ts timestamp_ntz")
    for kind, want in (("linear", [11.5, 2.5]), ("nearest", [11.0, 1.0]), ("next", [12.0, 4.0]), ("cubic", None), ("akima", None), ("spline", None), ("kriging", None)):
        new = timeseries.interpolate(patches, (T.DATA, "d"), kind, targets=grid)
        got = values(new, (T.DATA, "d"))
        assert len(got) == 4 and new.frames.count() == 2 and (want is None and abs(got[2, 1][0] - 11.5) < 0.3 or got[2, 1] == want)
        assert got[1, 0] == [None, None] or kind == "previous"
    for copy in ((T.DATA, "d"), [(T.MASK, "m", "q"), (T.MASK, "m", "q")]):
        with pytest.raises(ValueError, match="clash"):
            timeseries.interpolate(patches, (T.DATA, "d"), copy=copy)


def image(spark, array):
    return spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in np.ndenumerate(array)], "patch_id long, y int, x int, v double")


def as_array(df):
    rows = df.collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.nan)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def cubic_resize(a, h, w):
    def weight(t):
        t = abs(t)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0

    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            cy, cx = (min(max((k + 0.5) * n / m - 0.5, 0), n - 1) for k, n, m in ((i, a.shape[0], h), (j, a.shape[1], w)))
            y0, x0 = int(cy), int(cx)
            out[i, j] = sum(a[min(max(y0 + p, 0), a.shape[0] - 1), min(max(x0 + q, 0), a.shape[1] - 1)] * weight(cy - y0 - p) * weight(cx - x0 - q) for p in range(-1, 3) for q in range(-1, 3))
    return out


def test_resizing(spark):
    a = np.arange(20.0).reshape(4, 5) ** 1.5
    px = image(spark, a)
    assert np.allclose(as_array(neighbourhood.resize_to(px, size=(7, 3), method="cubic")), cubic_resize(a, 7, 3))
    assert as_array(neighbourhood.resize_to(px, scale=(0.5, 2.0))).shape == (2, 10) and as_array(neighbourhood.resize_to(px, scale=2.0, method="nearest")).shape == (8, 10)
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 300.0, 120.0)], "patch_id long, min_x double, min_y double, max_x double, max_y double")
    assert as_array(neighbourhood.resize_to(px, resolution="60m", boxes=boxes)).shape == (2, 5)
    whole = neighbourhood.resize_to(px.withColumn("v", F.col("v") * 10), size=(4, 5), dtype="tinyint")
    assert dict(whole.dtypes)["v"] == "tinyint" and np.array_equal(as_array(whole), np.minimum(np.round(a * 10), 127))
    assert dict(neighbourhood.resize_to(px, size=(2, 2), dtype="float").dtypes)["v"] == "float"
    for bad in ({}, {"size": (1, 1), "scale": 2.0}, {"resolution": 10}):
        with pytest.raises(ValueError):
            neighbourhood.resize_to(px, **bad)
    with pytest.raises(ValueError):
        neighbourhood.resize(px, 2, 2, "nonsense")


def test_resolutions():
    assert [neighbourhood.parsed_resolution(r) for r in ("60m", " 7.5 m ", "10", 20, 0.5)] == [60.0, 7.5, 10.0, 20.0, 0.5]
    for bad in ("m", "60 ft", "-5m"):
        with pytest.raises(ValueError):
            neighbourhood.parsed_resolution(bad)


def test_snow_grows_by_its_radius(spark):
    rows = [(0, DAYS[0], y, x, [0.9, 0.5, 0.5, 0.1] if (y, x) == (3, 3) else [0.2, 0.1, 0.5, 0.3]) for y in range(7) for x in range(7)]
    px = spark.createDataFrame(rows, "patch_id long, ts timestamp_ntz, y int, x int, bands array<double>")
    alone = {(r.y, r.x) for r in masking.snow_mask(px, (0, 1, 2, 3)).where("v = 1").collect()}
    grown = {(r.y, r.x) for r in masking.snow_mask(px, (0, 1, 2, 3), dilation=2).where("v = 1").collect()}
    assert alone == {(3, 3)} and grown == {(3 + dy, 3 + dx) for dy, dx in neighbourhood.disk(5)} and len(grown) == 17


def test_clusters_of_a_masked_image_and_of_a_graph(spark):
    a = np.array([[0, 0, 9, 9], [0, 5, 5, 9], [7, 0, 0, 9]])
    px = image(spark, a).select("patch_id", "y", "x", F.array("v").alias("bands"))
    got = {(r.y, r.x): r.cluster for r in clustering.cluster(px, 0.5, "euclidean").collect()}
    assert [[got[y, x] for x in range(4)] for y in range(3)] == [[0, 0, 1, 1], [0, 2, 2, 1], [3, 4, 4, 1]]
    small = {(r.y, r.x): r.cluster for r in clustering.cluster(px, 0.5, "euclidean", remove_small=3, mask=F.col("bands")[0] < 9).collect()}
    assert {k for k, c in small.items() if c >= 0} == {(0, 0), (0, 1), (1, 0)} and small[0, 2] == -1
    assert set(clustering.boundaries(px, clustering.cluster(px, 0.5, "euclidean")).selectExpr("size(bands) AS n").distinct().collect()[0]) == {2}


def test_a_column_scores_clouds_as_a_model_does(spark):
    rows = [(0, datetime(2024, 1, 1), y, x, [float((y * 3 + x * 5) % 11)]) for y in range(6) for x in range(5)]
    px = spark.createDataFrame(rows, "patch_id long, ts timestamp_ntz, y int, x int, bands array<double>")
    run = lambda scorer: sorted(map(tuple, masking.cloud_mask(px, scorer, valid=F.col("x") != 2, average_over=3, threshold=0.5, dilation=3).collect()))
    model = run(lambda bands: pd.Series([b[0] / 10 for b in bands]))
    assert model == run(F.col("bands")[0] / 10) and {r[-1] for r in model} == {True, False}
    assert all(r[4] == 0 and not r[5] for r in model if r[3] == 2)


def test_draws_with_replacement(spark):
    px = spark.range(600).selectExpr("id div 300 AS patch_id", "cast(id % 300 div 20 AS int) AS y", "cast(id % 20 AS int) AS x", "cast(id % 300 >= 290 AS int) AS v")
    draw = lambda seed: sorted(map(tuple, sampling.fraction_sample(px, {0: 0.5, 1: 3.0}, seed=seed, replace=True).select("patch_id", "y", "x", "v").collect()))
    got = draw(3)
    assert {(p, v): sum(r[0] == p and r[3] == v for r in got) for p in (0, 1) for v in (0, 1)} == {(0, 0): 145, (0, 1): 30, (1, 0): 145, (1, 1): 30}
    assert all(v == (y * 20 + x >= 290) for _, y, x, v in got)
    assert 1 < len(set(r for r in got if r[3] == 1)) <= 20 and got == draw(3) != draw(4)
