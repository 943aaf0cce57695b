"""Curves of long series, cut into parts, against one group; Akima by windows against NumPy."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import curves
from geoloom.operators import long_series, timeseries

START = datetime(2024, 1, 1)
SCHEMA = "name string, ts timestamp_ntz, v double"


def rows_of(name, hours, values):
    return [(name, START + timedelta(hours=float(h)), None if v is None else float(v)) for h, v in zip(hours, values, strict=True)]


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["name"], []).append((r["ts"], r["v"]))
    return {k: [v for _, v in sorted(x)] for k, x in out.items()}


def want(fit, hours, values, at):
    """A curve through the points of one series, missing outside of it."""
    pairs = {}
    for h, v in zip(hours, values, strict=True):
        if v is not None:
            pairs.setdefault(h, []).append(v)
    x, y = np.array(sorted(pairs)) / 24, np.array([np.mean(pairs[h]) for h in sorted(pairs)])
    t = np.array(at) / 24
    return [None if len(x) < 2 or not x[0] <= a <= x[-1] else v for a, v in zip(t, fit(x, y, t) if len(x) > 1 else t, strict=True)]


def close(a, b, tolerance=1e-9):
    return len(a) == len(b) and all((p is None) == (q is None) and (p is None or abs(p - q) <= tolerance * max(1, abs(q))) for p, q in zip(a, b, strict=True))


def some_series(rng):
    out = {}
    for name, n in (("long", 500), ("part", 64), ("two parts", 129), ("short", 9), ("three", 3), ("two", 2), ("one", 1)):
        hours = np.cumsum(rng.integers(1, 6, n)).tolist()
        out[name] = (hours, rng.normal(size=n).tolist())
    return out


@pytest.mark.parametrize(("kind", "options"), [("cubic", {}), ("spline", {"degree": 3}), ("spline", {"degree": 2}), ("spline", {"degree": 1}), ("akima", {})])
def test_targets_in_parts(spark, kind, options):
    rng = np.random.default_rng(1)
    all_ = some_series(rng)
    df = spark.createDataFrame([r for k, (h, v) in all_.items() for r in rows_of(k, h, v)], SCHEMA).repartition(5)
    grid = {k: sorted({float(x) for x in rng.uniform(-5, max(h) + 5, 40)} | {float(h[0]), float(h[-1])} | set(map(float, h[::7]))) for k, (h, _) in all_.items()}
    targets = spark.createDataFrame([(k, START + timedelta(hours=a)) for k, g in grid.items() for a in g], "name string, ts timestamp_ntz")
    out = got(timeseries.fill_with(df, kind, targets, ["name"], part=32, **options))
    fit = (lambda x, y, t: curves.akima(x, y, t)) if kind == "akima" else (lambda x, y, t: curves.KINDS[kind](x, y, t, **options))
    for k, (h, v) in all_.items():
        micro = [round(a * 3600e6) / 3600e6 for a in grid[k]]
        assert close(out[k], want(fit, h, v, micro), 1e-6), k


@pytest.mark.parametrize("kind", ["cubic", "spline", "akima"])
def test_gaps_in_place(spark, kind):
    """Rows without values take the curve's; repeated times are averaged; a lone value stays."""
    rng = np.random.default_rng(2)
    hours = np.cumsum(rng.integers(1, 4, 300)).tolist()
    values = [None if rng.random() < 0.3 else float(v) for v in rng.normal(size=300)]
    hours, values = hours + hours[10:20], values + [5.0] * 10
    df = spark.createDataFrame(rows_of("a", hours, values) + rows_of("lone", [1, 2, 3], [None, 7.0, None]) + rows_of("none", [1], [None]), SCHEMA)
    out = got(timeseries.fill_with(df, kind, None, ["name"], part=24))
    fit = curves.akima if kind == "akima" else curves.KINDS[kind]
    assert close(out["a"], want(fit, hours, values, sorted(hours)), 1e-7)
    assert out["lone"] == [None, 7.0, None] and out["none"] == [None]


@pytest.mark.parametrize("curve", [curves.Cubic(), curves.Spline(3), curves.Spline(2)])
def test_parts_agree_with_the_whole(curve):
    """The partitioned solve gives the coefficients of the whole system."""
    rng = np.random.default_rng(3)
    x, y = np.cumsum(rng.uniform(0.1, 2, 203)), rng.normal(size=203)
    whole = curves.banded(*curve.rows(x, y, 0, 203, 0, 202))
    cuts, w, parts, places = [0, 40, 80, 120, 203], curve.width, [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = max(a - curve.halo, 0), min(b + curve.halo, 203)
        s = long_series.part_solution(curve, x[lo:hi], y[lo:hi], lo, 203, a, b - 1)
        parts.append(np.vstack([s[:w], s[-w:]]))
        places.append(s)
    for (a, b), s, (before, after) in zip(zip(cuts, cuts[1:], strict=False), places, long_series.reduced(w, parts), strict=True):
        own = s[:, 0] - s[:, 1 : 1 + w] @ before - s[:, 1 + w :] @ after
        assert np.allclose(own, whole[a:b], rtol=1e-9, atol=1e-9)


def test_banded_systems():
    rng = np.random.default_rng(4)
    for n, w in ((1, 1), (2, 3), (30, 2), (50, 5)):
        dense = np.where(np.abs(np.subtract.outer(range(n), range(n))) <= w, rng.normal(size=(n, n)), 0) + 20 * np.eye(n)
        bands = np.array([[dense[i, i + c] if 0 <= i + c < n else 0.0 for c in range(-w, w + 1)] for i in range(n)])
        right = rng.normal(size=(n, 3))
        assert np.allclose(curves.banded(bands, right), np.linalg.solve(dense, right)) and np.allclose(curves.banded(bands, right[:, 0]), np.linalg.solve(dense, right[:, 0]))


@pytest.mark.parametrize("kind", ["cubic", "spline"])
def test_a_series_of_a_million_points(spark, kind):
    """A sine at a million points, asked at a thousand places between them."""
    n = 1_000_000
    points = spark.range(n).select(F.lit("a").alias("name"), F.timestamp_add("SECOND", (F.col("id") * 60).cast("int"), F.lit(START).cast("timestamp_ntz")).alias("ts"), F.sin(F.col("id") / 50.0).alias("v"))
    targets = spark.range(1000).select(F.lit("a").alias("name"), F.timestamp_add("SECOND", (F.col("id") * 59_990 + 17).cast("int"), F.lit(START).cast("timestamp_ntz")).alias("ts"))
    out = timeseries.fill_with(points, kind, targets, ["name"]).collect()
    assert len(out) == 1000
    for r in out:
        at = (r["ts"] - START).total_seconds() / 60 / 50
        assert abs(r["v"] - np.sin(at)) < 1e-6


def noisy(rng, n):
    x = np.cumsum(rng.uniform(0.2, 1.5, n))
    return x, np.sin(x / 5) + 0.2 * rng.normal(size=n)


@pytest.mark.parametrize("degree", [1, 2, 3, 5])
def test_smoothing_between_interpolation_and_polynomial(degree):
    rng = np.random.default_rng(5)
    x, y = noisy(rng, 60)
    t = np.linspace(x[0], x[-1], 200)
    assert np.array_equal(curves.spline(x, y, t, degree, 0), curves.spline(x, y, t, degree))
    line = np.polynomial.Polynomial.fit(x, y, degree)
    most = ((line(x) - y) ** 2).sum()
    assert np.allclose(curves.spline(x, y, t, degree, 10 * most), line(t), atol=1e-8)
    before = 0.0
    for share in (0.01, 0.1, 0.5, 0.9):
        left = ((curves.spline(x, y, x, degree, share * most) - y) ** 2).sum()
        assert abs(left - share * most) <= 2e-3 * share * most and left > before
        before = left
    assert np.allclose(curves.spline(x, y, t, degree, 1e-9 * most), curves.spline(x, y, t, degree), atol=1e-2)


def test_penalty_is_the_jump_of_the_highest_derivative():
    """Against dense algebra: coefficients of a polynomial have no jumps, and those of a kink do at its knot alone."""
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.uniform(0.2, 1.5, 30))
    for p in (1, 2, 3):
        curve = curves.Spline(p)
        knot = curve.knots(x, 0, 30, np.arange(30 + p + 1), p)
        rows = curves.jumps(knot, 30, p)
        dense = np.array([[rows[k, j - k] if 0 <= j - k <= p + 1 else 0.0 for j in range(30)] for k in range(len(rows))])
        on = lambda f: curves.banded(*curve.rows(x, f(x), 0, 30, 0, 29))  # noqa: E731, B023
        assert np.allclose(dense @ on(lambda v: (v - 3) ** p), 0, atol=1e-6)
        k = 12
        got = dense @ on(lambda v: np.maximum(v - knot[p + 1 + k], 0) ** p)
        assert abs(got[k] - float(np.prod(range(1, p + 1)))) < 1e-5 and np.allclose(np.delete(got, k), 0, atol=1e-5)


def test_kriging_by_neighbourhoods_is_within_the_quoted_error():
    """Local and whole processes differ by less than 0.03 % of the values' range."""
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.uniform(0.5, 1.5, 900))
    y = np.sin(x / 40) + 0.3 * np.cos(x / 15)
    t = np.sort(rng.uniform(x[0], x[-1], 300))
    for length in (0.005, 0.02):
        a, b = (curves.kriging(x, y, t, length, 1e-6, k) for k in (900, 128))
        assert np.abs(a - b).max() <= 3e-4 * np.ptp(y)


def test_fitted_length_scale():
    """The likelihood finds the length of a drawn process, and its maximum agrees with a dense search."""
    rng = np.random.default_rng(8)
    a = np.sort(rng.uniform(0, 1, 200))
    for length in (0.02, 0.1):
        y = np.linalg.cholesky(curves.kernel(a, a, length) + 1e-6 * np.eye(200)) @ rng.normal(size=200)
        found = curves.best_length(curves.likelihoods(a, y, 1e-6, 200))
        assert length / 1.5 < found < length * 1.5
        blocks = curves.best_length(curves.likelihoods(a, y, 1e-6, 50))
        assert length / 2 < blocks < length * 2


@pytest.mark.parametrize("length", [0.02, "fit"])
def test_kriging_of_long_series_in_parts(spark, length):
    rng = np.random.default_rng(9)
    hours = np.cumsum(rng.integers(1, 4, 700)).tolist()
    values = [float(np.sin(h / 60) + 0.2 * np.cos(h / 17)) for h in hours]
    df = spark.createDataFrame(rows_of("long", hours, values) + rows_of("short", hours[:30], values[:30]), SCHEMA)
    grid = sorted({float(h) for h in rng.uniform(-3, max(hours) + 3, 60)})
    targets = spark.createDataFrame([(k, START + timedelta(hours=a)) for k in ("long", "short") for a in grid], "name string, ts timestamp_ntz")
    out = got(timeseries.fill_with(df, "kriging", targets, ["name"], part=150, length=length, neighbours=64))
    micro = [round(a * 3600e6) / 3600e6 for a in grid]
    exact = want(lambda x, y, t: np.sin(t * 24 / 60) + 0.2 * np.cos(t * 24 / 17), hours, values, micro)
    assert close(out["long"], exact, 5e-3) and close(out["short"], want(lambda x, y, t: curves.kriging(x, y, t, length, neighbours=64), hours[:30], values[:30], micro), 1e-6)


def test_smoothing_of_series(spark):
    rng = np.random.default_rng(10)
    x, y = noisy(rng, 80)
    df = spark.createDataFrame(rows_of("a", x, y), SCHEMA)
    out = got(timeseries.fill_with(df, "spline", None, ["name"], part=16, degree=3, smoothing=2.0))["a"]
    assert abs(((np.array(out) - y) ** 2).sum() - 2.0) < 0.01
