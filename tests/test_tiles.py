"""Operators on tiles against plain NumPy, over borders of tiles, gaps, nulls and kinds of numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import neighbourhood, tiles


def rows_of(spark, images, kind="double"):
    rows = [(p, y, x, None if v is None else v) for p, a in images.items() for (y, x), v in a.items()]
    return spark.createDataFrame(rows, f"patch_id long, y int, x int, v {kind}")


def image(rng, h, w, gaps=0.0, nulls=0.0, whole=False):
    at = [(y, x) for y in range(h) for x in range(w) if rng.random() >= gaps]
    return {p: None if rng.random() < nulls else (int(rng.integers(0, 5)) if whole else float(rng.normal())) for p in at}


def around(a, offsets, f):
    out = {}
    for y, x in a:
        seen = [a[y + dy, x + dx] for dy, dx in offsets if a.get((y + dy, x + dx)) is not None]
        out[y, x] = f(seen) if seen else None
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["patch_id"], {})[r["y"], r["x"]] = r["v"]
    return out


ELEMENTS = {"square": neighbourhood.square(3), "wide": neighbourhood.rectangle(2, 7), "disk": neighbourhood.disk(7), "odd": [(0, 0), (0, 2), (-3, 1), (2, -2)], "far": [(5, 5)]}


@pytest.fixture
def small_tiles(monkeypatch):
    for f in (tiles.gathered, tiles.tile_map, tiles.resized):
        monkeypatch.setattr(f, "__defaults__", tuple(5 if d == tiles.SIDE else d for d in f.__defaults__))


@pytest.mark.parametrize("element", ELEMENTS)
def test_extremes_and_means_over_tiles(spark, small_tiles, element):
    rng = np.random.default_rng(1)
    images = {1: image(rng, 13, 17, 0.1, 0.1), 2: image(rng, 1, 9), 3: image(rng, 6, 2, 0, 0.5)}
    df, offsets = rows_of(spark, images), ELEMENTS[element]
    for how, f in (("max", max), ("min", min)):
        assert got(neighbourhood.focal(df, offsets, how)) == {p: around(a, offsets, f) for p, a in images.items()}
        assert got(neighbourhood.morphology(df, offsets, "dilation" if how == "max" else "erosion")) == {p: around(a, offsets, f) for p, a in images.items()}
    means = got(neighbourhood.focal(df, offsets, "avg"))
    for p, a in images.items():
        for at, want in around(a, offsets, lambda s: sum(s) / len(s)).items():
            assert (means[p][at] is None) == (want is None) and (want is None or abs(means[p][at] - want) < 1e-12)
    for how, (f, g) in {"opening": (min, max), "closing": (max, min)}.items():
        assert got(neighbourhood.morphology(df, offsets, how)) == {p: around(around(a, offsets, f), offsets, g) for p, a in images.items()}


@pytest.mark.parametrize("kind", ["int", "bigint", "smallint", "float", "boolean"])
def test_kinds_of_numbers(spark, small_tiles, kind):
    rng = np.random.default_rng(2)
    a = {k: bool(v) if kind == "boolean" else float(v) if kind == "float" else v + (2**60 if kind == "bigint" else 0) for k, v in image(rng, 7, 11, whole=True).items()}
    df = rows_of(spark, {1: a}, kind)
    out = neighbourhood.morphology(df, how="dilation")
    assert dict(out.dtypes)["v"] == kind and got(out)[1] == around(a, neighbourhood.square(3), max)
    assert got(neighbourhood.morphology(df, how="erosion"))[1] == around(a, neighbourhood.square(3), min)


def test_nan_is_larger_than_numbers(spark):
    df = rows_of(spark, {1: {(0, 0): 1.0, (0, 1): float("nan"), (0, 3): float("nan"), (0, 5): float("inf")}})
    high, low = (got(neighbourhood.focal(df, neighbourhood.rectangle(1, 3), how))[1] for how in ("max", "min"))
    assert np.isnan(high[0, 0]) and np.isnan(high[0, 1]) and high[0, 5] == float("inf")
    assert low[0, 1] == 1.0 and np.isnan(low[0, 3])


def test_labels_over_tiles(spark, small_tiles):
    rng = np.random.default_rng(3)
    a = {k: v // 3 for k, v in image(rng, 12, 12, whole=True).items()} | {(y, x): 7 for y in range(2, 10) for x in range(3, 11)}
    out = got(neighbourhood.erode_labels(rows_of(spark, {1: a}, "int"), 3, [7]))[1]
    plus = neighbourhood.disk(3)
    assert out == {p: 0 if v == 7 and any(a.get((p[0] + dy, p[1] + dx), 7) != 7 for dy, dx in plus) else v for p, v in a.items()}


def resized(a, h, w, method):
    iy, wy = tiles.taps(np.arange(h), a.shape[0], h, method)
    ix, wx = tiles.taps(np.arange(w), a.shape[1], w, method)
    return sum((wy[:, k, None] * wx[None, :, m]) * a[np.ix_(iy[:, k], ix[:, m])] for k in range(iy.shape[1]) for m in range(ix.shape[1]))


@pytest.mark.parametrize("method", ["nearest", "linear", "cubic"])
@pytest.mark.parametrize("size", [(3, 40), (31, 2), (14, 16), (1, 1)])
def test_resizing_over_tiles(spark, small_tiles, method, size):
    a = np.random.default_rng(4).normal(size=(14, 16))
    df = rows_of(spark, {1: {k: float(v) for k, v in np.ndenumerate(a)}, 2: {(0, 0): 3.0}})
    out = got(neighbourhood.resize(df, *size, method))
    new = np.array([[out[1][y, x] for x in range(size[1])] for y in range(size[0])])
    assert np.allclose(new, resized(a, *size, method), atol=1e-12) and len(out[1]) == size[0] * size[1]
    assert set(out[2]) == {(y, x) for y in range(size[0]) for x in range(size[1])} and all(abs(v - 3) < 1e-12 for v in out[2].values())


def test_resizing_takes_little_of_a_large_image(spark):
    """A new tile gets four old rows and columns a pixel at most."""
    px = spark.range(600 * 500).select(F.lit(1).cast("long").alias("patch_id"), F.expr("id div 500").cast("int").alias("y"), (F.col("id") % 500).cast("int").alias("x"), (F.col("id") % 977).cast("double").alias("v"))
    a = np.arange(600 * 500).reshape(600, 500) % 977
    for method in ("nearest", "linear", "cubic"):
        out = got(neighbourhood.resize(px, 3, 5, method))[1]
        assert np.allclose([[out[y, x] for x in range(5)] for y in range(3)], resized(a, 3, 5, method))


def shuffled_rows(spark, run):
    """Rows written to shuffles while run() runs."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_few_rows_are_shuffled(spark):
    """Below a fifth of the pixels, for images of several tiles and for an 11 by 11 element."""
    px = spark.range(300 * 200 * 4).select(F.expr("id div 60000").alias("patch_id"), F.expr("(id % 60000) div 200").cast("int").alias("y"), (F.col("id") % 200).cast("int").alias("x"), (F.col("id") % 977).cast("double").alias("v"))
    for run in (
        lambda: neighbourhood.morphology(px, neighbourhood.square(11), "opening").write.format("noop").mode("overwrite").save(),
        lambda: neighbourhood.resize(px, 150, 310).write.format("noop").mode("overwrite").save(),
        lambda: neighbourhood.erode_labels(px.withColumn("v", F.col("v").cast("int")), 5).write.format("noop").mode("overwrite").save(),
    ):
        rows = shuffled_rows(spark, run)
        assert 0 < rows < 0.2 * 300 * 200 * 4
