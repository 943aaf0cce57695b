"""Connected areas and their rings across tiles, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import areas


def raster_of(spark, images, kind="int"):
    return spark.createDataFrame([(p, int(y), int(x), v) for p, a in images.items() for (y, x), v in a.items()], f"name string, y int, x int, v {kind}")


def plain_areas(a, connectivity):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    left, out = set(a), []
    while left:
        todo, own = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                own.add(p)
                todo += [q for dy, dx in steps if (q := (p[0] + dy, p[1] + dx)) in left and a[q] == a[p]]
        out.append(frozenset(own))
    return out


def crossings(ring, y, x):
    """Whether the pixel's centre lies in the ring (points x, y)."""
    n = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        n += ax == bx and ax > x + 0.5 and min(ay, by) <= y < max(ay, by)
    return n % 2 == 1


def noise(rng, h, w, values, gaps=0.0):
    return {(y, x): int(rng.integers(values)) for y in range(h) for x in range(w) if rng.random() >= gaps}


def spiral(n):
    """One area that winds through all tiles."""
    a, y, x, dy, dx = {(i, j): 0 for i in range(n) for j in range(n)}, 0, 0, 0, 1
    free = lambda i, j: 0 <= i < n and 0 <= j < n and a[i, j] == 0
    while True:
        a[y, x] = 1
        if not free(y + dy, x + dx) or a.get((y + 2 * dy, x + 2 * dx)) == 1:
            dy, dx = dx, -dy
            if not free(y + dy, x + dx) or a.get((y + 2 * dy, x + 2 * dx)) == 1:
                return a
        y, x = y + dy, x + dx


IMAGES = {
    "noise": lambda rng: noise(rng, 14, 17, 2), "gaps": lambda rng: noise(rng, 11, 9, 2, 0.2), "spiral": lambda rng: spiral(19), "flat": lambda rng: {(y, x): 3 for y in range(12) for x in range(12)},
    "rooms": lambda rng: {(y, x): int(not (y % 5 in (1, 2) and x % 4 in (1, 2))) for y in range(16) for x in range(13)}, "checks": lambda rng: {(y, x): (y + x) % 2 for y in range(7) for x in range(7)}, "dot": lambda rng: {(0, 0): 1},
}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_areas_and_rings_over_tiles(spark, connectivity):
    rng = np.random.default_rng(1)
    images = {k: f(rng) for k, f in IMAGES.items()}
    df = raster_of(spark, images)
    found = {}
    for r in areas.labelled(df, ["name"], connectivity, side=4).collect():
        found.setdefault((r["name"], r["component"]), set()).add((r["y"], r["x"]))
    want = {k: plain_areas(a, connectivity) for k, a in images.items()}
    assert sorted((k[0], sorted(v)) for k, v in found.items()) == sorted((k, sorted(s)) for k, v in want.items() for s in v)
    shapes = areas.vectorize(df, ["name"], connectivity, side=4).collect()
    assert len(shapes) == len(found)
    for r in shapes:
        own = found[r["name"], r["component"]]
        rings = [[(p["x"], p["y"]) for p in ring] for ring in [r["ring"], *r["holes"]]]
        sizes = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:] + g[:1], strict=True)) / 2 for g in rings]
        assert r["pixels"] == len(own) == sum(sizes) and r["value"] == images[r["name"]][next(iter(own))]
        if connectivity == 4:
            assert sizes[0] > 0 and all(s < 0 for s in sizes[1:])
        box = [f(p[k] for p in own) for k in (0, 1) for f in (min, max)]
        for y in range(box[0] - 1, box[1] + 2):
            for x in range(box[2] - 1, box[3] + 2):
                assert sum(crossings(g, y, x) for g in rings) % 2 == ((y, x) in own)
        for g in rings:
            assert g[0] == min(g)
            for a, b, c in zip(g, g[1:] + g[:1], g[2:] + g[:2], strict=True):
                assert (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])  # every point is a turn


def test_one_tile_and_many_agree(spark):
    df = raster_of(spark, {k: f(np.random.default_rng(2)) for k, f in IMAGES.items()})
    rows = lambda side: sorted((r["name"], r["pixels"], str(r["ring"]), str(r["holes"])) for r in areas.vectorize(df, ["name"], side=side).collect())
    assert rows(64) == rows(3) == rows(5)


def test_nulls_nan_and_empty_rasters(spark):
    a = {(0, 0): None, (0, 1): None, (0, 2): float("nan"), (1, 2): float("nan"), (1, 0): 1.0, (1, 1): None}
    out = areas.labelled(raster_of(spark, {"a": a}, "double"), ["name"], side=2).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in out) == [1, 2, 3]
    empty = raster_of(spark, {"a": a}, "double").limit(0)
    assert areas.vectorize(empty, ["name"]).count() == 0 and areas.labelled(empty, ["name"]).count() == 0


def test_doubling_takes_few_rounds(spark):
    """A chain of 300 paths and two short ones, from shuffled rows."""
    rows = [(7, i * 3, (i + 1) % 300 * 3) for i in range(300)] + [(8, 5, 9), (8, 9, 5), (9, 1, 2), (9, 2, 4), (9, 4, 1)]
    df = spark.createDataFrame([rows[i] for i in np.random.default_rng(3).permutation(len(rows))], "component long, head long, next long")
    out = {}
    for r in areas.in_order(df, most_rounds=12).collect():
        out.setdefault((r["component"], r["root"]), []).append((r["place"], r["head"]))
    assert {k: [h for _, h in sorted(v)] for k, v in out.items()} == {(7, 0): [i * 3 for i in range(300)], (8, 5): [5, 9], (9, 1): [1, 2, 4]}
    with pytest.raises(RuntimeError, match="did not settle"):
        areas.in_order(df, most_rounds=3)
