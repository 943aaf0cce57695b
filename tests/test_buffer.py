"""Grown and shrunk geometries against plain distances; holes, lines, points and rings that cross themselves."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from geoloom.operators import geometry

SIZE = 12
SHAPES = {
    "ell": ([(2, 2), (9, 2), (9, 5), (5, 5), (5, 10), (2, 10)], [[(3, 3), (4, 3), (4, 8), (3, 8)]], False),
    "bow": ([(1, 1), (10, 9), (10, 1), (1, 9)], [], False),
    "line": ([(1, 1), (6, 10), (11, 4)], None, True),
    "two": ([(1, 6), (11, 7)], None, None),
    "point": ([(5.25, 6)], [], None),
    "flat": ([(3, 3), (3, 3), (3, 3)], [], False),
    "outside": ([(-9, -9), (-5, -9), (-5, -5)], [], False),
}


def sides(ring, is_open=False):
    return list(zip(ring, ring[1:], strict=False)) if is_open and len(ring) > 1 else list(zip(ring, ring[1:] + ring[:1], strict=True))


def gap(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def within(p, ring):
    odd = False
    for a, b in sides(ring):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def plain(name, buffer):
    ring, holes, is_open = SHAPES[name]
    for y, x in itertools.product(range(SIZE), range(SIZE)):
        p = (x + 0.5, SIZE - y - 0.5)
        at = within(p, ring) and not any(within(p, r) for r in holes or []) and not is_open
        close = min(gap(p, a, b) for r, o in [(ring, is_open), *((h, False) for h in holes or [])] for a, b in sides(r, o)) <= abs(buffer)
        if at and not buffer or buffer > 0 and (at or close) or buffer < 0 and at and not close:
            yield (name, y, x)


@pytest.fixture(scope="module")
def shapes(spark):
    point = lambda p: {"x": float(p[0]), "y": float(p[1])}
    rows = [(0, k, [point(p) for p in r], None if h is None else [[point(p) for p in q] for q in h], o) for k, (r, h, o) in SHAPES.items()]
    return geometry.with_box(spark.createDataFrame(rows, f"patch_id long, name string, ring {geometry.RING}, holes array<{geometry.RING}>, open boolean"))


@pytest.fixture(scope="module")
def maps(spark):
    return spark.createDataFrame([(0, 0.0, 0.0, float(SIZE), float(SIZE), SIZE, SIZE)], "patch_id long, min_x double, min_y double, max_x double, max_y double, height int, width int")


@pytest.mark.parametrize("buffer", [0.0, 0.8, 2.3, -0.6])
def test_buffers_equal_plain_distances(shapes, maps, buffer):
    got = geometry.covered_pixels(shapes, maps, buffer)
    want = {hit for k in SHAPES for hit in plain(k, buffer)}
    assert {(r.name, r.y, r.x) for r in got.collect()} == want and got.count() == len(want)
    assert set(got.columns) == {*shapes.columns, "y", "x"}


def test_rings_alone_and_empty_tables(shapes, maps):
    alone = geometry.covered_pixels(shapes.where("name = 'bow'").drop("holes", "open"), maps, 0.8)
    assert {(r.name, r.y, r.x) for r in alone.collect()} == set(plain("bow", 0.8))
    assert geometry.covered_pixels(shapes.limit(0), maps, 1.0).count() == 0
    assert geometry.covered_pixels(shapes.withColumn("ring", F.lit(None).cast(geometry.RING)).transform(geometry.with_box), maps, 1.0).count() == 0
