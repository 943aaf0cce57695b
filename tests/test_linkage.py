"""Linkages against one merge at a time, and spaced frames against a walk through the times."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import clustering, filters, linkage
from geoloom.operators.clustering import pixel_edges
from geoloom.layout import with_pixel_numbers

SHAPE = (7, 9)


def image(seed, shape=SHAPE, bands=2):
    return np.random.default_rng(seed).integers(0, 40, (*shape, bands)) / 8


def grid_links(data):
    h, w = data.shape[:2]
    for y, x in itertools.product(range(h), range(w)):
        for v, u in ((y, x + 1), (y + 1, x)):
            if v < h and u < w:
                yield (y * w + x, v * w + u, float(np.sqrt(((data[y, x] - data[v, u]) ** 2).sum())))


def one_at_a_time(data, how, distance=np.inf, n=1):
    """Clusters of pixels, first pixels ordered, by merging the nearest two clusters until none is near enough."""
    links, flat = list(grid_links(data)), data.reshape(-1, data.shape[-1])
    label = list(range(len(flat)))
    while len(set(label)) > n:
        between = {}
        for a, b, d in links:
            p, q = sorted((label[a], label[b]))
            if p != q:
                between.setdefault((p, q), []).append((d, a, b))
        if how == "complete":
            height = {k: max(v) for k, v in between.items()}
        elif how == "single":
            height = {k: min(v) for k, v in between.items()}
        else:
            height = {k: (sum(x[0] for x in v) / len(v), *k) for k, v in between.items()}
        if not height:
            break
        pair = min(height, key=height.get)
        if height[pair][0] > distance:
            break
        label = [pair[0] if x == pair[1] else x for x in label]
    names = {r: i for i, r in enumerate(sorted(set(label)))}
    return [names[x] for x in label]


def pixels_of(spark, images):
    rows = [(k, y, x, [float(v) for v in d[y, x]]) for k, d in images.items() for y, x in itertools.product(*map(range, d.shape[:2]))]
    return spark.createDataFrame(rows, "patch_id long, y int, x int, bands array<double>")


def clusters_of(df, shape=SHAPE):
    out = {}
    for r in df.collect():
        out.setdefault(r.patch_id, {})[r.y * shape[1] + r.x] = r.cluster
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


@pytest.mark.parametrize("how", ["complete", "average", "single"])
@pytest.mark.parametrize("short", [linkage.SHORT_GRAPH, 0])
def test_tasks_and_rounds_end_where_single_merges_end(spark, monkeypatch, how, short):
    monkeypatch.setattr(linkage.merge_tree, "__defaults__", ("single", None, short, linkage.SMALL_ROWS))
    images = {k: image(k) + np.random.default_rng(k + 9).random((*SHAPE, 2)) * (how == "average") for k in range(3)}  # whole numbers: many ties
    px = pixels_of(spark, images)
    some = clusters_of(clustering.cluster(px, affinity="l2", linkage=how, n_clusters=5))
    near = clusters_of(clustering.cluster(px, 2.0, "euclidean", linkage=how)) if short else {}
    for k, data in images.items():
        assert some[k] == one_at_a_time(data, how, n=5)
        assert not near or near[k] == one_at_a_time(data, how, 2.0)


def test_moves_too_many_to_broadcast_give_the_same_tree(spark):
    used = with_pixel_numbers(pixels_of(spark, {1: image(4, (4, 5))}), ["patch_id"]).cache()
    edges = pixel_edges(used, "euclidean")
    tree = lambda **k: sorted(linkage.merge_tree(used, edges, "complete", **k).collect())
    assert tree() == tree(short=0, small=0) == tree(short=0) and len(tree()) == 19


def test_ward_finds_planted_blocks_and_its_heights_are_growths_of_the_error(spark):
    rng = np.random.default_rng(3)
    data = np.repeat(np.repeat(np.array([[0.0, 10.0], [20.0, 30.0]]), 4, 0), 5, 1)[..., None] + rng.random((8, 10, 1))
    px = pixels_of(spark, {0: data})
    got = clusters_of(clustering.cluster(px, affinity="euclidean", linkage="ward", n_clusters=4), (8, 10))[0]
    assert got == [(i // 10 // 4) * 2 + i % 10 // 5 for i in range(80)]
    used = with_pixel_numbers(px, ["patch_id"]).cache()
    heights = [r.h.distance for r in linkage.merge_tree(used, pixel_edges(used, "euclidean"), "ward").collect()]
    assert sum(x * x for x in heights) / 2 == pytest.approx(((data - data.mean()) ** 2).sum())


def test_parts_masks_and_arguments(spark):
    data = image(1)
    px = pixels_of(spark, {0: data, 1: data})
    split = clustering.cluster(px, affinity="euclidean", linkage="complete", n_clusters=1, mask=F.col("x") != 4)  # falls into two parts
    assert {r.cluster: r.n for r in split.where("patch_id = 1").groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {-1: 7, 0: 28, 1: 28}
    assert clustering.cluster(px.limit(0), affinity="l1", linkage="average", n_clusters=3).count() == 0
    assert {r.cluster for r in clustering.cluster(px, affinity="l1", n_clusters=1000).where("patch_id = 0").collect()} == set(range(63))
    for wrong in ({}, {"distance": 1.0, "n_clusters": 2}, {"distance": 1.0, "linkage": "ward"}, {"distance": 1.0, "linkage": "median"}, {"n_clusters": 0}):
        with pytest.raises(ValueError):
            clustering.cluster(px, **wrong)


@pytest.mark.parametrize("short", [0, filters.SHORT_SERIES])
def test_spaced_frames_of_long_and_short_patches(spark, short):
    rng, start = random.Random(5), datetime(1969, 12, 31, 22)
    rows = [(p, start + timedelta(seconds=rng.choice([0, 1, 2, 3, 7, 600, 601, 9000]) + 600 * rng.randrange(n))) for p, n in ((1, 400), (2, 3), (-7, 40)) for _ in range(3 * n)]
    rows += [(3, start), (3, start), (None, start), (3, None)]
    df = spark.createDataFrame(rows, "patch_id long, ts timestamp_ntz")
    for gap in (600, 0.5, 0, 86_400):
        want = []
        for p in (1, 2, 3, -7):
            last = None
            for t in sorted({t for q, t in rows if q == p and t}):
                if last is None or (t - last).total_seconds() > gap:
                    want.append((p, t))
                    last = t
        assert sorted(map(tuple, filters.spaced(df, gap, short=short).collect())) == sorted(want)
    assert filters.spaced(df.limit(0), 5, short=short).count() == 0


def test_spaced_frames_do_not_depend_on_the_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT 1L AS patch_id, timestamp_ntz'2024-03-31 01:00:00' + make_interval(0, 0, 0, 0, 0, 20 * id) AS ts FROM range(9)")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [filters.spaced(df, 1800, short=k).count() for k in (0, 9)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [5, 5]
