"""Connected areas of a raster, and their rings, on tiles.

A tile labels its own pixels; only pixels that meet an equal one across a tile's border give links, from which the components
come. For rings a tile chains the sides of its areas to paths: the side that follows is told by the two pixels ahead, which the
widened tile holds, so a path knows the side of another tile that goes on. Paths that leave a tile are put in order by pointer
doubling: each round joins every path with the one that its pointer shows, so a ring of n paths takes log2(n) rounds, and no
task ever holds an image. Sides and corners are in pixel corners, y down; an area lies to the right of its sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.layout import SIDE_BITS, with_image_numbers
from geoloom.operators.components import components
from geoloom.operators.skew import few_rows
from geoloom.operators.tiles import NUMPY, SIDE, as_arrow, gathered, schema_of, stacks
from geoloom.session import discard, materialize

RING = "array<struct<x:double,y:double>>"
#: The four headings of a side (dy, dx): along the top, right, bottom and left of its pixel; and the pixel across each.
HEADINGS = [(0, 1), (1, 0), (0, -1), (-1, 0)]
ACROSS = [(-1, 0), (0, 1), (1, 0), (0, -1)]
#: Where a side begins, from the pixel's upper left corner.
STARTS = [(0, 0), (0, 1), (1, 1), (1, 0)]


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links (a, b) connect it with."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        np.minimum.at(root, high[live], low[live])
        while (root[root] != root).any():
            root = root[root]
        a, b = a[live], b[live]
    return root


def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a[y + dy, x + dx] at (y, x), for an array with a border of one that is cut off."""
    h, w = a.shape[1] - 2, a.shape[2] - 2
    return a[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def places(batch: pa.RecordBatch, a: int, corner: tuple[int, int], shape: tuple, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns (tiles by cells) of a stack in the image, and whether they are the tile's own; a reach of one."""
    out = []
    for c, start, n in (("ty", corner[0], shape[1]), ("tx", corner[1], shape[2])):
        at = np.arange(n) + start - 1
        out.append((batch.column(c).to_numpy(zero_copy_only=False)[a : a + shape[0], None].astype(np.int64) * side + at, (at >= 0) & (at < side)))
    (y, own_y), (x, own_x) = out
    if max(y.max(initial=0), x.max(initial=0)) >= (1 << SIDE_BITS) + 1:
        raise ValueError("an image is too large")
    return y, x, own_y[:, None] & own_x


def labelled(raster: DataFrame, keys: Sequence[str], connectivity: int = 4, side: int = SIDE) -> DataFrame:
    """keys, y, x, v of the raster with `component`, the smallest pixel number of its connected area of equal value (null: a value)."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    both = steps + [(-dy, -dx) for dy, dx in steps]
    kind = raster.schema["v"].dataType.simpleString()
    dtype, names = NUMPY[kind], [*keys, "y", "x", "v", "node", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image = batch.column("_image").to_numpy(zero_copy_only=False)
            for a, _, corner, values, there, known in stacks(batch, side + 2, dtype):
                y, x, mine = places(batch, a, corner, values.shape, side)
                number = ((image[a : a + len(values), None, None] << SIDE_BITS) + y[:, :, None] << SIDE_BITS) + x[:, None, :]
                code = np.unique(values, return_inverse=True)[1].reshape(values.shape) + 1
                code = np.where(there, np.where(known, code, 0), -1)
                own = there & mine
                flat = np.full(own.shape, -1)
                flat[own] = np.arange(own.sum())
                wide, index, numbers = (np.pad(c, ((0, 0), (1, 1), (1, 1)), constant_values=-1) for c in (code, flat, number))
                equal = {s: (shifted(wide, *s) == code) & own for s in both}
                pairs = [(flat[e & (shifted(index, *s) >= 0)], shifted(index, *s)[e & (shifted(index, *s) >= 0)]) for s, e in equal.items() if s in steps]
                root = roots_of(int(own.sum()), *(np.concatenate(p) for p in zip(*pairs, strict=True)))
                # a pixel that meets an equal one of another tile: that one's number and its own
                beyond = {s: e & (shifted(index, *s) < 0) for s, e in equal.items()}
                edge = np.logical_or.reduce(list(beyond.values()))
                at = np.concatenate([flat[edge], *(flat[m] for m in beyond.values())])
                to = np.concatenate([number[edge], *(shifted(numbers, *s)[m] for s, m in beyond.items())])
                order = np.argsort(at, kind="stable")
                sizes = np.bincount(at, minlength=int(own.sum()))
                links = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(to[order]))
                t, i, j = np.nonzero(own)
                columns = [*(batch.column(k).take(pa.array(a + t)) for k in keys), pa.array(y[t, i].astype(np.int32)), pa.array(x[t, j].astype(np.int32)), as_arrow(values[own], known[own]), pa.array(number[own][root]), links]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    tiles = with_image_numbers(gathered(raster.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v"), 1, side), keys)
    local = materialize(tiles.mapInArrow(run, f"{schema_of(raster, list(keys))}, y int, x int, v {kind}, node long, links array<long>"), "raster-nodes")
    roots = components(local.where(F.size("links") > 0).select(F.col("node").alias("a"), F.explode("links").alias("b")))
    return local.drop("links").join(few_rows(roots), "node", "left").withColumn("component", F.coalesce("root", "node")).drop("node", "root")


def paths_of(areas: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """component, head, next, xs, ys: paths of sides inside tiles.

    head and next are numbers of sides (pixel and heading): the path's first, and the first of the path that goes on; a ring
    inside one tile goes on with itself, from its smallest side. xs, ys: where the path begins and where it turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, corner, comp, there, _ in stacks(batch, side + 2, np.int64):
                comp = np.where(there, comp, -1)
                y, x, mine = places(batch, a, corner, comp.shape, side)
                own, wide = there & mine, np.pad(comp, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
                exists = np.stack([own & (shifted(wide, *c) != comp) for c in ACROSS], -1)
                t, i, j, k = np.nonzero(exists)
                index = np.full(exists.shape, -1)
                index[t, i, j, k] = np.arange(len(t))
                heading, across, start = np.array(HEADINGS)[k], np.array(ACROSS)[k], np.array(STARTS)[k]
                area = comp[t, i, j]
                ahead = lambda step: wide[t, i + 1 + step[:, 0], j + 1 + step[:, 1]] == area  # noqa: E731, B023
                on, left = ahead(heading), ahead(heading + across)
                move = np.where((on & left)[:, None], heading + across, np.where(on[:, None], heading, 0))
                turned = np.where(on & left, (k + 3) % 4, np.where(on, k, (k + 1) % 4))
                ni, nj = i + move[:, 0], j + move[:, 1]
                gy, gx = y[t, i], x[t, j]
                number = lambda gy, gx, k: ((gy << SIDE_BITS) + gx) * 4 + k
                sid, following = number(gy, gx, k), number(gy + move[:, 0], gx + move[:, 1], turned)
                inside = (ni >= 0) & (ni < comp.shape[1]) & (nj >= 0) & (nj < comp.shape[2])
                after = np.where(inside, index[t, np.clip(ni, 0, comp.shape[1] - 1), np.clip(nj, 0, comp.shape[2] - 1), turned], -1)
                has_before = np.zeros(len(t), bool)
                has_before[after[after >= 0]] = True
                py, px = gy + start[:, 0], gx + start[:, 1]
                heads, ends, cuts, steps = [], [], [0], []
                seen = bytearray(len(t))
                nexts, turns = after.tolist(), k.tolist()
                for first in (*np.flatnonzero(~has_before).tolist(), *range(len(t))):  # open paths, then what is left: closed rings
                    if seen[first]:
                        continue
                    s, last, way = first, first, -1
                    while s >= 0 and not seen[s]:
                        seen[s] = 1
                        if turns[s] != way:
                            steps.append(s)
                            way = turns[s]
                        last, s = s, nexts[s]
                    heads.append(first)
                    ends.append(last)
                    cuts.append(len(steps))
                steps, offsets = np.array(steps, np.int64), pa.array(cuts, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c[steps].astype(np.int32))) for c in (px, py)]
                yield pa.RecordBatch.from_arrays([pa.array(area[heads]), pa.array(sid[heads]), pa.array(following[ends]), *lists], names=["component", "head", "next", "xs", "ys"])

    pixels = areas.select(*keys, "y", "x", F.col("component").alias("v"))
    return gathered(pixels, 1, side).mapInArrow(run, "component long, head long, next long, xs array<int>, ys array<int>")


def in_order(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """component, head, root and place of each path of closed chains (component, head, next), by pointer doubling.

    root is the smallest head of the ring; places grow along the ring, from the root's.
    """

    def rounds(state: DataFrame, step, unsettled) -> DataFrame:
        state = materialize(state, "chains")
        for _ in range(most_rounds):
            new = materialize(step(state), "chains")
            discard(state)
            state = new
            if state.where(unsettled).isEmpty():
                return state
        raise RuntimeError(f"chains did not settle in {most_rounds} rounds")

    def lower(state: DataFrame) -> DataFrame:
        """The smallest head among twice as many paths ahead."""
        there = state.select("component", F.col("head").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        met = state.join(there, ["component", "next"])
        return met.select("component", "head", "first", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("fell"))

    # if no path sees a smaller head twice as far ahead, then all have seen their whole ring
    state = rounds(links.select("component", "head", F.col("next").alias("first"), "next", F.col("head").alias("low"), F.lit(True).alias("fell")), lower, "fell")

    def nearer(state: DataFrame) -> DataFrame:
        """Pointers jump to where their aims point, until all point at the root."""
        there = state.select("component", F.col("head").alias("aim"), F.col("aim").alias("_aim"), F.col("far").alias("_far"))
        going = F.col("aim") != F.col("root")
        done, on = state.where(~going), state.where(going).join(there, ["component", "aim"])
        return done.unionByName(on.select("component", "head", "root", F.col("_aim").alias("aim"), (F.col("far") + F.col("_far")).alias("far")))

    start = state.select("component", "head", F.col("low").alias("root"), F.when(F.col("head") == F.col("low"), F.col("low")).otherwise(F.col("first")).alias("aim"), F.lit(1).cast("long").alias("far"))
    ranked = rounds(start, nearer, "aim <> root")
    discard(state)
    place = F.when(F.col("head") == F.col("root"), F.lit(-(2**62))).otherwise(-F.col("far"))
    return ranked.select("component", "head", "root", place.alias("place"))


def cleaned(xs: list[int], ys: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """A ring without points in the middle of straight runs, from its smallest corner (by x, then y); and its signed area."""
    p = np.stack([np.array(xs, np.int64), np.array(ys, np.int64)], 1)
    before, after = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
    p = p[before[:, 0] * after[:, 1] != before[:, 1] * after[:, 0]]
    p = np.roll(p, -int(np.lexsort((p[:, 1], p[:, 0]))[0]), 0)
    q = np.roll(p, -1, 0)
    return p[:, 0], p[:, 1], float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2


def vectorize(raster: DataFrame, keys: Sequence[str], connectivity: int = 4, side: int = SIDE) -> DataFrame:
    """keys, component, value, pixels, ring and holes of every connected area of equal value, in pixel corners (y down).

    A ring starts at its smallest corner and runs with the area to its right; holes run the other way and come by falling size.
    Where an area touches itself at a corner, its ring turns so as to stay on the same pixel.
    """
    areas = labelled(raster, keys, connectivity, side)
    paths = materialize(paths_of(areas, keys, side), "paths")
    whole = paths.where("head = next").select("component", F.col("head").alias("root"), F.lit(0).cast("long").alias("place"), "xs", "ys")
    parts = paths.where("head <> next")
    if not parts.isEmpty():
        order = in_order(parts.select("component", "head", "next"))
        whole = whole.unionByName(parts.join(order, ["component", "head"]).select("component", "root", "place", "xs", "ys"))
    rings = whole.groupBy("component", "root").agg(F.array_sort(F.collect_list(F.struct("place", "xs", "ys"))).alias("p"))
    rings = rings.select("component", F.flatten("p.xs").alias("xs"), F.flatten("p.ys").alias("ys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cleaned(x, y) for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True)]
            lists = [pa.array([d[c].astype(float) for d in done], pa.list_(pa.float64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("component"), *lists, pa.array([d[2] for d in done], pa.float64())], names=["component", "xs", "ys", "size"])

    rings = rings.mapInArrow(run, "component long, xs array<double>, ys array<double>, size double")
    ring = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")).cast(RING)
    shapes = rings.groupBy("component").agg(F.array_sort(F.collect_list(F.struct((-F.abs("size")).alias("size"), ring.alias("ring")))).alias("p"))
    shapes = shapes.select("component", F.get(F.col("p.ring"), F.lit(0)).alias("ring"), F.transform(F.slice("p", 2, F.size("p")), lambda q: q["ring"]).alias("holes"))
    sizes = areas.groupBy(*keys, "component").agg(F.first("v").alias("value"), F.count("*").alias("pixels"))
    return sizes.join(shapes, "component").select(*keys, "component", "value", "pixels", "ring", "holes")
