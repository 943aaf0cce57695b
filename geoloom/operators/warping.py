"""Registration by warps, and warping, on tiles.

The warp of a frame (translation, rigid or affine) minimises the squared difference between the warped frame and its reference, up
to a gain and an offset, over the pixels that both know. Each Gauss-Newton round is one aggregation: tiles give sums of normal
equations at the frame's present warp, a frame's sums are added up, and its next warp is solved from them. Tiles of the frame
reach `reach` pixels further than those of the reference, which bounds how far a warp may look.

A warp maps a pixel (x, y) of the reference to where it lies in the frame: [x', y'] = m [x, y, 1], m = (m00, m01, m02, m10, m11, m12).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import tiles
from geoloom.operators.skew import few_rows
from geoloom.session import discard, materialize

FRAME = ["patch_id", "ts"]
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
#: Parameters of each kind of warp, beside gain and offset.
KINDS = {"translation": 2, "rigid": 3, "affine": 6}
BORDERS = ("constant", "replicate", "reflect")


def blurred(df: DataFrame, size: int) -> DataFrame:
    """Means under a Gaussian of size by size pixels (odd) over what is known."""
    if size < 2:
        return df
    sigma, r = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)

    def along(a: np.ndarray, axis: int) -> np.ndarray:
        wide = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(3)])
        return sum(w * (wide[:, k : k + a.shape[1]] if axis == 1 else wide[:, :, k : k + a.shape[2]]) for k, w in enumerate(weight))

    def kernel(v, there, known):
        total, n = (along(along(a, 1), 2) for a in (np.where(known, v, 0.0), known.astype(float)))
        return np.where(n > 0, total / np.where(n > 0, n, 1), 0.0), known

    return tiles.tile_map(df.withColumn("v", F.col("v").cast("double")), r, kernel)


def sampled(image: np.ndarray, known: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, slopes along y and x, and whether they are known, at places of an image, linear between its pixels."""
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    inside = (y0 >= 0) & (x0 >= 0) & (y0 < image.shape[0] - 1) & (x0 < image.shape[1] - 1)
    y0, x0 = np.where(inside, y0, 0), np.where(inside, x0, 0)
    fy, fx = y - y0, x - x0
    a, b, c, d = image[y0, x0], image[y0, x0 + 1], image[y0 + 1, x0], image[y0 + 1, x0 + 1]
    ok = inside & known[y0, x0] & known[y0, x0 + 1] & known[y0 + 1, x0] & known[y0 + 1, x0 + 1]
    top, low = a + (b - a) * fx, c + (d - c) * fx
    return top + (low - top) * fy, low - top, (b - a) * (1 - fy) + (d - c) * fy, ok


def directions(kind: str, m: np.ndarray, x: np.ndarray, y: np.ndarray, gy: np.ndarray, gx: np.ndarray) -> list[np.ndarray]:
    """Change of the warped value with each parameter of the warp."""
    if kind == "translation":
        return [gx, gy]
    if kind == "rigid":
        s, c = m[3], m[0]  # sine and cosine
        return [gx * (-s * x - c * y) + gy * (c * x - s * y), gx, gy]
    return [gx * x, gx * y, gx, gy * x, gy * y, gy]


def moved(kind: str, m: list[float], step: np.ndarray) -> list[float]:
    if kind == "translation":
        return [m[0], m[1], m[2] + step[0], m[3], m[4], m[5] + step[1]]
    if kind == "rigid":
        turn = math.atan2(m[3], m[0]) + step[0]
        return [math.cos(turn), -math.sin(turn), m[2] + step[1], math.sin(turn), math.cos(turn), m[5] + step[2]]
    return [a + b for a, b in zip(m, step, strict=True)]


def paired(frames: DataFrame, reference: DataFrame, reach: int, side: int) -> DataFrame:
    """Tiles of the reference with the widened tiles of each frame."""
    fixed = tiles.gathered(reference.select("patch_id", "y", "x", "v"), 0, side).withColumnRenamed("pixels", "fixed")
    moving = tiles.gathered(frames.select(*FRAME, "y", "x", "v"), reach, side)
    return moving.join(fixed, ["patch_id", "ty", "tx"])


def stack(lists: pa.Array, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and known of tile k."""
    one = lists[k].values
    i, v = one.field(0).to_numpy(), one.field(1)
    values, known = np.zeros(width * width), np.zeros(width * width, bool)
    known[i] = ~v.is_null().to_numpy(zero_copy_only=False)
    values[i] = v.fill_null(0.0).to_numpy(zero_copy_only=False)
    known &= np.isfinite(values)
    return np.where(known, values, 0.0).reshape(width, width), known.reshape(width, width)


def normal_sums(kind: str, tile: tuple, corner: tuple[int, int], m: list[float], reach: int) -> np.ndarray:
    """A tile's part of the normal equations at warp m: products of steps, gain, offset and the frame's value; and the pixels' number.

    v + J step = gain * t + offset at every pixel, so the rows hold J, -t, -1 and v.
    """
    want, ok, image, known = tile
    y, x = (a.astype(float) for a in np.nonzero(ok))
    t, y, x = want[ok], y + corner[0], x + corner[1]
    v, gy, gx, fine = sampled(image, known, m[3] * x + m[4] * y + m[5] - corner[0] + reach, m[0] * x + m[1] * y + m[2] - corner[1] + reach)
    rows = np.stack([*directions(kind, m, x, y, gy, gx), -t, -np.ones_like(t), v])[:, fine]
    return np.append((rows @ rows.T).ravel(), fine.sum())


def next_warp(kind: str, m: list[float], sums: np.ndarray, tolerance: float) -> tuple[list[float], bool, bool]:
    """The warp after a Gauss-Newton step, whether it still moves, and whether the system had a solution."""
    size, free = KINDS[kind] + 2, KINDS[kind]
    full = sums[:-1].reshape(size + 1, size + 1)
    a, b = full[:size, :size], -full[:size, size]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    a = a / np.outer(scale, scale)
    if sums[-1] <= size or not np.isfinite(full).all() or np.linalg.cond(a) > 1e12:
        return m, False, False
    step = (np.linalg.solve(a, b / scale) / scale)[:free]
    return moved(kind, m, step), float(np.abs(step).max()) > tolerance, True


def estimate_warps(pixels: DataFrame, reference: DataFrame, kind: str = "affine", channel: int = 0, valid: DataFrame | None = None, max_translation: float = 5.0, most_rounds: int = 100, tolerance: float = 1e-4, blur: int = 1, start: DataFrame | None = None, reach: int = 16, side: int = tiles.SIDE) -> DataFrame:
    """patch_id, ts, matrix (six numbers) and found of each frame of pixels (patch_id, ts, y, x, bands) against its patch's reference.

    valid: pixels (patch_id, y, x, and ts if they differ by frame) that may count. start: first warps (patch_id, ts, matrix), the
    identity where there are none. found is false and the warp the identity where a frame has too few pixels in common with its
    reference, where the system has no solution, or where the shift of the upper left pixel ends beyond max_translation.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown warp: {kind}")
    band = lambda df: df.withColumn("v", F.element_at("bands", channel + 1).cast("double")).drop("bands")
    frames, fixed = band(pixels), band(reference)
    if valid is not None:
        keys = [*(["ts"] if "ts" in valid.columns else []), "patch_id", "y", "x"]
        marked = valid.select(*keys, F.lit(True).alias("_valid"))
        frames = frames.join(marked, keys, "left").withColumn("v", F.when(F.col("_valid"), F.col("v"))).drop("_valid")
        if "ts" not in valid.columns:
            fixed = fixed.join(marked, keys, "left").withColumn("v", F.when(F.col("_valid"), F.col("v"))).drop("_valid")
    pairs = materialize(paired(blurred(frames, blur), blurred(fixed, blur), reach, side), "pairs")
    size, width = KINDS[kind] + 2, side + 2 * reach
    first = F.array(*(F.lit(v) for v in IDENTITY))
    begin = pairs.select(*FRAME).distinct()
    begin = begin.withColumn("matrix", first) if start is None else begin.join(start.select(*FRAME, "matrix"), FRAME, "left").withColumn("matrix", F.coalesce("matrix", first))
    many = materialize(pairs.groupBy(*FRAME).agg(F.count("*").alias("n")).where("n > 1").select(*FRAME), "frames")
    schema = "patch_id long, ts timestamp_ntz, matrix array<double>, going boolean, found boolean"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rounds of frames of one tile, which no other tile has a part in."""
        for batch in batches:
            ty, tx, m = (batch.column(c).to_pylist() for c in ("ty", "tx", "matrix"))
            found = [False] * batch.num_rows
            for k in range(batch.num_rows):
                tile = (*stack(batch.column("fixed"), k, side), *stack(batch.column("pixels"), k, width))
                for _ in range(most_rounds):
                    m[k], going, found[k] = next_warp(kind, m[k], normal_sums(kind, tile, (ty[k] * side, tx[k] * side), m[k], reach), tolerance)
                    if not going:
                        break
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FRAME), pa.array(m, pa.list_(pa.float64())), pa.array([False] * len(m)), pa.array(found)], names=[*FRAME, "matrix", "going", "found"])

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ty, tx, m = (batch.column(c).to_pylist() for c in ("ty", "tx", "matrix"))
            out = [normal_sums(kind, (*stack(batch.column("fixed"), k, side), *stack(batch.column("pixels"), k, width)), (ty[k] * side, tx[k] * side), m[k], reach).tolist() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FRAME), pa.array(out, pa.list_(pa.float64()))], names=[*FRAME, "s"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [next_warp(kind, list(m), np.asarray(s, float), tolerance) for m, s in zip(pdf["matrix"], pdf["s"], strict=True)]
            yield pd.DataFrame({"patch_id": pdf["patch_id"], "ts": pdf["ts"], "matrix": [n[0] for n in new], "going": [n[1] for n in new], "found": [n[2] for n in new]})

    single = pairs.join(few_rows(many), FRAME, "left_anti").join(begin, FRAME)
    state = materialize(begin.join(few_rows(many), FRAME, "left_semi").withColumns({"going": F.lit(True), "found": F.lit(False)}), "warps")
    for _ in range(most_rounds):
        if state.where("going").isEmpty():
            break
        live = few_rows(state.where("going").select(*FRAME, "matrix"))
        said = pairs.join(live, FRAME).mapInArrow(equations, "patch_id long, ts timestamp_ntz, s array<double>")
        sums = said.groupBy(*FRAME).agg(F.array(*(F.sum(F.get("s", F.lit(k))) for k in range((size + 1) ** 2 + 1))).alias("s"))
        new = materialize(state.where(~F.col("going")).unionByName(sums.join(state.select(*FRAME, "matrix"), FRAME).mapInPandas(solve, schema)), "warps")
        discard(state)
        state = new
    state = state.unionByName(single.mapInArrow(alone, schema))
    fits = F.col("found") & (F.hypot(F.get("matrix", F.lit(2)), F.get("matrix", F.lit(5))) <= max_translation)
    return state.select(*FRAME, F.when(fits, F.col("matrix")).otherwise(first).alias("matrix"), fits.alias("found"))


def folded(at: np.ndarray, n: int, border: str) -> tuple[np.ndarray, np.ndarray]:
    """Places along an axis of n pixels brought inside, and whether they lay there."""
    inside = (at >= 0) & (at <= n - 1)
    if border == "reflect" and n > 1:  # mirrored without the edge pixel
        at = np.abs(np.mod(at + (n - 1), 2 * (n - 1)) - (n - 1))
    return np.clip(at, 0, n - 1), inside | (border != "constant")


def warp(pixels: DataFrame, warps: DataFrame, method: str = "linear", border: str = "constant", value: float | None = None, side: int = tiles.SIDE) -> DataFrame:
    """patch_id, ts, y, x, bands: each frame seen through its warp; frames without one stay as they are.

    method: linear or nearest. border: what lies outside is the value (constant; null is missing), the edge pixel (replicate) or
    mirrored at it (reflect). A tile gets the pixels within the farthest shift of any frame.
    """
    if method not in ("linear", "nearest") or border not in BORDERS:
        raise ValueError(f"unknown method or border: {method}, {border}")
    rows = pixels.select(*FRAME, "y", "x", F.posexplode("bands").alias("b", "v")).withColumn("v", F.col("v").cast("double"))
    sizes = pixels.groupBy(*FRAME).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
    known = sizes.join(warps.select(*FRAME, "matrix"), FRAME, "left").withColumn("matrix", F.coalesce("matrix", F.array(*(F.lit(v) for v in IDENTITY))))
    known = materialize(known, "warps")
    m = lambda k: F.get("matrix", F.lit(k))
    shift = lambda k, p, q: F.greatest(*(F.abs(m(k) * x + m(k + 1) * y + m(k + 2) - p * x - q * y) for x in (F.lit(0), F.col("w") - 1) for y in (F.lit(0), F.col("h") - 1)))
    far = known.agg(F.max(F.greatest(shift(0, 1, 0), shift(3, 0, 1)))).first()[0]  # one number
    reach = int(math.ceil(far or 0)) + 1
    width, keys = side + 2 * reach, [*FRAME, "b"]
    placed = tiles.gathered(rows.select(*keys, "y", "x", "v"), reach, side).join(few_rows(known), FRAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ty, tx, h, w, m = (batch.column(c).to_pylist() for c in ("ty", "tx", "h", "w", "matrix"))
            for k in range(batch.num_rows):
                image, ok = stack(batch.column("pixels"), k, width)
                i = batch.column("pixels")[k].values.field(0).to_numpy()
                y, x = np.divmod(i, width)
                own = (y >= reach) & (y < reach + side) & (x >= reach) & (x < reach + side)
                y, x = y[own] + ty[k] * side - reach, x[own] + tx[k] * side - reach
                a = m[k]
                py, in_y = folded(a[3] * x + a[4] * y + a[5], h[k], border)
                px, in_x = folded(a[0] * x + a[1] * y + a[2], w[k], border)
                qy, qx = py - ty[k] * side + reach, px - tx[k] * side + reach
                if method == "nearest":
                    qy, qx = np.floor(qy + 0.5).astype(int), np.floor(qx + 0.5).astype(int)
                    v, fine = image[np.clip(qy, 0, width - 1), np.clip(qx, 0, width - 1)], ok[np.clip(qy, 0, width - 1), np.clip(qx, 0, width - 1)]
                else:  # neighbours of weight 0 need not be known
                    v, fine = np.zeros(len(qy)), np.ones(len(qy), bool)
                    y0, x0 = np.floor(qy).astype(int), np.floor(qx).astype(int)
                    for dy in (0, 1):
                        for dx in (0, 1):
                            weight = np.abs(1 - dy - (qy - y0)) * np.abs(1 - dx - (qx - x0))
                            cy, cx = np.clip(y0 + dy, 0, width - 1), np.clip(x0 + dx, 0, width - 1)
                            v += np.where(weight > 1e-12, weight * image[cy, cx], 0)
                            fine &= (weight <= 1e-12) | ok[cy, cx]
                inside = in_y & in_x
                if value is not None:
                    v, fine = np.where(inside, v, value), np.where(inside, fine, True)
                else:
                    fine = fine & inside
                n = len(v)
                of = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in keys), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), tiles.as_arrow(v, fine)], names=[*keys, "y", "x", "v"])

    out = placed.mapInArrow(run, "patch_id long, ts timestamp_ntz, b int, y int, x int, v double")
    bands = out.groupBy(*FRAME, "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda p: p["v"]).alias("bands"))
    return bands


def apply_to(frames: Sequence[DataFrame], warps: DataFrame, **options) -> list[DataFrame]:
    """Several features of the same patches seen through one set of warps."""
    return [warp(f, warps, **options) for f in frames]
