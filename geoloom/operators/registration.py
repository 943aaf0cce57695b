"""Co-registration: the shift of each frame against a reference frame, and moving frames by it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.layout import pixels_to_frames


def shift_between(reference: np.ndarray, image: np.ndarray) -> tuple[float, float]:
    """(dy, dx) by which the image has to move onto the reference: phase correlation, refined by a parabola at the peak."""
    a, b = (np.fft.fft2(v - v.mean()) for v in (reference, image))
    cross = a * np.conj(b)
    size = np.abs(cross)
    if size.max() < 1e-12:
        return 0.0, 0.0
    c = np.fft.ifft2(cross / np.maximum(size, 1e-9 * size.max())).real
    peak = np.unravel_index(np.argmax(c), c.shape)
    out = []
    for axis, n in enumerate(c.shape):
        at = [int(p) for p in peak]
        lo, hi = at.copy(), at.copy()
        lo[axis], hi[axis] = (at[axis] - 1) % n, (at[axis] + 1) % n
        l, m, h = c[tuple(lo)], c[tuple(at)], c[tuple(hi)]
        bend = l - 2 * m + h
        fine = 0.5 * (l - h) / bend if abs(bend) > 1e-12 and n > 2 else 0.0
        out.append((at[axis] + n // 2) % n - n // 2 + (fine if abs(fine) < 0.5 and abs(fine) > 0.05 else 0.0))
    return float(out[0]), float(out[1])


def estimate_shifts(pixels: DataFrame, reference: DataFrame, channel: int = 0, max_translation: float = 5.0) -> DataFrame:
    """patch_id, ts, dy, dx of each frame; no shift where it would be larger than max_translation.

    A frame meets its patch's reference frame by a join on the patch; the kernel sees one frame of a patch at a time.
    """
    band = lambda df: df.withColumn("bands", F.array(F.element_at("bands", channel + 1).cast("double")))
    frames = pixels_to_frames(band(pixels))
    fixed = pixels_to_frames(band(reference)).select("patch_id", F.col("data").alias("fixed"))

    def run(batches):
        for pdf in batches:
            rows = []
            for h, w, data, want in zip(pdf["h"], pdf["w"], pdf["data"], pdf["fixed"], strict=True):
                dy, dx = shift_between(np.nan_to_num(np.asarray(want, float)).reshape(h, w), np.nan_to_num(np.asarray(data, float)).reshape(h, w))
                rows.append((dy, dx) if math.hypot(dy, dx) <= max_translation else (0.0, 0.0))
            yield pd.DataFrame({"patch_id": pdf["patch_id"], "ts": pdf["ts"], "dy": [r[0] for r in rows], "dx": [r[1] for r in rows]})

    return frames.join(fixed, "patch_id").select("patch_id", "ts", "h", "w", "data", "fixed").mapInPandas(run, "patch_id long, ts timestamp_ntz, dy double, dx double")


def move(pixels: DataFrame, shifts: DataFrame) -> DataFrame:
    """Frames moved by their shifts, linear between pixels; what comes from outside is missing (null)."""
    keys = ["patch_id", "ts"]
    rows = pixels.join(shifts, keys)
    y0, x0 = F.floor("dy").cast("int"), F.floor("dx").cast("int")
    fy, fx = F.col("dy") - y0, F.col("dx") - x0
    part = lambda iy, ix: F.struct((F.col("y") + y0 + iy).alias("y"), (F.col("x") + x0 + ix).alias("x"), ((fy if iy else 1 - fy) * (fx if ix else 1 - fx)).alias("weight"))
    sent = rows.select(*keys, "bands", F.explode(F.array(*(part(i, j) for i in (0, 1) for j in (0, 1)))).alias("p")).select(*keys, "p.*", F.posexplode("bands").alias("b", "v")).where("weight > 0")
    moved = sent.groupBy(*keys, "y", "x", "b").agg(F.when(F.sum("weight") > 0.999, F.sum(F.col("v") * F.col("weight"))).alias("v"))
    bands = moved.groupBy(*keys, "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda p: p["v"]).alias("moved"))
    return pixels.join(bands, [*keys, "y", "x"], "left").withColumn("bands", F.coalesce("moved", F.transform("bands", lambda v: F.lit(None).cast("double")))).drop("moved")
