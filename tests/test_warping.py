"""Registration recovers planted warps; warping against NumPy."""

from datetime import datetime

import numpy as np
import pytest

from geoloom.operators import tiles, warping

DAYS = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]


def scene(y, x, seed=0):
    """A smooth image, known between its pixels as well."""
    rng = np.random.default_rng(seed)
    return sum(rng.normal() * np.cos(2 * np.pi * (x * rng.uniform(-1, 1) + y * rng.uniform(-1, 1)) / 18 + rng.uniform(0, 6)) for _ in range(8))


def frame_of(m, shape, gain=1.0, offset=0.0, seed=0):
    """The frame in which pixel (x, y) of the scene lies at m (x, y): the scene at the inverse of m."""
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    a = np.linalg.inv(np.array([[m[0], m[1]], [m[3], m[4]]]))
    u = a @ np.stack([(x - m[2]).ravel(), (y - m[5]).ravel()])
    return gain * scene(u[1], u[0], seed).reshape(shape) + offset


def rows(patch, ts, *bands):
    return [(patch, *([ts] if ts else []), y, x, [float(b[y, x]) for b in bands]) for y in range(bands[0].shape[0]) for x in range(bands[0].shape[1])]


TIMED, STILL = "patch_id long, ts timestamp_ntz, y int, x int, bands array<double>", "patch_id long, y int, x int, bands array<double>"
TURN = 0.05
PLANTED = {
    "translation": [[1, 0, 1.5, 0, 1, -2.25], [1, 0, 0, 0, 1, 0], [1, 0, -3.0, 0, 1, 1.0]],
    "rigid": [[np.cos(TURN), -np.sin(TURN), 1.0, np.sin(TURN), np.cos(TURN), -0.5], [np.cos(TURN), np.sin(TURN), -1.0, -np.sin(TURN), np.cos(TURN), 2.0]],
    "affine": [[1.03, 0.02, -0.8, -0.01, 0.98, 1.2], [0.97, -0.03, 1.0, 0.03, 1.02, -1.0], [1, 0, 0.5, 0, 1, 0.5]],
}


@pytest.mark.parametrize("kind", warping.KINDS)
def test_planted_warps_are_found(spark, kind):
    """Over several tiles, with another gain and offset."""
    shape = (45, 50)
    fixed = spark.createDataFrame(rows(1, None, scene(*np.mgrid[: shape[0], : shape[1]])), STILL)
    moving = spark.createDataFrame([r for t, m in zip(DAYS, PLANTED[kind], strict=False) for r in rows(1, t, frame_of(m, shape, 1.7, -3.0))], TIMED)
    out = {r["ts"]: r for r in warping.estimate_warps(moving, fixed, kind, side=24, reach=10).collect()}
    for t, m in zip(DAYS, PLANTED[kind], strict=False):
        assert out[t]["found"] and np.allclose(out[t]["matrix"], m, atol=[0.004, 0.004, 0.08, 0.004, 0.004, 0.08]), (m, out[t]["matrix"])


def test_invalid_pixels_far_shifts_and_flat_frames(spark):
    shape, m = (40, 40), [1, 0, 1.0, 0, 1, 2.0]
    y, x = np.mgrid[:40, :40]
    spoiled = frame_of(m, shape)
    spoiled[5:25, 5:20] = 50.0
    fixed = spark.createDataFrame(rows(1, None, scene(y, x)) + rows(2, None, scene(y, x)), STILL)
    moving = spark.createDataFrame(rows(1, DAYS[0], spoiled) + rows(1, DAYS[1], np.ones(shape)) + rows(2, DAYS[0], frame_of([1, 0, 3, 0, 1, 3], shape)), TIMED)
    valid = spark.createDataFrame([(p, int(i), int(j)) for p in (1, 2) for i in range(40) for j in range(40) if not (3 <= i < 27 and 3 <= j < 22)], "patch_id long, y int, x int")
    out = {(r["patch_id"], r["ts"]): r for r in warping.estimate_warps(moving, fixed, "translation", valid=valid, blur=3, max_translation=4.0).collect()}
    assert out[1, DAYS[0]]["found"] and np.allclose(out[1, DAYS[0]]["matrix"], m, atol=0.05)
    for key in ((1, DAYS[1]), (2, DAYS[0])):  # no texture; a shift of 4.2
        assert not out[key]["found"] and out[key]["matrix"] == warping.IDENTITY
    with pytest.raises(ValueError, match="unknown warp"):
        warping.estimate_warps(moving, fixed, "bend")


def plain_warp(a, m, method, border, value):
    h, w = a.shape
    out = np.full((h, w), np.nan)
    for y in range(h):
        for x in range(w):
            px, py = m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]
            if border == "constant" and not (0 <= px <= w - 1 and 0 <= py <= h - 1):
                out[y, x] = np.nan if value is None else value
                continue
            if border == "reflect":
                px, py = (abs((p + n - 1) % (2 * (n - 1)) - (n - 1)) for p, n in ((px, w), (py, h)))
            px, py = min(max(px, 0), w - 1), min(max(py, 0), h - 1)
            if method == "nearest":
                out[y, x] = a[int(np.floor(py + 0.5)), int(np.floor(px + 0.5))]
            else:
                x0, y0 = min(int(px), w - 2), min(int(py), h - 2)
                fx, fy = px - x0, py - y0
                out[y, x] = (a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy
    return out


@pytest.mark.parametrize("border", warping.BORDERS)
@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_warping_over_tiles(spark, method, border):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 13, 17))
    m = [0.97, 0.11, -1.3, -0.08, 1.05, 0.7]
    df = spark.createDataFrame(rows(1, DAYS[0], a, b) + rows(1, DAYS[1], a, b), TIMED)
    warps = spark.createDataFrame([(1, DAYS[0], [float(v) for v in m])], "patch_id long, ts timestamp_ntz, matrix array<double>")
    for value in (None, -9.0):
        out = warping.warp(df, warps, method, border, value, side=6).collect()
        assert len(out) == 2 * a.size
        for k, image in enumerate((a, b)):
            want = {DAYS[0]: plain_warp(image, m, method, border, value), DAYS[1]: image}
            for r in out:
                v, w = r["bands"][k], want[r["ts"]][r["y"], r["x"]]
                assert (v is None) == bool(np.isnan(w)) and (v is None or abs(v - w) < 1e-9)
    with pytest.raises(ValueError, match="unknown method"):
        warping.warp(df, warps, "cubic")


def test_registered_frames_match_their_reference(spark):
    """The warp that was found brings a frame back onto its reference."""
    shape, m = (32, 32), PLANTED["affine"][0]
    want = scene(*np.mgrid[:32, :32])
    fixed = spark.createDataFrame(rows(1, None, want), STILL)
    moving = spark.createDataFrame(rows(1, DAYS[0], frame_of(m, shape)), TIMED)
    (back,) = warping.apply_to([moving], warping.estimate_warps(moving, fixed), border="constant")
    gaps = [abs(r["bands"][0] - want[r["y"], r["x"]]) for r in back.collect() if r["bands"][0] is not None]
    assert len(gaps) > 800 and np.median(gaps) < 0.1 * np.std(want) and tiles.SIDE > 32
