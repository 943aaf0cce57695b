"""A blocked layout of images: tiles of SIDE by SIDE pixels, of which only borders are exchanged.

Pixel rows (keys, y, x, v) are gathered to tiles with map-side combining, so what is shuffled is a few rows for each tile; pixels
within `reach` of a border also go to the tiles beyond it. Kernels then work on stacks of equal tiles with NumPy. An image has one
row for each pixel; pixels that aren't there don't count, and nulls are known to the kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 64
#: Numbers that a kernel takes at once.
STACK = 1 << 21
NUMPY = {"tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64, "boolean": np.bool_}

Offsets = list[tuple[int, int]]
#: (values, whether a pixel is there, whether it has a value) -> (values, whether they are known); stacks of tiles.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def schema_of(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def gathered(df: DataFrame, reach: int = 0, side: int = SIDE) -> DataFrame:
    """keys, ty, tx and pixels (i, v): a tile's own pixels and those within reach of it; i is the place in the widened tile.

    A tile that has no pixels of its own is left out.
    """
    keys = [c for c in df.columns if c not in ("y", "x", "v")]
    whole = lambda c, by=0: F.floor((F.col(c) + by) / side).cast("int")
    span = lambda c: F.sequence(F.greatest(whole(c, -reach), F.least(whole(c), F.lit(0))), whole(c, reach))
    rows = df.select("*", F.explode(span("y")).alias("ty")).select("*", F.explode(span("x")).alias("tx")) if reach else df.withColumns({"ty": whole("y"), "tx": whole("x")})
    i = (F.col("y") - F.col("ty") * side + reach) * (side + 2 * reach) + F.col("x") - F.col("tx") * side + reach
    tiles = rows.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct(i.cast("int").alias("i"), "v")).alias("pixels"), F.bool_or((whole("y") == F.col("ty")) & (whole("x") == F.col("tx"))).alias("_own"))
    return tiles.where("_own").drop("_own")


def stacks(batch: pa.RecordBatch, width: int, dtype: type, most: int = STACK) -> Iterator[tuple[int, int, tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (first and last tile) of a batch as stacks: the corner of the box that has pixels, values, there and known."""
    lists = batch.column("pixels")
    offsets = lists.offsets.to_numpy()
    i, v = (lists.values.field(k) for k in (0, 1))
    place, known = i.to_numpy(zero_copy_only=False), ~v.is_null().to_numpy(zero_copy_only=False)
    v = v.fill_null(False if dtype is np.bool_ else 0).to_numpy(zero_copy_only=False).astype(dtype)
    step = max(1, most // (width * width))
    for a in range(0, batch.num_rows, step):
        b = min(a + step, batch.num_rows)
        own = slice(offsets[a], offsets[b])
        tile = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        y, x = np.divmod(place[own], width)
        y0, x0 = (int(c.min(initial=width)) for c in (y, x))
        shape = (b - a, int(y.max(initial=y0)) - y0 + 1, int(x.max(initial=x0)) - x0 + 1)
        values, there, ok = np.zeros(shape, dtype), np.zeros(shape, bool), np.zeros(shape, bool)
        at = (tile, y - y0, x - x0)
        values[at], there[at], ok[at] = v[own], True, known[own]
        yield a, b, (y0, x0), values, there, ok


def as_arrow(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values, mask=None if known.all() else ~known)


def tile_map(df: DataFrame, reach: int, kernel: Kernel, side: int = SIDE) -> DataFrame:
    """df (keys, y, x, v) with each pixel's v worked out by the kernel from the pixels within reach of it."""
    keys = [c for c in df.columns if c not in ("y", "x", "v")]
    names, dtype, width = [*keys, "y", "x", "v"], NUMPY[df.schema["v"].dataType.simpleString()], side + 2 * reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ty, tx = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ty", "tx"))
            for a, b, (y0, x0), values, there, known in stacks(batch, width, dtype):
                out, ok = kernel(values, there, known)
                rows, cols = np.arange(values.shape[1]) + y0 - reach, np.arange(values.shape[2]) + x0 - reach
                own = there & ((rows >= 0) & (rows < side))[:, None] & ((cols >= 0) & (cols < side))
                tile, y, x = np.nonzero(own)
                y, x = ty[a + tile] * side + rows[y], tx[a + tile] * side + cols[x]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(a + tile)) for k in keys), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), as_arrow(out[own], ok[own])], names=names)

    out = gathered(df.withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")}), reach, side).mapInArrow(run, f"{schema_of(df, keys)}{', ' * bool(keys)}y int, x int, v {df.schema['v'].dataType.simpleString()}")
    return out.select(*(F.col(c).cast(df.schema[c].dataType) if c in ("y", "x") else c for c in df.columns))


def running(a: np.ndarray, width: int, f: Callable, axis: int) -> np.ndarray:
    """f over each `width` neighbours along an axis, by doubling: as many passes as the width has binary digits."""
    n, at = a.shape[axis], 1
    cut = lambda x, lo, hi: np.take(x, range(lo, hi), axis) if axis == 0 else x[(slice(None),) * axis + (slice(lo, hi),)]
    while 2 * at <= width:
        size = a.shape[axis]
        a = f(cut(a, 0, size - at), cut(a, at, size))
        at *= 2
    rest = n - width + 1
    return f(cut(a, 0, rest), cut(a, width - at, width - at + rest)) if width > at else a


def spans(offsets: Offsets) -> dict[int, list[tuple[int, int]]]:
    """For each row of an element its runs (first and last column)."""
    out: dict[int, list[tuple[int, int]]] = {}
    for dy, dx in sorted(set(offsets)):
        runs = out.setdefault(dy, [])
        if runs and runs[-1][1] == dx - 1:
            runs[-1] = (runs[-1][0], dx)
        else:
            runs.append((dx, dx))
    return out


def reach_of(offsets: Offsets) -> int:
    return max((max(abs(dy), abs(dx)) for dy, dx in offsets), default=0)


def over_element(a: np.ndarray, offsets: Offsets, f: Callable, nothing) -> np.ndarray:
    """f over the pixels at the offsets around each pixel of a stack; `nothing` is its neutral element.

    A running f along rows serves every run of the element; a rectangle takes one more along columns.
    """
    r = reach_of(offsets)
    wide = np.pad(a, ((0, 0), (r, r), (r, r)), constant_values=nothing)
    h, w, rows = a.shape[1], a.shape[2], spans(offsets)
    along: dict[int, np.ndarray] = {}
    piece = lambda lo, hi: along.setdefault(hi - lo + 1, running(wide, hi - lo + 1, f, 2) if hi - lo + 1 not in along else None)[:, :, r + lo : r + lo + w]
    first, last = min(rows), max(rows)
    if len(rows) == last - first + 1 and len({tuple(x) for x in rows.values()}) == 1 and len(rows[first]) == 1:
        return running(piece(*rows[first][0]), last - first + 1, f, 1)[:, r + first : r + first + h]
    out = np.full_like(a, nothing)
    for dy, runs in rows.items():
        for lo, hi in runs:
            out = f(out, piece(lo, hi)[:, r + dy : r + dy + h])
    return out


def extreme(values: np.ndarray, known: np.ndarray, offsets: Offsets, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Largest or smallest known value at the offsets; NaN is larger than all numbers."""
    if not offsets:
        return values, np.zeros_like(known)
    if values.dtype == bool:
        f, nothing = (np.logical_or, False) if largest else (np.logical_and, True)
    elif np.issubdtype(values.dtype, np.integer):
        f, nothing = (np.maximum, np.iinfo(values.dtype).min) if largest else (np.minimum, np.iinfo(values.dtype).max)
    else:
        f, nothing = (np.maximum, -np.inf) if largest else (np.fmin, np.nan)
    out = over_element(np.where(known, values, values.dtype.type(nothing)), offsets, f, nothing)
    return out, known if known.all() else over_element(known, offsets, np.logical_or, False)


def mean(values: np.ndarray, known: np.ndarray, offsets: Offsets) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the known values at the offsets."""
    r = reach_of(offsets)
    wide = lambda a: np.pad(a, ((0, 0), (r, r), (r, r)))
    v, k = wide(np.where(known, values, 0).astype(float)), wide(known.astype(np.int32))
    h, w = values.shape[1:]
    total, n = np.zeros(values.shape), np.zeros(values.shape, np.int32)
    for dy, dx in offsets:
        at = (slice(None), slice(r + dy, r + dy + h), slice(r + dx, r + dx + w))
        total += v[at]
        n += k[at]
    return total / np.maximum(n, 1), n > 0


def taps(new: np.ndarray, size: int, new_size: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Old pixels (new pixels by taps) along one axis that new ones take their value from, and the weights."""
    if method == "nearest":
        return np.minimum(new * size // new_size, size - 1)[:, None], np.ones((len(new), 1))
    centre = np.clip((new + 0.5) * size / new_size - 0.5, 0, size - 1)
    low = np.floor(centre).astype(np.int64)
    part = centre - low
    if method == "linear":
        return np.minimum(low[:, None] + [0, 1], size - 1), np.stack([1 - part, part], 1)
    far = np.abs(part[:, None] - [-1, 0, 1, 2])
    near = 1.5 * far**3 - 2.5 * far**2 + 1  # Keys' kernel with a = -0.5
    weight = np.where(far <= 1, near, np.where(far < 2, -0.5 * far**3 + 2.5 * far**2 - 4 * far + 2, 0.0))
    return np.clip(low[:, None] + [-1, 0, 1, 2], 0, size - 1), weight


def resized(df: DataFrame, sizes_of: Callable[[DataFrame], DataFrame], method: str, side: int = SIDE) -> DataFrame:
    """Images of a new size. sizes_of: adds new_h and new_w to (keys, h, w), a row for each image.

    An old tile sends each new tile the rows and columns that the new one takes values from, so a new tile gets at most four old
    rows and columns for each of its own, however much larger the old image is.
    """
    keys = [c for c in df.columns if c not in ("y", "x", "v")]
    kind = df.schema["v"].dataType.simpleString()
    dtype, result = NUMPY[kind], kind if method == "nearest" else "double"
    tiles = gathered(df, 0, side)
    last = F.array_max(F.transform("pixels", lambda p: p["i"] % side))
    ends = tiles.groupBy(*keys).agg(F.max(F.col("ty") * side + F.expr(f"array_max(pixels.i) div {side}") + 1).cast("int").alias("h"), F.max(F.col("tx") * side + last + 1).cast("int").alias("w"))
    sizes = sizes_of(ends)
    same = None
    for k in keys:
        one = F.col(f"_of_{k}").eqNullSafe(F.col(k))
        same = one if same is None else same & one
    sizes = sizes.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(F.col(c).cast("int") for c in ("h", "w", "new_h", "new_w")))
    placed = (tiles.join(sizes, same) if keys else tiles.crossJoin(F.broadcast(sizes))).select(*keys, "ty", "tx", "pixels", "h", "w", "new_h", "new_w")
    four = ["h", "w", "new_h", "new_w"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[tuple, list] = {}

        def targets(at: int, size: int, new_size: int) -> list[tuple[int, np.ndarray]]:
            """New tiles along an axis that want pixels of the old tile at `at`, and which."""
            if (at, size, new_size) not in wanted:
                lo, hi = at * side, min((at + 1) * side, size)
                a = max(0, int((lo - 3) * new_size / size) - 2)
                b = min(new_size, int((hi + 3) * new_size / size) + 3)
                found = []
                for t in range(a // side, (max(b, 1) - 1) // side + 1):
                    index, weight = taps(np.arange(t * side, min((t + 1) * side, new_size)), size, new_size, method)
                    use = np.unique(index[weight != 0])
                    use = use[(use >= lo) & (use < hi)]
                    if len(use):
                        found.append((t, use - lo))
                if len(wanted) > 10_000:
                    wanted.clear()
                wanted[at, size, new_size] = found
            return wanted[at, size, new_size]

        for batch in batches:
            ty, tx, *size = (batch.column(c).to_pylist() for c in ("ty", "tx", *four))
            for a, b, (y0, x0), values, there, known in stacks(batch, side, dtype):
                out: list[tuple] = []
                for k in range(a, b):
                    h, w, new_h, new_w = (s[k] for s in size)
                    for nty, rows in targets(ty[k], h, new_h) if new_h > 0 and new_w > 0 else []:
                        rows = rows[(rows >= y0) & (rows < y0 + values.shape[1])]
                        for ntx, cols in targets(tx[k], w, new_w):
                            cols = cols[(cols >= x0) & (cols < x0 + values.shape[2])]
                            at = np.ix_(rows - y0, cols - x0)
                            out.append((k, nty, ntx, (rows + ty[k] * side).astype(np.int32), (cols + tx[k] * side).astype(np.int32), as_arrow(values[k - a][at].ravel(), (known & there)[k - a][at].ravel())))
                if out:
                    part = [pa.array([o[c] for o in out], pa.int32()) for c in (1, 2)]
                    lists = [pa.array([o[c] for o in out], pa.list_(pa.int32())) for c in (3, 4)]
                    data = pa.ListArray.from_arrays(np.cumsum([0, *(len(o[5]) for o in out)]).astype(np.int32), pa.concat_arrays([o[5] for o in out]))
                    of = pa.array([o[0] for o in out])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in (*keys, *four)), *part, *lists, data], names=[*keys, *four, "ty", "tx", "rows", "cols", "data"])

    sent = placed.mapInArrow(send, f"{schema_of(placed, [*keys, *four])}, ty int, tx int, rows array<int>, cols array<int>, data array<{kind}>")
    met = sent.groupBy(*keys, *four, "ty", "tx").agg(F.collect_list(F.struct("rows", "cols", "data")).alias("parts"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ty, tx, *size = (batch.column(c).to_pylist() for c in ("ty", "tx", *four))
            for k in range(batch.num_rows):
                h, w, new_h, new_w = (s[k] for s in size)
                ny, nx = np.arange(ty[k] * side, min((ty[k] + 1) * side, new_h)), np.arange(tx[k] * side, min((tx[k] + 1) * side, new_w))
                (iy, wy), (ix, wx) = taps(ny, h, new_h, method), taps(nx, w, new_w, method)
                used_y, used_x = np.unique(iy[wy != 0]), np.unique(ix[wx != 0])
                old, ok = np.zeros((len(used_y), len(used_x)), dtype), np.zeros((len(used_y), len(used_x)), bool)
                parts = batch.column("parts")[k].values
                for rows, cols, data in zip(*(parts.field(c) for c in (0, 1, 2)), strict=True):
                    at = np.ix_(np.searchsorted(used_y, rows.values.to_numpy()), np.searchsorted(used_x, cols.values.to_numpy()))
                    v = data.values
                    ok[at] = (~v.is_null().to_numpy(zero_copy_only=False)).reshape(len(rows), len(cols))
                    old[at] = v.fill_null(False if dtype is np.bool_ else 0).to_numpy(zero_copy_only=False).reshape(len(rows), len(cols))
                py, px = (np.minimum(np.searchsorted(u, i), len(u) - 1) for u, i in ((used_y, iy), (used_x, ix)))
                if method == "nearest":
                    at = np.ix_(py[:, 0], px[:, 0])
                    new, fine = old[at], ok[at]
                else:
                    along_y, along_x = scattered(py, wy, len(used_y)), scattered(px, wx, len(used_x))
                    new = along_y @ np.where(ok, old, 0).astype(float) @ along_x.T
                    fine = np.ones(new.shape, bool) if ok.all() else (along_y != 0).astype(float) @ ok.astype(float) @ (along_x != 0).astype(float).T > 0
                n = new.size
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c).take(pa.array(np.zeros(n, np.int64))) for c in keys), pa.array(np.repeat(ny, len(nx)).astype(np.int32)), pa.array(np.tile(nx, len(ny)).astype(np.int32)), as_arrow(new.ravel(), fine.ravel())], names=[*keys, "y", "x", "v"])

    return met.mapInArrow(meet, f"{schema_of(placed, keys)}{', ' * bool(keys)}y int, x int, v {result}")


def scattered(place: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weights of each new pixel (row) at its old pixels, as a matrix."""
    out = np.zeros((len(place), n))
    np.add.at(out, (np.arange(len(place))[:, None], place), weight)
    return out
