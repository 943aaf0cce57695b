"""Curves through the points of one series (x increasing): natural cubic, interpolating B-spline, Akima, Gaussian process."""

from __future__ import annotations

import numpy as np


def tridiagonal(middle: np.ndarray, side: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric tridiagonal system, by elimination: time and memory grow with its length alone."""
    d, r = middle.astype(float).tolist(), right.astype(float).tolist()
    e = side.astype(float).tolist()
    for k in range(1, len(d)):
        w = e[k - 1] / d[k - 1]
        d[k] -= w * e[k - 1]
        r[k] -= w * r[k - 1]
    for k in range(len(d) - 1, -1, -1):
        r[k] = (r[k] - (e[k] * r[k + 1] if k + 1 < len(d) else 0)) / d[k]
    return np.array(r)


def banded(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a banded system by elimination without exchanges; time and memory grow with its length alone.

    bands: row i holds the entries of columns i - w to i + w, w = bands.shape[1] // 2; right: one or more right sides (columns).
    The systems of cubic and B-splines need no exchanges.
    """
    w, n = bands.shape[1] // 2, len(bands)
    a, r = bands.astype(float), right.astype(float).reshape(n, -1)
    for k in range(n):
        for i in range(k + 1, min(k + w + 1, n)):
            f = a[i, k - i + w] / a[k, w]
            if f:
                a[i, k - i + w : k - i + 2 * w + 1] -= f * a[k, w:]
                r[i] -= f * r[k]
    for k in range(n - 1, -1, -1):
        last = min(k + w, n - 1)
        r[k] = (r[k] - a[k, w + 1 : w + 1 + last - k] @ r[k + 1 : last + 1]) / a[k, w]
    return r.reshape(right.shape)


class Cubic:
    """The natural cubic spline as a banded system for second derivatives; a part of a series is worked on alone."""

    width = 1
    #: Points beyond a part that its rows and values need.
    halo = 2

    def __init__(self, degree: int = 3):
        pass

    def rows(self, x: np.ndarray, y: np.ndarray, at: int, n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Bands and right side of the points `first` to `last` (counted in the series of n); x and y begin with point `at`."""
        g = np.arange(first, last + 1)
        inner = (g > 0) & (g < n - 1)
        k = np.clip(g - at, 1, max(len(x) - 2, 1))
        if len(x) < 3:
            return np.tile([0.0, 1.0, 0.0], (len(g), 1)), np.zeros(len(g))
        before, after = x[k] - x[k - 1], x[k + 1] - x[k]
        bands = np.stack([before, 2 * (before + after), after], 1)
        right = 6 * ((y[k + 1] - y[k]) / after - (y[k] - y[k - 1]) / before)
        return np.where(inner[:, None], bands, [0.0, 1.0, 0.0]), np.where(inner, right, 0.0)

    def values(self, x: np.ndarray, y: np.ndarray, at: int, n: int, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Values at t of the curve with coefficients c, which belong to the points x (NaN where they aren't known)."""
        if len(x) < 2:
            return np.full(len(t), y[0])
        k = np.clip(np.searchsorted(x, t, "right") - 1, 0, len(x) - 2)
        h, u, w = x[k + 1] - x[k], t - x[k], x[k + 1] - t
        curve = (c[k] * w**3 + c[k + 1] * u**3) / (6 * h) + (y[k] / h - c[k] * h / 6) * w + (y[k + 1] / h - c[k + 1] * h / 6) * u
        return np.where(t == x[k], y[k], np.where(t == x[k + 1], y[k + 1], curve))


class Spline:
    """The interpolating B-spline with knots at averages of `degree` neighbouring points, as a banded system for its coefficients."""

    def __init__(self, degree: int = 3):
        self.degree, self.width, self.halo = degree, degree, 2 * degree + 2

    def knots(self, x: np.ndarray, at: int, n: int, q: np.ndarray, p: int) -> np.ndarray:
        """Knots with numbers q; those that would need points outside x come from what is there and aren't used."""
        if not p:
            return np.where(q < n, x[np.clip(q - at, 0, len(x) - 1)], x[-1])
        sums = np.concatenate([[0.0], np.cumsum(x - x[0])])
        lo = np.clip(q - p - at, 0, max(len(x) - p, 0))
        mean = x[0] + (sums[np.minimum(lo + p, len(x))] - sums[lo]) / p
        return np.where(q <= p, x[0], np.where(q >= n, x[-1], mean))

    def basis(self, x: np.ndarray, at: int, n: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each t the number of its first basis function that isn't zero, and the values of the degree + 1 from there."""
        p = min(self.degree, n - 1)
        q = np.arange(max(at, 0), at + len(x) + p + 1)
        knot = self.knots(x, at, n, q, p)
        low, high = max(p - q[0], 0), max(min(n - 1, at + len(x) - 1) - q[0], 0)
        k = np.clip(np.searchsorted(knot[: high + 1], t, "right") - 1, low, high)
        b = np.zeros((len(t), p + 1))
        b[:, 0] = 1
        knot_at = lambda i: knot[np.clip(i, 0, len(knot) - 1)]
        for d in range(1, p + 1):  # de Boor's recurrence on the functions that aren't zero
            saved = np.zeros(len(t))
            for r in range(d):
                right, left = knot_at(k + r + 1) - t, t - knot_at(k + 1 - d + r)
                part = b[:, r] / np.where(right + left == 0, 1, right + left)
                b[:, r] = saved + right * part
                saved = left * part
            b[:, d] = saved
        return k + q[0] - p, b

    def rows(self, x: np.ndarray, y: np.ndarray, at: int, n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        g, own = np.arange(first, last + 1), slice(first - at, last + 1 - at)
        j, b = self.basis(x, at, n, x[own])
        bands = np.zeros((len(g), 2 * self.width + 1))
        for k in range(b.shape[1]):
            place = j + k - g + self.width
            fits = (place >= 0) & (place <= 2 * self.width)
            bands[np.flatnonzero(fits), place[fits]] += b[fits, k]
        return bands, y[own]

    def values(self, x: np.ndarray, y: np.ndarray, at: int, n: int, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        j, b = self.basis(x, at, n, t)
        return sum(b[:, k] * c[np.clip(j + k - at, 0, len(c) - 1)] for k in range(b.shape[1]))


def cubic(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The natural cubic spline."""
    return whole(Cubic(), x, y, t)


def spline(x: np.ndarray, y: np.ndarray, t: np.ndarray, degree: int = 3, smoothing: float = 0.0) -> np.ndarray:
    """The B-spline with knots at averages of `degree` neighbouring points.

    smoothing: the sum of squared residuals that is allowed. 0 interpolates; where the regression polynomial of this degree has
    no more residuals than that, it is the curve; in between the jumps of the highest derivative are penalised just as much as
    the residuals allow.
    """
    t = np.clip(t, x[0], x[-1])
    return smoothed(x, y, t, degree, smoothing) if smoothing > 0 and len(x) > degree + 1 else whole(Spline(degree), x, y, t)


def jumps(knot: np.ndarray, n: int, p: int) -> np.ndarray:
    """Rows of p + 2 weights: the jump of the p-th derivative at each inner knot, of coefficients k to k + p + 1."""
    rows = np.ones((n, 1))
    for r in range(1, p + 1):
        j = np.arange(r, n)
        step = (p - r + 1) / (knot[j + p - r + 1] - knot[j])
        rows = (np.pad(rows[1:], ((0, 0), (1, 0))) - np.pad(rows[:-1], ((0, 0), (0, 1)))) * step[:, None]
    return np.pad(rows[1:], ((0, 0), (1, 0))) - np.pad(rows[:-1], ((0, 0), (0, 1)))


def gram(rows: np.ndarray, first: np.ndarray, n: int, w: int) -> np.ndarray:
    """Bands of A^T A for rows that hold consecutive entries from column `first`."""
    out = np.zeros((n, 2 * w + 1))
    for a in range(rows.shape[1]):
        for b in range(rows.shape[1]):
            np.add.at(out, (first + a, b - a + w), rows[:, a] * rows[:, b])
    return out


def smoothed(x: np.ndarray, y: np.ndarray, t: np.ndarray, degree: int, smoothing: float) -> np.ndarray:
    """Penalised least squares with a banded system; memory grows with the number of points alone."""
    n, p, curve = len(x), degree, Spline(degree)
    u, v = (x - x[0]) / (x[-1] - x[0]), (t - x[0]) / (x[-1] - x[0])
    line = np.polynomial.Polynomial.fit(u, y, p)
    if ((line(u) - y) ** 2).sum() <= smoothing:
        return line(v)
    first, rows = curve.basis(u, 0, n, u)
    knot = curve.knots(u, 0, n, np.arange(n + p + 1), p)
    penalty, w = jumps(knot, n, p), p + 1
    penalty = penalty / max(np.abs(penalty).max(), 1e-300)
    fit, bend = gram(rows, first, n, w), gram(penalty, np.arange(len(penalty)), n, w)
    right = np.zeros(n)
    for k in range(rows.shape[1]):
        np.add.at(right, first + k, rows[:, k] * y)
    at = lambda c, j, b: sum(b[:, k] * c[j + k] for k in range(b.shape[1]))

    def coefficients(weight: float) -> tuple[np.ndarray, float]:
        c = banded(fit + weight * bend, right)
        return c, float(((at(c, first, rows) - y) ** 2).sum())

    low, high = -30.0, 30.0  # powers of ten of the penalty's weight; residuals grow with it
    c = None
    for _ in range(80):
        middle = (low + high) / 2
        c, left = coefficients(10.0**middle)
        if abs(left - smoothing) <= 1e-3 * smoothing:
            break
        low, high = (middle, high) if left < smoothing else (low, middle)
    return at(c, *curve.basis(u, 0, n, v))


def whole(curve: Cubic | Spline, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Values of a curve through one whole series."""
    n = len(x)
    return curve.values(x, y, 0, n, banded(*curve.rows(x, y, 0, n, 0, n - 1)), t)


def akima(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Akima's piecewise cubic: slopes at the points weigh the neighbouring slopes by their changes."""
    n = len(x)
    if n < 3:
        return np.interp(t, x, y)
    m = np.diff(y) / np.diff(x)
    m = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    change = np.abs(np.diff(m))
    w1, w2 = change[2:], change[:-2]
    flat = w1 + w2 < 1e-12
    d = np.where(flat, (m[1:-2] + m[2:-1]) / 2, (w1 * m[1:-2] + w2 * m[2:-1]) / np.where(flat, 1, w1 + w2))
    k = np.clip(np.searchsorted(x, t, "right") - 1, 0, n - 2)
    h, u = x[k + 1] - x[k], t - x[k]
    s = (y[k + 1] - y[k]) / h
    return y[k] + u * (d[k] + u * ((3 * s - 2 * d[k] - d[k + 1]) / h + u * (d[k] + d[k + 1] - 2 * s) / h**2))


#: Points up to which a Gaussian process takes a series as a whole, and those around a value that it takes of longer ones.
WHOLE, NEIGHBOURS = 2048, 256
#: Length scales (shares of the series' range) among which the likelihood chooses; the best is refined by a parabola.
LENGTHS = np.geomspace(1e-3, 1.0, 25)


def kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    return np.exp(-0.5 * ((a[:, None] - b) / length) ** 2)


def likelihoods(a: np.ndarray, y: np.ndarray, noise: float, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Log likelihood of values with mean 0 for each of LENGTHS, in blocks of `neighbours` points, each alone."""
    out = np.zeros(len(LENGTHS))
    for k, length in enumerate(LENGTHS):
        for start in range(0, len(a), neighbours):
            p, v = a[start : start + neighbours], y[start : start + neighbours]
            low = np.linalg.cholesky(kernel(p, p, length) + noise * np.eye(len(p)))
            z = np.linalg.solve(low, v)
            size = max(float(z @ z) / len(p), 1e-300)  # the best variance for this length
            out[k] -= len(p) / 2 * np.log(size) + np.log(np.diag(low)).sum()
    return out


def best_length(out: np.ndarray) -> float:
    k = int(np.argmax(out))
    if not 0 < k < len(out) - 1:
        return float(LENGTHS[k])
    bend = out[k - 1] - 2 * out[k] + out[k + 1]
    step = 0.5 * (out[k - 1] - out[k + 1]) / bend if bend < 0 else 0.0
    return float(LENGTHS[k] * (LENGTHS[1] / LENGTHS[0]) ** step)


def near_values(a: np.ndarray, y: np.ndarray, b: np.ndarray, length: float, noise: float, neighbours: int) -> np.ndarray:
    """Means of the process at b, each from the `neighbours` points around it (a rising); memory grows with that number squared."""
    first = np.clip(np.searchsorted(a, b) - neighbours // 2, 0, max(len(a) - neighbours, 0))
    first = first // max(neighbours // 4, 1) * max(neighbours // 4, 1)  # values nearby share a window
    out = np.empty(len(b))
    for at in np.unique(first):
        p, v = a[at : at + neighbours + neighbours // 4], y[at : at + neighbours + neighbours // 4]
        low = np.linalg.cholesky(kernel(p, p, length) + noise * np.eye(len(p)))
        weight = np.linalg.solve(low.T, np.linalg.solve(low, v))
        out[first == at] = kernel(b[first == at], p, length) @ weight
    return out


def kriging(x: np.ndarray, y: np.ndarray, t: np.ndarray, length: float | str = 0.1, noise: float = 1e-6, neighbours: int | None = None) -> np.ndarray:
    """The mean of a Gaussian process with a squared-exponential kernel; time is scaled by the series' range.

    length: a share of the range, or "fit" for the one of largest likelihood. A series of more than WHOLE points, or of more
    than `neighbours`, is worked on by neighbourhoods.
    """
    span, middle = x[-1] - x[0], y.mean()
    a, b = (x - x[0]) / span, (t - x[0]) / span
    near = neighbours or (len(a) if len(a) <= WHOLE else NEIGHBOURS)
    if length == "fit":
        length = best_length(likelihoods(a, y - middle, noise, min(near, NEIGHBOURS)))
    return middle + near_values(a, y - middle, b, float(length), noise, near)


KINDS = {"cubic": cubic, "spline": spline, "kriging": kriging}
#: Curves that long series are cut into parts for.
BANDED = {"cubic": Cubic, "spline": Spline}
