"""Arrow-batched numeric kernels.

Each kernel maps an ``array<double>`` column to another one. Spark hands over whole Arrow
batches; numpy works on the (rows x channels) matrix of a batch, so no Python code runs per
row. Rows that are null or of the wrong width come out null; NaN survives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

Matrix = np.ndarray


def to_matrix(column: pa.Array, width: int) -> tuple[Matrix, np.ndarray]:
    """Rows of exactly ``width`` values as a matrix, and the mask of those rows."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    flat = column.filter(good).flatten().cast(pa.float64())
    return (
        flat.to_numpy(zero_copy_only=False).reshape(-1, width),
        good.to_numpy(zero_copy_only=False).astype(bool),
    )


def from_matrix(m: Matrix, good: np.ndarray) -> pa.Array:
    """Inverse of :func:`to_matrix`: null where ``good`` is false."""
    m = np.ascontiguousarray(m, dtype=np.float64)
    steps = np.where(good, m.shape[1] if m.ndim == 2 else 0, 0)
    offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(m.ravel()), mask=pa.array(~good)
    )


def array_kernel(fn: Callable[[Matrix], Matrix], width: int):
    """A Column function applying ``fn`` to the batch matrix of one array column."""

    @F.arrow_udf("array<double>")
    def kernel(column: pa.Array) -> pa.Array:
        m, good = to_matrix(column, width)
        if not len(m):
            return pa.nulls(len(column), pa.list_(pa.float64()))
        return from_matrix(fn(m), good)

    return kernel


def keyed_kernel(fn: Callable[[Matrix, np.ndarray], Matrix], width: int):
    """As :func:`array_kernel`, with a 64-bit key per row that drives its random draws."""

    @F.arrow_udf("array<double>")
    def kernel(column: pa.Array, key: pa.Array) -> pa.Array:
        m, good = to_matrix(column, width)
        if not len(m):
            return pa.nulls(len(column), pa.list_(pa.float64()))
        keys = key.to_numpy(zero_copy_only=False)[good].astype(np.int64)
        return from_matrix(fn(m, keys.view(np.uint64)), good)

    return kernel


def pixelwise(fn: Callable[..., np.ndarray], arrays: int):
    """A Column function of ``arrays`` array columns followed by scalar columns, pixel by pixel.

    Rows may differ in width. A row comes out null when an input is null or its arrays differ in
    length; scalars are repeated along the pixels of their row.
    """
    @F.arrow_udf("array<double>")
    def kernel(*columns: pa.Array) -> pa.Array:
        vectors, scalars = columns[:arrays], columns[arrays:]
        sizes = [pc.list_value_length(v) for v in vectors]
        good = pc.is_valid(sizes[0])
        for size in sizes[1:]:
            good = pc.and_(good, pc.fill_null(pc.equal(size, sizes[0]), False))
        for s in scalars:
            good = pc.and_(good, pc.is_valid(s))
        counts = sizes[0].filter(good).to_numpy(zero_copy_only=False)
        flat = [v.filter(good).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for v in vectors]
        spread = [np.repeat(s.filter(good).cast(pa.float64()).to_numpy(zero_copy_only=False), counts) for s in scalars]
        kept = good.to_numpy(zero_copy_only=False).astype(bool)
        steps = np.zeros(len(kept), dtype=np.int64)
        steps[kept] = counts
        offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(fn(*flat, *spread)), mask=pa.array(~kept))

    return kernel


def in_blocks(fn: Callable[[Matrix], Matrix], rows: int = 2048) -> Callable[[Matrix], Matrix]:
    """Apply ``fn`` to blocks of rows: kernels with several work arrays stay small and in cache."""
    def apply(m: Matrix) -> Matrix:
        if len(m) <= rows:
            return fn(m)
        return np.concatenate([fn(m[i:i + rows]) for i in range(0, len(m), rows)])

    return apply


def linear_kernel(weights: Matrix, offset: Matrix | None = None):
    """Constant linear map ``x -> weights @ x + offset`` (one BLAS call per batch)."""
    w = np.ascontiguousarray(np.asarray(weights, dtype=np.float64).T)
    shift = 0.0 if offset is None else np.asarray(offset, dtype=np.float64)
    return array_kernel(lambda m: m @ w + shift, w.shape[0])


# ---------------------------------------------------------------- smoothing


def savgol_rows(window: int, order: int, deriv: int) -> Matrix:
    """Row s of the result evaluates, at window position s, the least-squares polynomial
    (or its derivative) through a window of samples."""
    half = window // 2
    t = np.arange(-half, half + 1, dtype=float)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    powers = np.vander(t, order + 1, increasing=True)
    for _ in range(deriv):
        shifted = np.zeros_like(powers)
        shifted[:, 1:] = powers[:, :-1]
        powers = shifted
    factor = np.array([
        np.prod(np.arange(p - deriv + 1, p + 1)) if p >= deriv else 0.0 for p in range(order + 1)
    ])
    return (powers * factor) @ fit


def savgol(width: int, window: int = 11, order: int = 3, deriv: int = 0):
    """Savitzky-Golay filter; the ends use the polynomial of the first and last full window."""
    if window % 2 == 0:
        raise ValueError("window must be odd")
    if window <= order:
        raise ValueError("window must exceed the polynomial order")
    if width < window:
        raise ValueError("spectra are narrower than the window")
    rows = savgol_rows(window, order, deriv)
    half = window // 2

    def apply(m: Matrix) -> Matrix:
        out = np.empty_like(m)
        inner = width - window + 1
        middle = out[:, half:half + inner]
        middle[:] = 0.0
        for j, c in enumerate(rows[half]):
            middle += c * m[:, j:j + inner]
        out[:, :half] = m[:, :window] @ rows[:half].T
        out[:, width - half:] = m[:, width - window:] @ rows[half + 1:].T
        return out

    return array_kernel(apply, width)


def running_mean(width: int, span: int = 15):
    """Mean over ``span`` neighbours; the first and last full mean fill the ends."""
    if width < span:
        raise ValueError("spectra are narrower than the window")
    left = (width - (width - span + 1)) // 2

    def apply(m: Matrix) -> Matrix:
        sums = np.cumsum(np.pad(m, ((0, 0), (1, 0))), axis=1)
        inner = (sums[:, span:] - sums[:, :-span]) / span
        return np.pad(inner, ((0, 0), (left, width - inner.shape[1] - left)), mode="edge")

    return array_kernel(apply, width)


# ---------------------------------------------------------------- baselines


def _penalty_bands(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals of the second-difference penalty matrix D'D (pentadiagonal)."""
    d = np.diff(np.eye(width), n=2, axis=0)
    g = d.T @ d
    return np.diag(g).copy(), np.diag(g, 1).copy(), np.diag(g, 2).copy()


def _solve_pentadiagonal(main: Matrix, off1: np.ndarray, off2: np.ndarray, rhs: Matrix) -> Matrix:
    """Solve many symmetric pentadiagonal systems at once; channels first, rows vectorised."""
    k = main.shape[0]
    d = np.empty_like(main)
    l1 = np.zeros_like(main)
    l2 = np.zeros_like(main)
    z = np.empty_like(rhs)
    for i in range(k):
        a = main[i].copy()
        b = rhs[i].copy()
        if i >= 1:
            a -= l1[i - 1] ** 2 * d[i - 1]
            b -= l1[i - 1] * z[i - 1]
        if i >= 2:
            a -= l2[i - 2] ** 2 * d[i - 2]
            b -= l2[i - 2] * z[i - 2]
        d[i], z[i] = a, b
        if i + 1 < k:
            c = off1[i] - (l2[i - 1] * d[i - 1] * l1[i - 1] if i >= 1 else 0.0)
            l1[i] = c / a
        if i + 2 < k:
            l2[i] = off2[i] / a
    z /= d
    for i in range(k - 2, -1, -1):
        z[i] -= l1[i] * z[i + 1]
        if i + 2 < k:
            z[i] -= l2[i] * z[i + 2]
    return z


def asls(width: int, lam: float = 1e5, p: float = 0.01, n_iter: int = 10):
    """Asymmetric least-squares baseline (Eilers and Boelens 2005)."""
    if width < 5:
        return array_kernel(np.zeros_like, width)
    g0, g1, g2 = (lam * g for g in _penalty_bands(width))

    def apply(m: Matrix) -> Matrix:
        y = np.ascontiguousarray(m.T)
        w = np.ones_like(y)
        z = y
        for _ in range(n_iter):
            z = _solve_pentadiagonal(w + g0[:, None], g1, g2, w * y)
            # Points exactly on the baseline get no weight.
            w = np.where(y > z, p, np.where(y < z, 1.0 - p, 0.0))
        return z.T

    return array_kernel(in_blocks(apply), width)


def upper_hull(m: Matrix, x: np.ndarray) -> Matrix:
    """Upper convex hull of every row, interpolated back onto ``x``.

    Each row keeps a stack of hull vertices; all rows push and pop together.
    """
    n, k = m.shape
    stack = np.zeros((n, k), dtype=np.int64)
    depth = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for i in range(k):
        active = rows[depth >= 2]
        while active.size:
            b = stack[active, depth[active] - 1]
            a = stack[active, depth[active] - 2]
            ya, yb, yi = m[active, a], m[active, b], m[active, i]
            below = (x[b] - x[a]) * (yi - ya) >= (yb - ya) * (x[i] - x[a])
            active = active[below]
            depth[active] -= 1
            active = active[depth[active] >= 2]
        stack[rows, depth] = i
        depth += 1
    vertex = np.zeros((n, k), dtype=bool)
    used = np.arange(k)[None, :] < depth[:, None]
    vertex[np.nonzero(used)[0], stack[used]] = True
    here = np.arange(k)[None, :]
    left = np.maximum.accumulate(np.where(vertex, here, 0), axis=1)
    right = np.minimum.accumulate(np.where(vertex, here, k - 1)[:, ::-1], axis=1)[:, ::-1]
    yl = np.take_along_axis(m, left, axis=1)
    yr = np.take_along_axis(m, right, axis=1)
    span = np.where(right > left, x[right] - x[left], 1.0)
    return yl + (yr - yl) * (x[None, :] - x[left]) / span


def continuum_removal(grid):
    """Reflectance divided by its upper hull; ones for spectra too short to have one."""
    x = np.asarray(grid, dtype=float)
    if x.size < 3:
        return array_kernel(np.ones_like, x.size)
    return array_kernel(in_blocks(lambda m: m / np.maximum(upper_hull(m, x), 1e-9)), x.size)


# ---------------------------------------------------------------- bands


def band_weights(grid, centres, fwhm_nm: float, dark_weight: float = 0.85) -> Matrix:
    """Weights of Gaussian band-passes over a grid. Bands that see (almost) none of the grid
    read the last channel times ``dark_weight``."""
    g = np.asarray(grid, dtype=float)
    sigma = fwhm_nm / (2.0 * np.sqrt(2.0 * np.log(2.0)))
    w = np.exp(-0.5 * ((g[None, :] - np.asarray(centres, dtype=float)[:, None]) / sigma) ** 2)
    sums = w.sum(axis=1, keepdims=True)
    tail = np.zeros(g.size)
    tail[-1] = dark_weight
    return np.where(sums < 1e-9, tail[None, :], w / np.where(sums < 1e-9, 1.0, sums))


def window_weights(grid, centres, reach: int = 2) -> Matrix:
    """Weights of the mean over ``reach`` pixels either side of the pixel nearest each centre."""
    g = np.asarray(grid, dtype=float)
    out = np.zeros((len(centres), g.size))
    for row, centre in zip(out, centres):
        at = int(np.argmin(np.abs(g - centre)))
        span = slice(max(0, at - reach), min(g.size, at + reach + 1))
        row[span] = 1.0 / (span.stop - span.start)
    return out


# ---------------------------------------------------------------- draws


def uniform_draws(keys: np.ndarray, count: int, stream: int = 0) -> Matrix:
    """Uniform numbers in (0, 1) that depend only on (key, stream, position).

    A counter hashed with the SplitMix64 finaliser, so a row draws the same numbers whatever
    batch, partition or attempt it is processed in.
    """
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        at = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(stream) * np.uint64(1 << 32)
        z = _mix(keys)[:, None] + at[None, :] * step
        return ((_mix(z) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def normal_draws(keys: np.ndarray, count: int, stream: int = 0) -> Matrix:
    """Standard normal numbers by the Box-Muller transform of two uniform streams."""
    u = uniform_draws(keys, count, 2 * stream)
    v = uniform_draws(keys, count, 2 * stream + 1)
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)


def batches_as_matrix(batches: Iterator[pa.RecordBatch], column: str, width: int):
    """Yield ``(batch, matrix)`` for ``mapInArrow`` functions; a row that is null or of another width fails the job."""
    for batch in batches:
        m, good = to_matrix(batch.column(batch.schema.get_field_index(column)), width)
        if not good.all():
            raise ValueError(f"{int((~good).sum())} rows of a batch are null or not {width} values wide")
        if len(m):
            yield batch, m
