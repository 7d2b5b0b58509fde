"""Column expressions over array<double> columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it.

    Higher-order functions are interpreted and their arguments are not shared, so an expression
    named inside a lambda would be recomputed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A filter on an ordinary column is pushed below the projection that makes it, which repeats
    the whole expression in the filter. Output of a generator stays where it is.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def argmax(a: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    """Index of the first smallest element."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def window_of(grid: Sequence[float], lo: float, hi: float) -> tuple[int, int]:
    """(first index, count) of the grid points inside ``[lo, hi]``; the grid is ascending."""
    g = np.asarray(grid, dtype=float)
    first = int(np.searchsorted(g, lo, side="left"))
    last = int(np.searchsorted(g, hi, side="right"))
    if last <= first:
        raise ValueError(f"no grid point between {lo} and {hi} nm")
    return first, last - first


def between(a: Column, grid: Sequence[float], lo: float, hi: float) -> Column:
    """The stretch of ``a`` whose wavelengths lie in ``[lo, hi]``."""
    first, count = window_of(grid, lo, hi)
    return F.slice(a, first + 1, count)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def all_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: ~is_finite(x))


def softmax(z: Column) -> Column:
    """Max-shifted softmax of an array."""
    def exponentials(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))

    def shares(e: Column) -> Column:
        return let(total(e), lambda s: F.transform(e, lambda x: x / s))

    return let(let(z, exponentials), shares)
