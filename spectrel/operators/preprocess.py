"""Preprocessing of spectra as a list of named steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels


def smooth(df: DataFrame, width: int, spec: str = "spec", window: int = 11, order: int = 3,
           deriv: int = 0, out: str | None = None) -> DataFrame:
    return df.withColumn(out or spec, kernels.savgol(width, window, order, deriv)(F.col(spec)))


def first_derivative(df: DataFrame, width: int, spec: str = "spec", window: int = 11, out: str | None = None) -> DataFrame:
    return smooth(df, width, spec, window, 3, 1, out)


def baseline(df: DataFrame, width: int, spec: str = "spec", lam: float = 1e5, p: float = 0.01,
             n_iter: int = 10, out: str = "baseline") -> DataFrame:
    """Asymmetric least-squares baseline of each spectrum."""
    return df.withColumn(out, kernels.asls(width, lam, p, n_iter)(F.col(spec)))


def baseline_correct(df: DataFrame, width: int, spec: str = "spec", **kw) -> DataFrame:
    """Spectra less their baseline."""
    fitted = baseline(df, width, spec, out="_b", **kw)
    return fitted.withColumn(spec, F.zip_with(spec, "_b", lambda y, b: y - b)).drop("_b")


def remove_continuum(df: DataFrame, grid, spec: str = "spec", out: str | None = None) -> DataFrame:
    return df.withColumn(out or spec, kernels.continuum_removal(grid)(F.col(spec)))


def preprocess(df: DataFrame, grid, steps: list[str | tuple[str, dict]], spec: str = "spec") -> DataFrame:
    """Run steps in order: ``smooth``, ``derivative``, ``baseline``, ``continuum``."""
    width = len(grid)
    for step in steps:
        name, kw = (step, {}) if isinstance(step, str) else step
        if name == "smooth":
            df = smooth(df, width, spec, **kw)
        elif name == "derivative":
            df = first_derivative(df, width, spec, **kw)
        elif name == "baseline":
            df = baseline_correct(df, width, spec, **kw)
        elif name == "continuum":
            df = remove_continuum(df, grid, spec)
        else:
            raise ValueError(f"unknown preprocessing step {name!r}")
    return df
