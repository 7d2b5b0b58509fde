"""Augmented training copies and test-time averaging, reproducible row by row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import kernels as K
from ..functions import vectors as V
from ..functions.uncertainty import Thresholds, with_uncertainty


@dataclass(frozen=True)
class AugmentConfig:
    """Strengths of the augmentation steps; the defaults are the values results must reproduce."""

    p_apply: float = 0.8
    noise: float = 0.010
    intensity: float = 0.08
    baseline: float = 0.030
    dropout: float = 0.008
    max_shift: int = 2
    lo: float = 0.0
    hi: float = 1.5
    led_noise: float = 0.012
    swir_noise: float = 0.012
    lif_noise: float = 0.020


def jitter(m: np.ndarray, keys: np.ndarray, sigma: float, stream: int = 1) -> np.ndarray:
    return m * (1.0 + sigma * K.normal_draws(keys, 1, stream))


def drift(m: np.ndarray, keys: np.ndarray, amplitude: float, stream: int = 2) -> np.ndarray:
    """Add a cubic of random coefficients, scaled so its largest value is ``amplitude``."""
    x = np.linspace(-1.0, 1.0, m.shape[1])
    c = 2.0 * K.uniform_draws(keys, 4, 100 + stream) - 1.0
    cubic = c @ np.vander(x, 4, increasing=True).T
    return m + amplitude * cubic / (np.abs(cubic).max(axis=1, keepdims=True) + 1e-12)


def shift(m: np.ndarray, keys: np.ndarray, reach: int, stream: int = 3) -> np.ndarray:
    """Move each spectrum by up to ``reach`` pixels, repeating its end value."""
    if reach <= 0:
        return m
    by = np.floor(K.uniform_draws(keys, 1, 100 + stream) * (2 * reach + 1)).astype(int) - reach
    at = np.clip(np.arange(m.shape[1])[None, :] - by, 0, m.shape[1] - 1)
    return np.take_along_axis(m, at, axis=1)


def noise(m: np.ndarray, keys: np.ndarray, sigma: float, stream: int = 4) -> np.ndarray:
    return m + sigma * K.normal_draws(keys, m.shape[1], stream)


def dropout(m: np.ndarray, keys: np.ndarray, p: float, stream: int = 5) -> np.ndarray:
    return m if p <= 0 else m * (K.uniform_draws(keys, m.shape[1], 100 + stream) >= p)


def spectrum_kernel(width: int, cfg: AugmentConfig = AugmentConfig()):
    """The whole chain, run on each row with probability ``p_apply``; always clipped."""
    def apply(m: np.ndarray, keys: np.ndarray) -> np.ndarray:
        run = K.uniform_draws(keys, 1, 100) < cfg.p_apply
        out = jitter(m, keys, cfg.intensity)
        out = drift(out, keys, cfg.baseline)
        out = shift(out, keys, cfg.max_shift)
        out = noise(out, keys, cfg.noise)
        out = dropout(out, keys, cfg.dropout)
        return np.clip(np.where(run, out, m), cfg.lo, cfg.hi)

    return K.keyed_kernel(apply, width)


def noise_kernel(width: int, sigma: float, lo: float, hi: float, stream: int):
    return K.keyed_kernel(lambda m, keys: np.clip(noise(m, keys, sigma, stream), lo, hi), width)


def row_key(seed: int, *columns: str | Column) -> Column:
    """60-bit seed of a row's draws: the head of an MD5 of the run seed and the row's identity, the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[V.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def augment(df: DataFrame, copies: int = 1, seed: int = 0, key: str = "measurement_id",
            cfg: AugmentConfig = AugmentConfig()) -> DataFrame:
    """``copies`` augmented versions of every measurement, numbered in ``copy``.

    Spectra run the full chain; LED, SWIR and fluorescence get light noise; the 18-band block is
    left alone. Nothing is shuffled, and a row draws the same numbers wherever it runs.
    """
    width = {b.name: b.width for b in schema.BLOCKS}
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    out = out.withColumn("_key", row_key(seed, key, "copy"))
    changed = {}
    if "spec" in df.columns:
        changed["spec"] = spectrum_kernel(width["spec"], cfg)("spec", "_key")
    if "led" in df.columns:
        changed["led"] = noise_kernel(width["led"], cfg.led_noise, 0.0, 1.5, 11)("led", "_key")
    if "swir" in df.columns:
        changed["swir"] = noise_kernel(width["swir"], cfg.swir_noise, 0.0, 1.5, 12)("swir", "_key")
    if schema.LIF in df.columns:
        lif = noise_kernel(1, cfg.lif_noise, 0.0, float("inf"), 13)(F.array(schema.LIF), "_key")
        changed[schema.LIF] = F.get(lif, F.lit(0))
    return out.withColumns(changed).drop("_key")


def augment_spectra(df: DataFrame, width: int, copies: int = 1, seed: int = 0, key: str = "measurement_id",
                    spec: str = "spec", cfg: AugmentConfig = AugmentConfig()) -> DataFrame:
    """Augmented copies of one spectrum column of any width."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return out.withColumn(spec, spectrum_kernel(width, cfg)(F.col(spec), row_key(seed, key, "copy")))


def tta(df: DataFrame, scorer, width: int, n_classes: int, key: str = "measurement_id", features: str = "features",
        n: int = 8, sigma: float = 0.005, seed: int = 0, p: str = "probabilities",
        ilmenite: str = "ilmenite_fraction", t: Thresholds = Thresholds()) -> DataFrame:
    """Average the scores of ``n`` versions of each row: the row itself and ``n - 1`` noisy copies.

    Copy 0 is neither noised nor clipped. The copies of a row stay next to each other, so the
    partial average folds them before the shuffle on the key.
    """
    rows = df.select(key, features).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    noisy = noise_kernel(width, sigma, 0.0, 1.5, 21)(F.col(features), row_key(seed, key, "_copy"))
    rows = rows.withColumn(features, F.when(F.col("_copy") == 0, F.col(features)).otherwise(noisy))
    averaged = scorer.score(rows).groupBy(key).agg(
        F.array(*[F.avg(F.get(p, F.lit(k))) for k in range(n_classes)]).alias(p),
        V.clip(F.avg(ilmenite), 0.0, 1.0).alias(ilmenite), F.count(p).alias("tta_n"))
    return with_uncertainty(averaged, p, t)
