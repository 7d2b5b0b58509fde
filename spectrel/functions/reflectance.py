"""Counts to reflectance, as expressions over array columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import pixelwise
from .vectors import clip, col, let

# Instrument constants that results must reproduce.
DARK_COUNTS_PER_C = 2.0
REFERENCE_TEMP_C = 22.0
SATURATION_COUNTS = 4000
MAX_REFLECTANCE = 1.5
MIN_DENOMINATOR = 1e-6
ADC_FULL_SCALE = 65535.0
THERMISTOR = {"a": 1.009249e-3, "b": 2.378405e-4, "c": 2.019202e-7, "series_ohm": 10000.0}
EXPOSURE_TARGET_COUNTS, EXPOSURE_MIN_MS, EXPOSURE_MAX_MS = 2800, 1, 500


def _positive(x: Column, what: str) -> Column:
    """The value; zero or less fails the job, null stays null."""
    return F.when(x <= 0, F.raise_error(F.lit(f"{what} must be positive"))).otherwise(x)


def _ratio(signal: Column, dark: Column, white: Column) -> Column:
    span = white - dark
    span = F.when(F.abs(span) < MIN_DENOMINATOR, F.lit(MIN_DENOMINATOR)).otherwise(span)
    return clip((signal - dark) / span, 0.0, MAX_REFLECTANCE)


# The per-pixel formulas walk the raw counts once and index the other vectors; chained array
# functions would build an array per step.


def normalise(raw, dark, white) -> Column:
    """(raw - dark) / (white - dark) per channel, dead pixels guarded, clipped to [0, 1.5]."""
    return F.transform(col(raw), lambda r, i: _ratio(r, F.get(col(dark), i), F.get(col(white), i)))


def normalise_device(raw, dark, white) -> Column:
    """The on-device variant: a channel whose white equals its dark reads 0."""
    def pixel(r: Column, i: Column) -> Column:
        d, w = F.get(col(dark), i), F.get(col(white), i)
        return F.when(w == d, F.lit(0.0)).otherwise(clip((r - d) / (w - d), 0.0, MAX_REFLECTANCE))

    return F.transform(col(raw), pixel)


def scale_exposure(counts, actual_ms, target_ms) -> Column:
    """Counts rescaled to another integration time; times at or below zero are an error."""
    return let(_exposure_ratio(target_ms, actual_ms), lambda k: F.transform(col(counts), lambda x: x * k))


def dark_at_temperature(dark, temp_c, reference_c=REFERENCE_TEMP_C,
                        counts_per_c: float = DARK_COUNTS_PER_C) -> Column:
    ref = F.lit(float(reference_c)) if isinstance(reference_c, (int, float)) else col(reference_c)
    rise = (col(temp_c) - ref) * F.lit(counts_per_c)
    return let(rise, lambda rise: F.transform(col(dark), lambda x: x + rise))


def _exposure_ratio(target_ms, actual_ms) -> Column:
    return _positive(col(target_ms), "integration time") / _positive(col(actual_ms), "integration time")


def _reflect(signal: np.ndarray, dark: np.ndarray, white: np.ndarray) -> np.ndarray:
    span = white - dark
    span = np.where(np.abs(span) < MIN_DENOMINATOR, MIN_DENOMINATOR, span)
    return np.clip((signal - dark) / span, 0.0, MAX_REFLECTANCE)


# The two full calibrations use several scalars and vectors per pixel. Interpreted lambdas take
# about three times as long for them as one batch of numpy does (measured at 288 pixels).


def calibrated(raw, exposure_ms, temp_c, dark, dark_ms, dark_temp_c, white, white_ms) -> Column:
    """Session-frame calibration: dark is scaled to the white exposure, then warmed."""
    rise = (col(temp_c) - col(dark_temp_c)) * F.lit(DARK_COUNTS_PER_C)
    pixel = pixelwise(lambda r, d, w, kr, kd, up: _reflect(r * kr, d * kd + up, w), arrays=3)
    return pixel(col(raw), col(dark), col(white), _exposure_ratio(white_ms, exposure_ms),
                 _exposure_ratio(white_ms, dark_ms), rise)


def calibrated_with_profile(raw, exposure_ms, temp_c, intercept, slope, reference_c,
                            dark_ms, white, white_ms) -> Column:
    """Fitted-profile calibration: dark is warmed per pixel, then scaled to the white exposure."""
    pixel = pixelwise(lambda r, a, b, w, kr, kd, up: _reflect(r * kr, (a + up * b) * kd, w), arrays=4)
    return pixel(col(raw), col(intercept), col(slope), col(white), _exposure_ratio(white_ms, exposure_ms),
                 _exposure_ratio(white_ms, dark_ms), col(temp_c) - col(reference_c))


def _cosine(angle_deg) -> Column:
    angle = F.lit(float(angle_deg)) if isinstance(angle_deg, (int, float)) else col(angle_deg)
    return F.cos(F.radians(angle))


def _incidence(angle_deg) -> Column:
    if isinstance(angle_deg, (int, float)) and math.cos(math.radians(angle_deg)) < 1e-6:
        raise ValueError("incidence angle is at or beyond grazing")
    mu0 = _cosine(angle_deg)
    return F.when(mu0 < 1e-6, F.raise_error(F.lit("incidence angle is at or beyond grazing"))).otherwise(mu0)


def lommel_seeliger(refl, incidence_deg, emission_deg) -> Column:
    mu0 = _incidence(incidence_deg)
    k = (mu0 + _cosine(emission_deg)) / mu0
    return let(k, lambda k: F.transform(col(refl), lambda x: x * k))


def lambertian(refl, incidence_deg) -> Column:
    return let(_incidence(incidence_deg), lambda mu0: F.transform(col(refl), lambda x: x / mu0))


def saturation_mask(counts, threshold: int = SATURATION_COUNTS) -> Column:
    return F.transform(col(counts), lambda x: x >= threshold)


def saturation_fraction(counts, threshold: int = SATURATION_COUNTS) -> Column:
    c = col(counts)
    return F.size(F.filter(c, lambda x: x >= threshold)) / F.size(c)


def swir_reflectance(bright, dark) -> Column:
    """Difference of 16-bit photodiode codes as a share of full scale."""
    return clip(col(bright) / ADC_FULL_SCALE - col(dark) / ADC_FULL_SCALE, 0.0, MAX_REFLECTANCE)


def quantise(values) -> Column:
    """16-bit ADC rounding (half to even), clipped to [0, 1.5]."""
    return F.transform(col(values), lambda x: clip(
        F.rint(x * ADC_FULL_SCALE) / ADC_FULL_SCALE, 0.0, MAX_REFLECTANCE))


def thermistor_celsius(adc) -> Column:
    """12-bit divider reading to degrees; an open or shorted sensor reads 150.

    A reading of 0 has no finite logarithm; its limit is absolute zero.
    """
    volts = col(adc) * 3.3 / 4095.0
    ln_r = F.log(THERMISTOR["series_ohm"] * volts / (3.3 - volts))
    inverse = THERMISTOR["a"] + THERMISTOR["b"] * ln_r + THERMISTOR["c"] * ln_r * ln_r * ln_r
    return (
        F.when(volts >= 3.29, F.lit(150.0))
        .when(volts <= 0, F.lit(-273.15))
        .otherwise(1.0 / inverse - 273.15)
    )


def recommended_exposure(counts, exposure_ms, target: int = EXPOSURE_TARGET_COUNTS) -> Column:
    """Exposure that would put the 95th-percentile pixel on ``target`` counts."""
    c = F.transform(col(counts), lambda x: F.least(x.cast("long"), F.lit(4095)))
    skip = F.floor(F.size(c) / 20).cast("int")
    p95 = F.get(F.sort_array(c, asc=False), skip)
    old = col(exposure_ms).cast("long")
    wanted = F.floor(old * F.lit(target) / p95)
    return F.when(p95 == 0, F.lit(EXPOSURE_MAX_MS)).otherwise(
        F.least(F.greatest(wanted, F.lit(EXPOSURE_MIN_MS)), F.lit(EXPOSURE_MAX_MS))).cast("int")
