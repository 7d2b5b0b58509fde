"""Hand-built features of spectra, LED reflectances and fluorescence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from . import kernels
from . import vectors as V

EPS = 1e-6

# Wavelength ranges (nm) and channels the features are defined on.
ALBEDO_NM = SLOPE_NM = (500, 800)
UV_NM, GREEN_NM = (340, 420), (500, 600)
BAND_700_NM, BAND_620_NM = (680, 720), (600, 640)
LED_RED, LED_BLUE = 660, 450
LED_NIR, LED_VIS = (730, 780, 850), (450, 525)
AS7_ALBEDO = (510, 535, 560, 585, 610, 645, 680)
AS7_NIR, AS7_VIS = (810, 860, 900), (460, 510, 560)

SPECTRAL_FEATURES = (
    "broad_albedo", "vis_red_slope", "uv_blue_drop", "band_depth_700", "band_depth_620",
    "led_red_blue_ratio", "led_nir_vis_ratio", "lif_normalised",
)
BAND_FEATURES = (
    "as7_broad_albedo", "as7_vis_nir_slope", "as7_blue_red_ratio", "as7_nir_vis_ratio",
    "as7_band_depth_700", "as7_uv_drop", "led_red_blue_ratio", "led_nir_vis_ratio", "lif_normalised",
)


def slope(values: Column, nm: Sequence[float]) -> Column:
    """Least-squares slope of ``values`` against wavelength.

    The centred wavelengths sum to zero, so the mean of the values drops out.
    """
    x = np.asarray(nm, dtype=float)
    x = x - x.mean()
    return V.dot(values, V.literal(x / (x ** 2).sum()))


def ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPS))


class Channels:
    """Mean reflectance of named channels of a narrow-band block."""

    def __init__(self, column, centres: Sequence[int]):
        self.column, self.at = V.col(column), {w: i for i, w in enumerate(centres)}

    def __call__(self, *nm: int) -> Column:
        values = [F.get(self.column, F.lit(self.at[w])) for w in nm]
        out = values[0]
        for v in values[1:]:
            out = out + v
        return out / float(len(values))


def led_ratios(led, led_nm=schema.LED_NM) -> dict[str, Column]:
    at = Channels(led, led_nm)
    return {
        "led_red_blue_ratio": ratio(at(LED_RED), at(LED_BLUE)),
        "led_nir_vis_ratio": ratio(at(*LED_NIR), at(*LED_VIS)),
    }


def spectral_features(df: DataFrame, spec="spec", led="led", lif=schema.LIF,
                      grid=schema.SPEC_GRID, led_nm=schema.LED_NM) -> DataFrame:
    """Add the eight spectral features. The hull is computed once and shared by both depths."""
    nm = np.asarray(grid, dtype=float)
    s, flat = F.col(spec), F.col("_flattened")
    first, count = V.window_of(nm, *SLOPE_NM)
    df = df.withColumn("_flattened", kernels.continuum_removal(nm)(s))
    df = df.withColumns({
        "broad_albedo": V.mean(V.between(s, nm, *ALBEDO_NM)),
        "vis_red_slope": slope(V.between(s, nm, *SLOPE_NM), nm[first:first + count]),
        "uv_blue_drop": ratio(V.mean(V.between(s, nm, *UV_NM)), V.mean(V.between(s, nm, *GREEN_NM))),
        "band_depth_700": 1.0 - F.array_min(V.between(flat, nm, *BAND_700_NM)),
        "band_depth_620": 1.0 - F.array_min(V.between(flat, nm, *BAND_620_NM)),
        **led_ratios(led, led_nm),
    }).drop("_flattened")
    return df.withColumn("lif_normalised", ratio(F.col(lif), F.col("broad_albedo")))


def band_features(df: DataFrame, as7="as7", led="led", lif=schema.LIF,
                  band_nm=schema.AS7_NM, led_nm=schema.LED_NM) -> DataFrame:
    """Add the nine features of the 18-band sensor."""
    at = Channels(as7, band_nm)
    df = df.withColumns({
        "as7_broad_albedo": at(*AS7_ALBEDO),
        "as7_vis_nir_slope": slope(F.col(as7), band_nm),
        "as7_blue_red_ratio": ratio(at(460), at(680)),
        "as7_nir_vis_ratio": ratio(at(*AS7_NIR), at(*AS7_VIS)),
        "as7_band_depth_700": 1.0 - ratio(at(680), at(645, 730)),
        "as7_uv_drop": ratio(at(410), at(535)),
        **led_ratios(led, led_nm),
    })
    return df.withColumn("lif_normalised", ratio(F.col(lif), F.col("as7_broad_albedo")))


def expert_features(df: DataFrame, out: str = "expert", grid=schema.SPEC_GRID) -> DataFrame:
    """Feature vector by each row's sensor mode: 8 (full), 9 (multispectral) or 17 (combined).

    A row lacking a block its mode calls for gets a null vector.
    """
    names = df.columns
    full = spectral_features(df.withColumn("_mode", schema.detect_mode()), grid=grid)
    full = full.withColumn("_full", F.array(*SPECTRAL_FEATURES)).select(*names, "_mode", "_full")
    both = band_features(full).withColumn("_bands", F.array(*BAND_FEATURES))
    has_spec, has_as7 = F.col("spec").isNotNull(), F.col("as7").isNotNull()
    return both.select(*names, (
        F.when((F.col("_mode") == "full") & has_spec, F.col("_full"))
        .when((F.col("_mode") == "multispectral") & has_as7, F.col("_bands"))
        .when((F.col("_mode") == "combined") & has_spec & has_as7, F.concat("_full", "_bands"))
    ).alias(out))


def feature_vector(spec="spec", as7="as7", swir="swir", led="led", lif=schema.LIF) -> Column:
    """Model input ``[spec | as7 | swir | led | lif]``, the blocks guarded by the row's mode."""
    none = F.array().cast("array<double>")
    mode = schema.detect_mode()
    spec_part = F.when(mode.isin("full", "combined"), F.col(spec)).otherwise(none)
    as7_part = F.when(mode.isin("multispectral", "combined"), F.col(as7)).otherwise(none)
    return F.concat(spec_part, as7_part, F.coalesce(F.col(swir), none), F.col(led), F.array(F.col(lif)))


def frame_vector(spec="spec", as7="as7", swir="swir", led="led", lif=schema.LIF) -> Column:
    """Model input of a wire frame: whichever optional blocks it carries, in canonical order."""
    none = F.array().cast("array<double>")
    return F.concat(F.col(spec), F.coalesce(F.col(as7), none), F.coalesce(F.col(swir), none),
                    F.col(led), F.array(F.col(lif)))
