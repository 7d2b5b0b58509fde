"""Mixtures of end-members: linear, intimate (Hapke) and fluorescence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import mixing as M
from .channels import channel_moments, collect_channels, explode_channels

MODELS = ("linear", "hapke")

# Fluorescence yield of each end-member and the quenching exponent of ilmenite.
LIF_EFFICIENCY = {
    "olivine": 0.30, "pyroxene": 0.40, "anorthite": 0.85, "ilmenite": 0.00, "glass_agglutinate": 0.15,
}
QUENCH = 1.5


def check_model(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"unknown mixing model {model!r}; expected one of {MODELS}")
    return model


def mix(fractions: DataFrame, endmembers: DataFrame, model: str = "linear", sample: str = "sample_id",
        endmember: str = "endmember", fraction: str = "fraction", spec: str = "spec") -> DataFrame:
    """``(sample, endmember, fraction)`` rows to one mixed spectrum per sample.

    Each fraction row takes its end-member's spectrum by a join (Spark broadcasts a small set of
    end-members by itself) and the scaled spectra are summed per sample inside the tasks, so one way
    serves any number of end-members and any crowd of rows in a sample. A fraction naming an unknown
    end-member and an end-member named twice fail the job.
    """
    check_model(model)
    once = F.when(F.count(F.lit(1)) == 1, F.first(spec)).otherwise(
        F.raise_error(F.concat(F.lit("repeated end-member: "), F.col(endmember))).cast("array<double>"))
    pure = endmembers.groupBy(endmember).agg(once.alias("_pure"))
    value = M.albedo_of_reflectance if model == "hapke" else (lambda v: v)
    known = F.coalesce(F.col("_pure"), F.raise_error(F.lit("unknown end-member in fractions")).cast("array<double>"))
    part = F.transform(known, lambda v: F.col(fraction) * value(v))
    rows = fractions.join(pure, endmember, "left").select(sample, part.alias("_part"))
    total = channel_moments(rows, "_part", [sample]).select(sample, F.col("sum").alias(spec))
    return total.withColumn(spec, F.transform(spec, M.reflectance_of_albedo)) if model == "hapke" else total


def fluorescence(fractions: DataFrame, sample: str = "sample_id", endmember: str = "endmember",
                 fraction: str = "fraction", efficiency: dict[str, float] | None = None,
                 quencher: str = "ilmenite") -> DataFrame:
    """Fluorescence of each sample: yield-weighted fractions, quenched by the opaque mineral."""
    table = efficiency or LIF_EFFICIENCY
    gain = F.lit(None).cast("double")
    for name, value in table.items():
        gain = F.when(F.col(endmember) == name, F.lit(float(value))).otherwise(gain)
    gain = F.coalesce(gain, F.raise_error(F.lit("unknown end-member in fractions")))
    opaque = F.sum(F.when(F.col(endmember) == quencher, F.col(fraction)).otherwise(F.lit(0.0)))
    return fractions.groupBy(sample).agg(
        (F.sum(F.col(fraction) * gain) * F.pow(1.0 - opaque, F.lit(QUENCH))).alias("lif"))


def band_response(df: DataFrame, grid, centres, fwhm_nm: float, spec: str = "spec", out: str = "bands") -> DataFrame:
    """Readings of Gaussian band-pass channels looking at each spectrum."""
    return df.withColumn(out, kernels.linear_kernel(kernels.band_weights(grid, centres, fwhm_nm))(F.col(spec)))


def band_window_mean(df: DataFrame, grid, centres, reach: int = 2, spec: str = "spec", out: str = "bands") -> DataFrame:
    """Mean of the pixels around the one nearest each centre."""
    return df.withColumn(out, kernels.linear_kernel(kernels.window_weights(grid, centres, reach))(F.col(spec)))


def with_swir(endmembers: DataFrame, spec: str = "spec", swir: str = "swir") -> DataFrame:
    """Fill missing short-wave readings from the last channel (factors 0.95 and 0.88)."""
    last = F.element_at(F.col(spec), -1)
    guess = F.array(last * 0.95, last * 0.88)
    have = F.col(swir) if swir in endmembers.columns else F.lit(None).cast("array<double>")
    return endmembers.withColumn(swir, F.coalesce(have, guess))


def weighted_mix(spectra: DataFrame, weights: dict[str, float], name: str = "endmember", spec: str = "spec") -> DataFrame:
    """One spectrum: the weighted sum of named spectra."""
    gain = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    long = explode_channels(spectra.where(F.col(name).isin(list(weights))), spec, [name])
    return collect_channels(
        long.groupBy(F.lit("mix").alias("_k"), "i").agg(F.sum(F.col("v") * gain[F.col(name)]).alias(spec)),
        ["_k"], spec).drop("_k")

