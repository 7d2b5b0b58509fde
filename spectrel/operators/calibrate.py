"""Calibration as table jobs: find each frame's references, then normalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reflectance as R
from ..functions import vectors as V
from ..session import materialise
from .asof import latest_references
from .channels import channel_moments, mean_of


def asof_match(frames: DataFrame, refs: DataFrame, by: str, ts: str, kind: str,
               kinds: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """For every distinct (by, ts) of ``frames`` with a time: the time of the latest reference of each
    kind taken at or before it, in columns ``<kind>_ts`` (null when there is none)."""
    wanted = frames.select(by, ts).where(F.col(ts).isNotNull()).distinct()
    found = latest_references(wanted, refs, by, ts, kind, kinds, (), partitions)
    return found.select(by, ts, *[F.col(f"{k}.ts").alias(f"{k}_ts") for k in kinds])


def attach_references(frames: DataFrame, refs: DataFrame, by: str = "session_id", ts: str = "ts",
                      kind: str = "kind", partitions: int | None = None) -> DataFrame:
    """Frames with the latest dark and white frame of their session (null when none) and their times.

    ``refs`` holds (by, ts, kind, counts, integration_ms, temp_c). The wide frames are shuffled
    once, on (session, time), together with the references; see :func:`~spectrel.operators.asof.latest_references`.
    """
    found = latest_references(frames, refs, by, ts, kind, ("dark", "white"), ("counts", "integration_ms", "temp_c"), partitions)
    return found.withColumns({"dark_ts": F.col("dark.ts"), "white_ts": F.col("white.ts")})


def calibrate(frames: DataFrame, refs: DataFrame, by: str = "session_id", ts: str = "ts",
              counts: str = "counts", exposure: str = "integration_time_ms",
              temp: str = "ambient_temp_c", partitions: int | None = None) -> DataFrame:
    """Counts to reflectance with each session's own references.

    Every frame comes out. One that cannot be calibrated has a null ``reflectance`` and says
    why in ``reason``.
    """
    out = attach_references(frames, refs, by, ts, partitions=partitions)
    reason = (
        F.when(F.col("dark").isNull(), F.lit("no_dark_reference"))
        .when(F.col("white").isNull(), F.lit("no_white_reference"))
        .when(~(F.col(exposure) > 0) | F.col(exposure).isNull(), F.lit("bad_exposure"))
        .when(~(F.col("dark.integration_ms") > 0) | ~(F.col("white.integration_ms") > 0),
              F.lit("bad_reference_exposure"))
        .when((F.size("dark.counts") != F.size(counts)) | (F.size("white.counts") != F.size(counts)),
              F.lit("width_mismatch"))
    )
    out = V.once(out, "reason", reason)
    usable = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    # Inputs of unusable frames are nulled: a kernel runs on every row whatever surrounds it.
    value = R.calibrated(
        counts, usable(exposure), temp, F.col("dark.counts"), usable("dark.integration_ms"),
        F.col("dark.temp_c"), F.col("white.counts"), usable("white.integration_ms"))
    return out.withColumn("reflectance", value).drop("dark", "white")


def fit_dark_profiles(sweeps: DataFrame, profile: str = "profile_id", counts: str = "counts",
                      temp: str = "temp_c", reference_c: float = R.REFERENCE_TEMP_C) -> DataFrame:
    """Per-pixel line of dark counts against temperature, one row per profile.

    Profiles with fewer than two frames, or with all temperatures alike, get null coefficients
    and a reason. ``fit_residual_mean`` is the mean absolute residual over frames and pixels.
    """
    warm = F.col("_t")
    rows = sweeps.select(profile, counts, (F.col(temp) - reference_c).alias("_t"))
    # One pass: the lines and what is needed to tell whether they mean anything.
    sums = channel_moments(rows, counts, [profile], warm)
    lo, hi = F.array_min("b_min"), F.array_max("b_max")
    reason = (
        F.when(F.col("bare") == F.col("rows"), F.lit("no_pixels"))
        .when(F.col("bare") > 0, F.lit("mixed_widths"))
        .when(F.array_max("n") < 2, F.lit("fewer_than_two_frames"))
        .when((hi - lo) <= 1e-8 + 1e-5 * F.abs(lo), F.lit("identical_temperatures"))
        .when(F.array_min("n") != F.array_max("n"), F.lit("mixed_widths"))
    )
    fitted = sums.select(
        profile, F.array_max("n").cast("bigint").alias("n_temperatures_fitted"), reason.alias("reason"), mean_of().alias("_y"), mean_of("b_sum").alias("_m"),
        F.zip_with("cov", "b_m2", lambda c, m: F.when(m > 0, c / m)).alias("b"))
    through = F.zip_with(F.zip_with("b", "_m", lambda b, m: b * m), "_y", lambda p, y: y - p)
    fits = fitted.select(
        profile, "n_temperatures_fitted", "reason",
        F.when(F.col("reason").isNull(), through).alias("dark_intercept"),
        F.when(F.col("reason").isNull(), F.col("b")).alias("dark_slope"))
    fits = materialise(fits, "profiles")
    # Residuals need the fitted lines next to the frames: one more pass, arrays kept whole.
    predicted = F.zip_with("dark_intercept", "dark_slope", lambda a, b: a + b * F.col("_t"))
    misfit = F.zip_with(F.col(counts), predicted, lambda y, p: F.abs(y - p))
    residuals = (
        rows.join(fits.where("reason is null").select(profile, "dark_intercept", "dark_slope"), profile)
        .groupBy(profile).agg((F.sum(V.total(misfit)) / F.sum(F.size(counts))).alias("fit_residual_mean"))
    )
    return fits.join(residuals, profile, "left").withColumn("reference_temp_c", F.lit(float(reference_c)))


def calibrate_with_profiles(frames: DataFrame, profiles: DataFrame, profile: str = "profile_id",
                            counts: str = "counts", exposure: str = "integration_time_ms",
                            temp: str = "ambient_temp_c") -> DataFrame:
    """Counts to reflectance with fitted profiles (per-pixel dark slope)."""
    side = profiles.select(
        profile, "dark_intercept", "dark_slope", "white", "white_integration_ms",
        "dark_integration_ms", "reference_temp_c")
    out = frames.join(side, profile, "left")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    value = R.calibrated_with_profile(
        counts, positive(exposure), temp, "dark_intercept", "dark_slope", "reference_temp_c",
        positive("dark_integration_ms"), "white", positive("white_integration_ms"))
    return out.withColumn("reflectance", value).drop(
        "dark_intercept", "dark_slope", "white", "white_integration_ms", "dark_integration_ms",
        "reference_temp_c")


def led_reflectance(narrow: DataFrame, refs: DataFrame, scan: str = "scan_id", led: str = "led",
                    counts: str = "counts", dark: str = "dark", white: str = "white") -> DataFrame:
    """Mean device reflectance of each LED's narrow-band frame against the scan's dark and
    broad-band frames."""
    joined = narrow.select(scan, led, F.col(counts).alias("_raw")).join(refs.select(scan, dark, white), scan)
    pixels = R.normalise_device("_raw", dark, white)
    return joined.select(scan, led, V.total(pixels).alias("_s"), F.size("_raw").alias("_n")) \
        .groupBy(scan, led).agg((F.sum("_s") / F.sum("_n")).alias("reflectance"))


def saturation(df: DataFrame, counts: str = "counts", threshold: int = R.SATURATION_COUNTS) -> DataFrame:
    return df.withColumns({
        "saturated": R.saturation_mask(counts, threshold),
        "saturation_fraction": R.saturation_fraction(counts, threshold),
    })


def photometric(df: DataFrame, model: str, refl: str, incidence: Column | float,
                emission: Column | float | None = None) -> DataFrame:
    """Optional photometric step after calibration."""
    if model == "lommel_seeliger":
        return df.withColumn(refl, R.lommel_seeliger(refl, incidence, emission))
    if model == "lambertian":
        return df.withColumn(refl, R.lambertian(refl, incidence))
    raise ValueError(f"unknown photometric model {model!r}")
