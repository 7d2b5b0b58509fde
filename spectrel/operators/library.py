"""Reference libraries: band models, weathering, resampling and grid matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import vectors as V
from .channels import channel_moments, collect_channels, mean_of
from .mixing import weighted_mix

# Published continuum (level, rise, exponent over the 340-850 nm window) and
# absorption bands (centre nm, sigma nm, depth; a negative depth is a bump) of the pure minerals.
CONTINUA = {
    "olivine": (0.18, 0.55, 1.0),
    "pyroxene": (0.12, 0.50, 1.0),
    "anorthite": (0.55, 0.30, 1.0),
    "ilmenite": (0.04, 0.07, 1.0),
    "glass_agglutinate": (0.02, 0.33, 1.4),
}
BANDS = {
    "olivine": [(320, 50, 0.92), (440, 30, 0.12), (600, 40, 0.05), (850, 120, 0.30),
                (1050, 200, 0.55), (650, 25, 0.06), (750, 50, 0.10)],
    "pyroxene": [(320, 45, 0.95), (505, 35, 0.14), (550, 25, 0.06), (670, 30, 0.08),
                 (760, 60, 0.18), (920, 130, 0.65), (430, 35, 0.10)],
    "anorthite": [(300, 45, 0.60), (380, 25, 0.08), (530, 40, 0.03), (660, 50, 0.05), (800, 80, 0.04)],
    "ilmenite": [(300, 50, 0.35), (420, 40, 0.12), (560, 80, 0.15), (700, 40, -0.04), (480, 30, 0.08)],
    "glass_agglutinate": [(320, 40, 0.90), (480, 100, 0.08)],
}
CONTINUUM_NM = (340.0, 850.0)

# Soils as (parents, reddening, darkening, band shallowing).
SOILS = {
    "lunar_highland_soil": ({"anorthite": 1.0}, 0.15, 0.30, 0.60),
    "lunar_mare_soil": ({"pyroxene": 0.55, "olivine": 0.25, "ilmenite": 0.15, "anorthite": 0.05}, 0.30, 0.35, 0.65),
    "lunar_pyroxene_grain": ({"pyroxene": 1.0}, 0.20, 0.20, 0.40),
    "lunar_olivine_grain": ({"olivine": 1.0}, 0.20, 0.20, 0.40),
}
SMOOTHING_SPAN = 15


def mineral_tables(spark) -> tuple[DataFrame, DataFrame]:
    """The continuum and band tables of the pure minerals."""
    continua = spark.createDataFrame(
        [(n, *map(float, c)) for n, c in CONTINUA.items()], "endmember string, level double, rise double, power double")
    bands = spark.createDataFrame(
        [(n, *map(float, b)) for n, bs in BANDS.items() for b in bs],
        "endmember string, centre_nm double, sigma_nm double, depth double")
    return continua, bands


def build_library(continua: DataFrame, bands: DataFrame, grid, key: str = "endmember",
                  window_nm: tuple[float, float] = CONTINUUM_NM, out: str = "spec") -> DataFrame:
    """Spectra on ``grid``: continuum times the product of ``1 - depth * gaussian`` over bands.

    Bands are spread over the grid and multiplied back by a partially aggregated product, so a
    material with very many bands is no single task's work.
    """
    points = F.posexplode(V.literal(grid)).alias("i", "nm")
    z = (F.col("nm") - F.col("centre_nm")) / F.col("sigma_nm")
    factor = 1.0 - F.col("depth") * F.exp(-0.5 * z * z)
    absorbed = (
        bands.select(key, "centre_nm", "sigma_nm", "depth", points)
        .groupBy(key, "i").agg(F.product(factor).alias("through"))
    )
    lo, hi = window_nm
    x = (F.col("nm") - F.lit(lo)) / F.lit(hi - lo)
    base = continua.select(key, "level", "rise", "power", points)
    spectra = base.join(absorbed, [key, "i"], "left").select(
        key, "i",
        V.clip((F.col("level") + F.col("rise") * F.pow(x, F.col("power"))) * F.coalesce("through", F.lit(1.0)), 0.0, 1.0).alias(out))
    return collect_channels(spectra, [key], out)


def build_endmembers(spark, grid, swir_nm) -> DataFrame:
    """The pure-mineral reference table ``(endmember, spec, swir, source)``."""
    continua, bands = mineral_tables(spark)
    spec = build_library(continua, bands, grid)
    swir = build_library(continua, bands, swir_nm, out="swir")
    return spec.join(swir, "endmember").withColumn("source", F.lit("parametric"))


def weather(df: DataFrame, grid, reddening: Column | float = 0.25, darkening: Column | float = 0.25,
            shallowing: Column | float = 0.5, spec: str = "spec", span: int = SMOOTHING_SPAN) -> DataFrame:
    """Space weathering: redden and darken, pull bands towards the running mean, clip to [0, 1]."""
    nm = np.asarray(grid, dtype=float)
    x = V.literal((nm - nm.min()) / (nm.max() - nm.min()))
    as_column = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else v
    red, dark, pull = map(as_column, (reddening, darkening, shallowing))
    out = df.withColumn("_w", F.zip_with(F.col(spec), x, lambda r, t: r * (1.0 + red * t) * (1.0 - dark)))
    out = out.withColumn("_s", kernels.running_mean(nm.size, span)(F.col("_w")))
    return out.withColumn(spec, F.zip_with("_w", "_s", lambda a, b: V.clip((1.0 - pull) * a + pull * b, 0.0, 1.0))).drop("_w", "_s")


def build_soils(endmembers: DataFrame, grid) -> DataFrame:
    """Weathered soil references derived from the pure minerals."""
    out = None
    for name, (parents, red, dark, pull) in SOILS.items():
        soil = weather(weighted_mix(endmembers, parents), grid, red, dark, pull).select(F.lit(name).alias("endmember"), "spec")
        out = soil if out is None else out.unionByName(soil)
    return out


def resample(points: DataFrame, grid, key: str = "spectrum_id", x: str = "nm", y: str = "reflectance",
             out: str = "spec", extremes: tuple[str, ...] = (), accept: Column | None = None) -> DataFrame:
    """Linear interpolation of ``(key, x, y)`` points onto ``grid``, ends held constant.

    Only the first and last point between two neighbouring grid values can matter, so points
    are first reduced to those two per grid cell: a spectrum of any length becomes at most
    ``2 * (len(grid) + 1)`` points, and the reduction is a partial aggregate. Points with a null
    coordinate take no part; a spectrum without others has no row. Of points at one x the largest
    value holds there and to the right of it, the smallest to the left.

    ``accept`` leaves out whole spectra in the same aggregate. It may use ``rows`` (points, null ones
    included) and, for each column of ``extremes``, ``<column>_min`` and ``<column>_max`` over the spectrum.
    """
    nm = np.asarray(grid, dtype=float)
    # Which of the cells between grid values a point falls in: the count of grid values below it.
    cell = F.size(F.filter(V.literal(nm), lambda g: g < F.col(x)))
    point = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(),
                   F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    sides = [(f(c), f"{c}_{side}") for c in extremes for side, f in (("min", F.min), ("max", F.max))]
    ends = points.groupBy(key, cell.alias("_cell")).agg(
        F.min(point).alias("a"), F.max(point).alias("b"), F.count(F.lit(1)).alias("rows"), *[c.alias(n) for c, n in sides])
    folded = ends.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.array("a", "b")))))).alias("_p"),
        F.sum("rows").alias("rows"), *[(F.min(n) if n.endswith("_min") else F.max(n)).alias(n) for _, n in sides])
    kept = folded.where((F.size("_p") > 0) & (F.lit(True) if accept is None else accept))
    order = np.argsort(nm, kind="stable")
    ascending, width = nm[order], len(nm)

    @F.arrow_udf("array<double>")
    def interpolate(p: pa.Array) -> pa.Array:
        xs = p.flatten().field("x").to_numpy(zero_copy_only=False)
        ys = p.flatten().field("y").to_numpy(zero_copy_only=False)
        lengths = p.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        after = np.cumsum(lengths)[:, None]
        start = after - lengths[:, None]
        # A point is at or below grid value j if at most j grid values are below it. Points by (spectrum, that
        # count) are in order already, so one search finds, for every spectrum and grid value, the last such point.
        spectrum = np.repeat(np.arange(len(p)), lengths)
        filed = spectrum * (width + 1) + np.searchsorted(ascending, xs, side="left")
        wanted = np.arange(len(p))[:, None] * (width + 1) + np.arange(width)
        left = np.searchsorted(filed, wanted, side="right") - 1
        low, high = np.clip(left, start, after - 1), np.clip(left + 1, start, after - 1)
        x0, y0, y1 = xs[low], ys[low], ys[high]
        flat = (low == high) | (y0 == y1) | (x0 == ascending)
        gap = np.where(flat, 1.0, xs[high] - x0)
        with np.errstate(invalid="ignore", over="ignore"):
            between = (y1 - y0) / gap * (ascending - x0) + y0
        m = np.empty((len(p), width))
        m[:, order] = np.where(flat, y0, between)
        return kernels.from_matrix(m, np.ones(len(p), dtype=bool))

    return kept.select(key, interpolate("_p").alias(out))


def match_grid(left: DataFrame, right: DataFrame, tolerance_nm: float = 2.0, nm: str = "nm",
               index: str = "i", right_index: str = "j") -> DataFrame:
    """For each left grid point the first right point closer than the tolerance (left kept).

    A range join as an equi-join: points are filed under cells of one tolerance, and a left
    point looks in its own cell and the two beside it.
    """
    cell = lambda c: F.floor(c / F.lit(float(tolerance_nm)))
    near = left.withColumn("_cell", F.explode(F.array(*[cell(F.col(nm)) + d for d in (-1, 0, 1)])))
    other = right.select(F.col(index).alias(right_index), F.col(nm).alias("_nm"), cell(F.col(nm)).alias("_cell"))
    hits = near.join(other, "_cell").where(F.abs(F.col("_nm") - F.col(nm)) < tolerance_nm)
    first = hits.groupBy(index).agg(F.min(right_index).alias(right_index))
    return left.join(first, index, "left")


def overlay(spectra: DataFrame, grid, endmembers: DataFrame, endmember_grid, tolerance_nm: float = 2.0,
            name: str = "endmember", spec: str = "spec") -> DataFrame:
    """Long plot table ``i, nm, measured, endmember, reflectance``: every grid point with each end-member.

    ``measured`` is the channel's mean over ``spectra`` (the value itself for one spectrum); a grid
    point without an end-member channel within the tolerance keeps its row with a null reflectance.
    """
    spark = endmembers.sparkSession
    left = spark.createDataFrame([(i, float(w)) for i, w in enumerate(grid)], "i int, nm double")
    right = spark.createDataFrame([(i, float(w)) for i, w in enumerate(endmember_grid)], "i int, nm double")
    matched = match_grid(left, right, tolerance_nm)
    mean = channel_moments(spectra, spec).select(mean_of()).scalar()
    points = endmembers.select(name, F.col(spec).alias("_pure"), F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("i"))
    return points.join(matched, "i").withColumn("_mean", mean).select(
        "i", "nm", F.get("_mean", F.col("i")).alias("measured"), name, F.get("_pure", F.col("j")).alias("reflectance"))


def check_grid(reference_grid, grid) -> None:
    """Refuse end-members that sit on another wavelength grid."""
    a, b = np.asarray(reference_grid, float), np.asarray(grid, float)
    if a.shape != b.shape or not np.allclose(a, b):
        raise ValueError("the reference spectra are on another wavelength grid")


def endmember_payload(endmembers: DataFrame, name: str = "endmember", spec: str = "spec") -> DataFrame:
    """Reference spectra with their source tag, as served to plots."""
    source = F.col("source") if "source" in endmembers.columns else F.lit("unknown")
    return endmembers.select(name, F.col(spec).alias("reflectance"), source.alias("source"))
