"""Reference spectra from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import clip
from ..operators import library as L
from ..operators.mixing import with_swir


def _ascii_lines(spark: SparkSession, path: str, pattern: str, name: Column | None) -> DataFrame:
    """Every line with its numbers, its count of parts, and whether a part is no number."""
    lines = (
        spark.read.option("pathGlobFilter", pattern).text(path)
        .select((F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1) if name is None else name).alias("spectrum_id"),
                F.trim(F.regexp_replace("value", "#.*$", "")).alias("text"))
        .where(F.length("text") > 0)
        .select("spectrum_id", F.split("text", r"\s+").alias("parts"))
    )
    number = lambda i: F.get("parts", F.lit(i)).try_cast("double")
    bad = F.exists("parts", lambda s: s.try_cast("double").isNull()) | (F.size("parts") < 2)
    return lines.select("spectrum_id", number(0).alias("nm"), number(1).alias("reflectance"),
                        bad.alias("bad"), F.size("parts").alias("width"))


#: What a sound file is, over the extremes of its lines.
_SOUND = "not bad_max and width_min = width_max and rows >= 2"


def read_ascii_points(spark: SparkSession, path: str, pattern: str = "*.txt", name: Column | None = None) -> DataFrame:
    """Points ``(spectrum_id, nm, reflectance)`` of a folder of two-column text files.

    Spectra are named after their files, or by ``name``, an expression over ``_metadata``.

    A file with a line that is not two or more numbers, with unequal line lengths, or with fewer
    than two points is left out whole. ``#`` starts a comment. The whole-file check is a pass of its own;
    :func:`read_ascii_library` folds it into the resampling.
    """
    points = _ascii_lines(spark, path, pattern, name)
    sound = points.groupBy("spectrum_id").agg(
        F.max("bad").alias("bad_max"), F.min("width").alias("width_min"), F.max("width").alias("width_max"), F.count("*").alias("rows")
    ).where(_SOUND).select("spectrum_id")
    return points.join(sound, "spectrum_id", "left_semi").select("spectrum_id", "nm", "reflectance")


def read_ascii_library(spark: SparkSession, path: str, grid, pattern: str = "*.txt", name: Column | None = None) -> DataFrame:
    """Folder of text spectra resampled to ``grid`` and clipped to [0, 1], read once; files that
    :func:`read_ascii_points` leaves out are left out."""
    spectra = L.resample(_ascii_lines(spark, path, pattern, name), grid, extremes=("bad", "width"), accept=F.expr(_SOUND))
    return spectra.withColumn("spec", F.transform("spec", lambda x: clip(x, 0.0, 1.0)))


def write_endmembers(endmembers: DataFrame, path: str, grid) -> None:
    """Reference table with the grid it sits on."""
    endmembers.withColumn("grid_nm", F.lit([float(x) for x in grid])).write.mode("overwrite").parquet(path)


def read_endmembers(spark: SparkSession, path: str, grid) -> DataFrame:
    """Reference table; refused when it sits on another grid. Missing short-wave values are guessed."""
    df = spark.read.parquet(path)
    first = df.select("grid_nm").first()
    if first is None:
        raise ValueError(f"no reference spectra in {path}")
    L.check_grid(first["grid_nm"], grid)
    return with_swir(df.drop("grid_nm"))
