"""Small result tables kept between jobs: calibration profiles, runs, splits, temperature, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.reflectance import REFERENCE_TEMP_C

PROFILE = T.StructType([
    T.StructField("profile_id", T.StringType()),
    T.StructField("dark_intercept", T.ArrayType(T.DoubleType())),
    T.StructField("dark_slope", T.ArrayType(T.DoubleType())),
    T.StructField("white", T.ArrayType(T.DoubleType())),
    T.StructField("white_integration_ms", T.DoubleType()),
    T.StructField("dark_integration_ms", T.DoubleType()),
    T.StructField("reference_temp_c", T.DoubleType()),
    T.StructField("n_temperatures_fitted", T.LongType()),
    T.StructField("fit_residual_mean", T.DoubleType()),
])
PROFILE_DEFAULTS = {
    "reference_temp_c": REFERENCE_TEMP_C, "n_temperatures_fitted": 0, "fit_residual_mean": 0.0,
}


def save_profiles(profiles: DataFrame, path: str) -> None:
    profiles.select(*[F.col(f.name).cast(f.dataType) if f.name in profiles.columns else
                      F.lit(None).cast(f.dataType).alias(f.name) for f in PROFILE.fields]
                    ).write.mode("overwrite").parquet(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles, with defaults for fields an older table lacks."""
    return spark.read.schema(PROFILE).parquet(path).fillna(PROFILE_DEFAULTS)


def save_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").parquet(path)


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


RUN = "run_id string, model string, seed bigint, sensor_mode string, n_components int, n_trees int, val_frac double, test_frac double"
TEMPERATURE = "run_id string, temperature double, ece_before double, ece_after double"


def _replace_run(df: DataFrame, path: str) -> None:
    """Put the rows of the runs in ``df`` in place of what the table holds of these runs; others stay.

    A retried or repeated write therefore leaves each run once.
    """
    df.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def save_run(spark: SparkSession, path: str, **run) -> None:
    """A run's settings (everything needed to find its split again)."""
    fields = [f.strip().split()[0] for f in RUN.split(",")]
    _replace_run(spark.createDataFrame([tuple(run.get(f) for f in fields)], RUN), path)


def load_run(spark: SparkSession, path: str, run_id: str) -> dict:
    row = spark.read.schema(RUN).parquet(path).where(F.col("run_id") == run_id).first()
    if row is None:
        raise KeyError(run_id)
    return row.asDict()


def save_run_splits(splits: DataFrame, path: str, run_id: str) -> None:
    """The split table a run was trained on."""
    _replace_run(splits.withColumn("run_id", F.lit(run_id)), path)


def load_run_splits(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    # Ids that look like numbers would be read as such, so the type is stated.
    found = spark.read.parquet(path).schema
    stated = T.StructType([T.StructField(f.name, T.StringType() if f.name == "run_id" else f.dataType) for f in found.fields])
    return spark.read.schema(stated).parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def save_temperature(spark: SparkSession, path: str, run_id: str, temperature: float, ece_before: float, ece_after: float) -> None:
    """A run's calibration, in place of an earlier one."""
    _replace_run(spark.createDataFrame([(run_id, float(temperature), float(ece_before), float(ece_after))], TEMPERATURE), path)


def load_temperature(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The stored calibration of a run."""
    return spark.read.schema(TEMPERATURE).parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """Every table of a report as JSON under its name."""
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_ablation(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def read_ablation(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of metrics by (train_model, test_model)."""
    return spark.read.csv(path, header=True, schema="train_model string, test_model string, n bigint, "
                          "top1_acc double, ilm_rmse double, ilm_r2 double")
