"""Measurement tables: wide CSV at the edges, array columns in parquet inside."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators import rules


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder (reads one line)."""
    return spark.read.option("header", True).csv(path).columns


def _wide_schema(columns: list[str]) -> T.StructType:
    meta = {f.name: f for f in schema.META.fields}
    text = T.StringType()
    return T.StructType([
        meta.get(c) or T.StructField(c, text if c == "sensor_mode" else T.DoubleType()) for c in columns])


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV with declared types: no inference pass, header names checked against every file."""
    columns = _header(spark, path)
    schema.check_columns(columns)
    return spark.read.schema(_wide_schema(columns)).csv(path, header=True, enforceSchema=False)


def read_measurements(spark: SparkSession, path: str, validate: str = "fail") -> DataFrame:
    """Canonical measurements of a CSV file or folder.

    ``validate``: ``fail`` stops at the first bad row, ``tag`` adds a ``violations`` column (see
    :func:`spectrel.operators.rules.good` and ``quarantined``), ``none`` skips the rules.
    A value that does not parse reads as null and so breaks its column's rule.
    """
    df = schema.pack(read_wide_csv(spark, path))
    if validate == "fail":
        return rules.require(df, rules.measurement_rules())
    if validate == "tag":
        return rules.check(df, rules.measurement_rules())
    if validate == "none":
        return df
    raise ValueError(f"unknown validation {validate!r}")


def write_measurements_csv(df: DataFrame, path: str, mode: str = "combined", overwrite: bool = False) -> None:
    """Wide CSV in canonical order; an invalid row fails the write. An empty table still gets a header."""
    valid = rules.require(df, rules.measurement_rules())
    writer = schema.unpack(valid, mode).write.mode("overwrite" if overwrite else "errorifexists")
    writer.csv(path, header=True)


def write_measurements(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet partitioned by sensor mode, with the schema version in every file's data."""
    valid = rules.require(df, rules.measurement_rules()).withColumn("schema_version", F.lit(schema.SCHEMA_VERSION))
    valid.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("sensor_mode").parquet(path)


def read_measurement_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet measurements; refuses rows written under another schema version."""
    stored = T.StructType(schema.MEASUREMENT.fields + [T.StructField("schema_version", T.StringType())])
    df = spark.read.schema(stored).parquet(path)
    same = F.when(F.col("schema_version") == schema.SCHEMA_VERSION, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unsupported schema version "), F.coalesce("schema_version", F.lit("none")))))
    return df.where(same).select(*schema.MEASUREMENT.fieldNames())


LED_PATTERN = re.compile(r"^led_(\d+)$")


def read_tolerant_csv(spark: SparkSession, path: str) -> DataFrame:
    """Uploads: whatever other columns a file has, take ``spec_*``, ``led_<nm>`` in numeric order
    and the fluorescence column. ``rejected`` marks rows with a value that is not a number."""
    columns = [c.strip() for c in _header(spark, path)]
    spec = list(schema.BLOCK["spec"].columns)
    missing = [c for c in [*spec, schema.LIF] if c not in columns]
    if missing:
        raise schema.SchemaError(f"missing columns: {missing[:8]}")
    led = sorted((c for c in columns if LED_PATTERN.match(c)), key=lambda c: int(LED_PATTERN.match(c)[1]))
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True).csv(path).toDF(*columns)
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    df = raw.select(
        F.array(*map(number, spec)).alias("spec"),
        (F.array(*map(number, led)) if led else F.array().cast("array<double>")).alias("led"),
        number(schema.LIF).alias(schema.LIF))
    bad = lambda x: x.isNull() | F.isnan(x)
    return df.withColumn("rejected", F.exists("spec", bad) | F.exists("led", bad) | bad(F.col(schema.LIF)))


def block(df: DataFrame, name: str) -> DataFrame:
    """One sensor block as a one-column projection (reads nothing else from parquet)."""
    if name not in df.columns:
        raise KeyError(name)
    return df.select(name)
