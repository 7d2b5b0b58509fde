"""Measurement schema: one row per probe measurement, one array column per sensor block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The wire/CSV contract every file on disk already follows.
SCHEMA_VERSION = "1.2.0"
SPEC_WIDTH, SPEC_MIN_NM, SPEC_MAX_NM = 288, 340.0, 850.0
LED_NM = (385, 405, 450, 500, 525, 590, 625, 660, 730, 780, 850, 940)
SWIR_NM = (940, 1050)
AS7_NM = (410, 435, 460, 485, 510, 535, 560, 585, 610, 645, 680, 705, 730, 760, 810, 860, 900, 940)
MINERAL_CLASSES = (
    "ilmenite_rich", "olivine_rich", "pyroxene_rich", "anorthositic", "glass_agglutinate", "mixed",
)
PACKING_DENSITIES = ("loose", "medium", "packed")
SENSOR_MODES = ("full", "multispectral", "combined")
LIF = "lif_450lp"

SPEC_GRID = np.linspace(SPEC_MIN_NM, SPEC_MAX_NM, SPEC_WIDTH)


class SchemaError(ValueError):
    """A table does not have the columns the schema asks for."""


@dataclass(frozen=True)
class Block:
    """A sensor block: its array column, its per-channel CSV columns, and the modes that carry it."""

    name: str
    columns: tuple[str, ...]
    modes: tuple[str, ...]
    optional: bool = False

    @property
    def width(self) -> int:
        return len(self.columns)


# Order here is the order of blocks in files and in feature vectors.
BLOCKS = (
    Block("spec", tuple(f"spec_{i:03d}" for i in range(SPEC_WIDTH)), ("full", "combined")),
    Block("as7", tuple(f"as7_{w}" for w in AS7_NM), ("multispectral", "combined")),
    Block("swir", tuple(f"swir_{w}" for w in SWIR_NM), SENSOR_MODES, optional=True),
    Block("led", tuple(f"led_{w}" for w in LED_NM), SENSOR_MODES),
)
BLOCK = {b.name: b for b in BLOCKS}

META = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("measurement_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("mineral_class", T.StringType()),
    T.StructField("ilmenite_fraction", T.DoubleType()),
    T.StructField("integration_time_ms", T.IntegerType()),
    T.StructField("ambient_temp_c", T.DoubleType()),
    T.StructField("packing_density", T.StringType()),
])
META_COLUMNS = tuple(META.fieldNames())

MEASUREMENT = T.StructType(
    META.fields
    + [T.StructField("sensor_mode", T.StringType())]
    + [T.StructField(b.name, T.ArrayType(T.DoubleType())) for b in BLOCKS]
    + [T.StructField(LIF, T.DoubleType())]
)

FRAME = T.StructType([
    T.StructField("v", T.IntegerType()),
    T.StructField("integration_time_ms", T.IntegerType()),
    T.StructField("ambient_temp_c", T.DoubleType()),
    T.StructField("spec", T.ArrayType(T.DoubleType())),
    T.StructField("led", T.ArrayType(T.DoubleType())),
    T.StructField("lif_450lp", T.DoubleType()),
    T.StructField("as7", T.ArrayType(T.DoubleType())),
    T.StructField("swir", T.ArrayType(T.DoubleType())),
    T.StructField("_truth", T.StructType([
        T.StructField("mineral_class", T.StringType()),
        T.StructField("ilmenite_fraction", T.DoubleType()),
    ])),
])


def check_mode(mode: str) -> str:
    if mode not in SENSOR_MODES:
        raise ValueError(f"unknown sensor_mode {mode!r}; expected one of {SENSOR_MODES}")
    return mode


def blocks_for_mode(mode: str) -> tuple[Block, ...]:
    check_mode(mode)
    return tuple(b for b in BLOCKS if mode in b.modes)


def columns_for_mode(mode: str = "full") -> tuple[str, ...]:
    """Ordered wide (CSV) columns for a sensor mode."""
    wide = [c for b in blocks_for_mode(mode) for c in b.columns]
    return (*META_COLUMNS, "sensor_mode", *wide, LIF)


def feature_count(mode: str = "full", swir: bool = True) -> int:
    """Width of the feature vector for a mode (one extra for the fluorescence channel)."""
    return 1 + sum(b.width for b in blocks_for_mode(mode) if swir or b.name != "swir")


def mode_from_columns(columns) -> str:
    has = set(columns)
    spec, as7 = BLOCK["spec"].columns[0] in has, BLOCK["as7"].columns[0] in has
    if as7:
        return "combined" if spec else "multispectral"
    return "full"


def detect_mode() -> Column:
    """Stated mode when legal, otherwise read off the blocks the row carries."""
    stated = F.when(F.col("sensor_mode").isin(*SENSOR_MODES), F.col("sensor_mode"))
    carried = (
        F.when(F.col("spec").isNotNull() & F.col("as7").isNotNull(), F.lit("combined"))
        .when(F.col("as7").isNotNull(), F.lit("multispectral"))
        .otherwise(F.lit("full"))
    )
    return F.coalesce(stated, carried)


def check_columns(columns) -> None:
    """Structural check of a wide table: required, unexpected and half-present blocks.

    The required blocks depend on the mode the columns imply, so a table holding only the
    18-band sensor is accepted.
    """
    have = set(columns)
    mode = mode_from_columns(columns)
    needed = [*META_COLUMNS, LIF]
    for block in blocks_for_mode(mode):
        present = [c for c in block.columns if c in have]
        if present and len(present) != block.width:
            raise SchemaError(f"partial {block.name} block: {len(present)} of {block.width} columns")
        if not block.optional:
            needed.extend(block.columns)
    missing = [c for c in needed if c not in have]
    if missing:
        raise SchemaError(f"missing columns: {missing[:8]}")
    known = {*META_COLUMNS, "sensor_mode", LIF, *(c for b in BLOCKS for c in b.columns)}
    extra = [c for c in columns if c not in known]
    if extra:
        raise SchemaError(f"unexpected columns: {extra[:8]}")


def pack(df: DataFrame) -> DataFrame:
    """Wide form (one column per channel) to canonical form (one array per block)."""
    have = set(df.columns)

    def block_column(b: Block) -> Column:
        if b.columns[0] not in have:
            return F.lit(None).cast("array<double>").alias(b.name)
        parts = [F.col(c).cast("double") for c in b.columns]
        # A block whose channels are all null in this row was not measured.
        return F.when(F.coalesce(*parts).isNotNull(), F.array(*parts)).alias(b.name)

    meta = [F.col(f.name).cast(f.dataType).alias(f.name) for f in META.fields]
    stated = F.col("sensor_mode") if "sensor_mode" in have else F.lit(mode_from_columns(df.columns))
    return df.select(
        *meta, stated.cast("string").alias("sensor_mode"),
        *[block_column(b) for b in BLOCKS], F.col(LIF).cast("double").alias(LIF),
    )


def unpack(df: DataFrame, mode: str = "combined") -> DataFrame:
    """Canonical form to the wide columns of ``mode``."""
    channels = [
        F.get(F.col(b.name), F.lit(i)).alias(c)
        for b in blocks_for_mode(mode) for i, c in enumerate(b.columns)
    ]
    return df.select(*META_COLUMNS, "sensor_mode", *channels, LIF)


def class_index(column: str = "mineral_class") -> Column:
    """Class name to its fixed index; null for names outside the label space."""
    at = F.array_position(F.lit(list(MINERAL_CLASSES)), F.col(column))
    return F.when(at > 0, (at - 1).cast("int"))


def class_name(column: str = "class_index") -> Column:
    return F.get(F.lit(list(MINERAL_CLASSES)), F.col(column))
