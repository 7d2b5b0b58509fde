"""Row rules: every violated rule is named, bad rows go to quarantine instead of stopping the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import vectors as V

Rules = dict[str, Column]


def absent(c: str) -> Column:
    return F.col(c).isNull() | (F.length(F.col(c)) == 0)


def not_in(c: str, allowed) -> Column:
    return F.col(c).isNull() | ~F.col(c).isin(*allowed)


def outside(c: Column, lo: float, hi: float) -> Column:
    return c.isNull() | F.isnan(c) | (c < lo) | (c > hi)


def block_rules(required_when: dict[str, Column], widths: dict[str, int] | None = None) -> Rules:
    """Presence, width and finiteness of each array block."""
    out: Rules = {}
    for block in schema.BLOCKS:
        a = F.col(block.name)
        width = (widths or {}).get(block.name, block.width)
        needed = required_when.get(block.name)
        if needed is not None:
            out[f"{block.name}_missing"] = a.isNull() & needed
        out[f"{block.name}_width"] = a.isNotNull() & (F.size(a) != width)
        out[f"{block.name}_not_finite"] = a.isNotNull() & ~V.all_finite(a)
    return out


def measurement_rules(widths: dict[str, int] | None = None) -> Rules:
    """Rules of the canonical measurement row."""
    mode = F.col("sensor_mode")
    return {
        **{f"{c}_empty": absent(c) for c in ("sample_id", "measurement_id", "timestamp")},
        "sensor_mode": mode.isNotNull() & ~mode.isin(*schema.SENSOR_MODES),
        "mineral_class": not_in("mineral_class", schema.MINERAL_CLASSES),
        "packing_density": not_in("packing_density", schema.PACKING_DENSITIES),
        "ilmenite_fraction": outside(F.col("ilmenite_fraction"), 0.0, 1.0),
        "integration_time_ms": F.col("integration_time_ms").isNull() | (F.col("integration_time_ms") <= 0),
        "ambient_temp_c": F.col("ambient_temp_c").isNull(),
        **block_rules({
            "spec": schema.detect_mode().isin("full", "combined"),
            "as7": schema.detect_mode().isin("multispectral", "combined"),
            "led": F.lit(True),
        }, widths),
        "lif_not_finite": ~V.is_finite(F.col(schema.LIF)),
    }


def frame_rules(widths: dict[str, int] | None = None) -> Rules:
    """Rules of a parsed wire frame."""
    truth = F.col("_truth.ilmenite_fraction")
    # An empty truth object is no truth.
    has_truth = F.col("_truth.mineral_class").isNotNull() | truth.isNotNull()
    return {
        "version": F.col("v").isNull() | (F.col("v") != 1),
        "integration_time_ms": F.col("integration_time_ms").isNull() | (F.col("integration_time_ms") <= 0),
        "ambient_temp_c": F.col("ambient_temp_c").isNull(),
        **block_rules({"spec": F.lit(True), "led": F.lit(True)}, widths),
        "lif_not_finite": ~V.is_finite(F.col(schema.LIF)),
        "truth_class": has_truth & F.col("_truth.mineral_class").isNull(),
        "truth_fraction": has_truth & outside(truth, 0.0, 1.0),
    }


def check(df: DataFrame, rules: Rules, out: str = "violations") -> DataFrame:
    """Add the names of the violated rules (empty for a good row)."""
    named = [F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]
    return V.once(df, out, F.array_compact(F.array(*named)))


def good(checked: DataFrame, column: str = "violations") -> DataFrame:
    return checked.where(F.size(column) == 0).drop(column)


def quarantined(checked: DataFrame, column: str = "violations") -> DataFrame:
    return checked.where(F.size(column) > 0)


def require(df: DataFrame, rules: Rules) -> DataFrame:
    """The rows, with the first bad one failing the job in the same pass that uses them."""
    checked = check(df, rules)
    # The filter keeps the check alive when later steps read only a few columns.
    guard = F.when(F.size("violations") > 0, F.raise_error(
        F.concat(F.lit("invalid measurement: "), F.array_join("violations", ", ")))).otherwise(F.lit(True))
    return checked.where(guard).drop("violations")


def unknown_values(df: DataFrame, column: str, allowed) -> DataFrame:
    """Distinct values of an enumeration column outside the allowed set."""
    return df.where(not_in(column, allowed)).select(column).distinct()
