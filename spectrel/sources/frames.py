"""Wire frames: one JSON object per line, from files, sockets or a message bus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import vectors as V
from ..operators import rules

CORRUPT = "_corrupt"


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Text lines to frame columns. Blank lines go; a line that is not a JSON object of the frame's
    types keeps its text in ``_corrupt``. Unknown keys are ignored."""
    kept = lines.where(F.length(F.trim(line)) > 0)
    target = T.StructType(schema.FRAME.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(line), target, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return V.once(kept, "_f", parsed).select(*lines.columns, "_f.*")


def check_frames(frames: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """Frames with the list of violated rules; a line that did not parse has the single reason
    ``malformed``."""
    # A line that did not parse breaks many rules; only the parse failure is reported.
    parsed = {name: F.col(CORRUPT).isNull() & F.coalesce(bad, F.lit(True))
              for name, bad in rules.frame_rules(widths).items()}
    return rules.check(frames, {"malformed": F.col(CORRUPT).isNotNull(), **parsed})


def validate_lines(lines: DataFrame, line: str = "value", widths: dict[str, int] | None = None) -> DataFrame:
    return check_frames(parse_lines(lines, line), widths)


def valid(checked: DataFrame) -> DataFrame:
    return rules.good(checked).drop(CORRUPT)


def quarantine(checked: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Rejected lines: the text and why."""
    return rules.quarantined(checked).select(F.col(line).alias("line"), F.array_join("violations", ",").alias("reason"), *(keep or []))


def reasons() -> list[str]:
    """Everything a line can be rejected for."""
    return ["malformed", *rules.frame_rules()]


def to_measurement(scored: DataFrame, sample_id: Column, packing_density: Column, identity: list[str],
                   timestamp: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Scored frames as canonical measurements.

    The id is a hash of where the frame came from (``identity``, e.g. source and offset), so a
    replayed frame gets the same id and can be dropped as a duplicate.
    """
    return scored.select(
        sample_id.cast("string").alias("sample_id"),
        F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in identity]), 256).alias("measurement_id"),
        (F.current_timestamp() if timestamp is None else timestamp).cast("string").alias("timestamp"),
        schema.class_name("class_index").alias("mineral_class"),
        F.col("ilmenite_fraction"),
        "integration_time_ms", "ambient_temp_c",
        packing_density.cast("string").alias("packing_density"),
        F.when(F.col("as7").isNotNull(), F.lit("combined")).otherwise(F.lit("full")).alias("sensor_mode"),
        *[b.name for b in schema.BLOCKS], schema.LIF, *(keep or []),
    )
