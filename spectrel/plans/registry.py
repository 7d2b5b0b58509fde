"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


#: Columns that are 32-bit on Spark where the SQL engine counts in 64 bits.
POSITION = ("i",)
NARROW: dict[str, tuple[str, ...]] = {
    "ranked_class_probabilities": ("rank",), "reliability_table": ("bin",), "latest_log_entries": ("rank",),
    "sam_confusion_matrix": ("class_true", "class_pred"), "sam_class_report": ("class_index",),
    "sam_failure_targets": ("class_true", "class_pred", "rank"),
    **dict.fromkeys((
        "averaged_reads", "temperature_scaled_probabilities", "retempered_probabilities", "ascii_library",
        "channel_standardiser", "standardised_spectra", "class_mean_spectra", "sam_pseudo_probabilities",
        "smoothed_spectra", "derivative_spectra", "continuum_removed_spectra", "running_mean_spectra",
        "led_band_response", "multispectral_band_response", "band_window_means", "expert_features_by_mode",
        "linear_mixtures", "intimate_mixtures", "intimate_mixtures_by_join", "albedo_roundtrip",
        "band_model_library", "weathered_spectra", "resampled_curves", "reference_overlay"), POSITION),
}


def _typed(name: str, sql: str) -> str:
    narrow = NARROW.get(name)
    if not narrow:
        return sql
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in narrow)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def query(*ids: str, sql: str | None = None):
    """Register a query under its function name, the inventory rows it covers and its SQL twin."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        COVERS[fn.__name__] = ids
        if sql is not None:
            ORACLES[fn.__name__] = _typed(fn.__name__, sql)
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from . import q_calibration, q_evaluation, q_ingest, q_models, q_spectra, q_splits  # noqa: F401
