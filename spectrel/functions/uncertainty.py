"""Uncertainty of a probability vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

FLOOR = 1e-12
STATUSES = ("nominal", "borderline", "low_confidence", "likely_ood")


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the status flag; the defaults are the values results must reproduce."""

    low_confidence: float = 0.70
    ood_confidence: float = 0.40
    ood_entropy: float = 1.20
    borderline_margin: float = 0.15


def entropy(p) -> Column:
    """Shannon entropy in nats, probabilities floored at 1e-12."""
    def term(acc, x):
        x = V.clip(x, FLOOR, 1.0)
        return acc - x * F.log(x)

    return F.aggregate(V.col(p), F.lit(0.0), term)


def top_k_margin(p, k: int = 2) -> Column:
    """Largest minus k-th largest probability; shorter vectors are an error."""
    p = V.col(p)
    ranked = F.sort_array(p, asc=False)
    return F.when(F.size(p) < k, F.raise_error(F.lit(f"need at least {k} probabilities"))).otherwise(
        F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(k - 1)))


def status(confidence: Column, ent: Column, margin: Column, t: Thresholds = Thresholds()) -> Column:
    """Out-of-distribution outranks borderline, which outranks low confidence."""
    return (
        F.when((confidence < t.ood_confidence) | (ent > t.ood_entropy), F.lit("likely_ood"))
        .when(margin < t.borderline_margin, F.lit("borderline"))
        .when(confidence < t.low_confidence, F.lit("low_confidence"))
        .otherwise(F.lit("nominal"))
    )


def trustworthy(state="status") -> Column:
    return V.col(state).isin("nominal", "borderline")


def with_uncertainty(df: DataFrame, p: str = "probabilities", t: Thresholds = Thresholds()) -> DataFrame:
    """Add ``class_index, confidence, entropy, margin, status`` for a probability column."""
    return (
        df.withColumns({
            "class_index": V.argmax(F.col(p)),
            "confidence": F.array_max(p),
            "entropy": entropy(p),
            "margin": top_k_margin(p),
        }).withColumn("status", status(F.col("confidence"), F.col("entropy"), F.col("margin"), t))
    )


def temperature_scaled(logits, temperature: float) -> Column:
    """Softmax of logits divided by a temperature."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return V.softmax(F.transform(V.col(logits), lambda z: z / F.lit(float(temperature))))


def retempered(p, temperature: float) -> Column:
    """Probabilities moved to another temperature through their logs."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    if abs(temperature - 1.0) < 1e-9:
        return V.col(p)
    return temperature_scaled(F.transform(V.col(p), lambda x: F.log(V.clip(x, FLOOR, 1.0))), temperature)


def ranked_probabilities(p, names) -> Column:
    """(name, probability) pairs, most likely first; equal ones keep class order."""
    pairs = F.transform(V.col(p), lambda x, i: F.struct((-x).alias("key"), i.alias("i"), x.alias("probability")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct(
        F.get(F.lit(list(names)), s["i"]).alias("name"), s["probability"].alias("probability")))
