"""Several shots of one sample to one prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.uncertainty import Thresholds, with_uncertainty

METHODS = ("mean", "vote")


def fuse(scored: DataFrame, n_classes: int, sample: str = "sample_id", p: str = "probabilities",
         ilmenite: str = "ilmenite_fraction", method: str = "mean", t: Thresholds = Thresholds()) -> DataFrame:
    """Mean of the probabilities (or share of the votes) per sample, then the usual uncertainty.

    One partially aggregated sum per class: a sample with any number of shots stays cheap.
    """
    if method == "mean":
        parts = [F.avg(F.get(p, F.lit(k))) for k in range(n_classes)]
    elif method == "vote":
        vote = V.argmax(F.col(p))
        parts = [F.count_if(vote == k) / F.count(p) for k in range(n_classes)]
    else:
        raise ValueError(f"unknown fusion method {method!r}; expected one of {METHODS}")
    fused = scored.groupBy(sample).agg(
        F.array(*parts).alias(p), V.clip(F.avg(ilmenite), 0.0, 1.0).alias(ilmenite), F.count(p).alias("fused_n"))
    return with_uncertainty(fused, p, t).withColumn("fusion_method", F.lit(method))
