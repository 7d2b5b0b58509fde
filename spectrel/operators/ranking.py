"""Ranking an unlabelled pool by how much a label would teach."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V

WEIGHTS = (0.4, 0.3, 0.3)


def composite(entropy: Column, margin: Column, disagree: Column, n_classes: int,
              weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Weighted entropy share, closeness of the two best classes, and classifier disagreement."""
    w_entropy, w_margin, w_disagree = weights
    score = (w_entropy * (entropy / math.log(n_classes)) + w_margin * (1.0 - margin)
             + w_disagree * disagree.cast("double"))
    return V.clip(score, 0.0, 1.0)


def acquisition(pool: DataFrame, second: DataFrame, key: str, n_classes: int,
                weights: tuple[float, float, float] = WEIGHTS, second_class: str = "sam_index") -> DataFrame:
    """Scores of every pool row. ``pool`` carries the first classifier's uncertainty columns,
    ``second`` the other's class. Both must hold the same keys; a stray key fails the job."""
    a = pool.select(key, "class_index", "confidence", "entropy", "margin", "status").withColumn("_a", F.lit(True))
    b = second.select(key, F.col(second_class).alias("second_class")).withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    paired = F.when(F.col("_a") & F.col("_b"), F.col("class_index") != F.col("second_class")).otherwise(
        F.raise_error(F.lit("pool and second classifier hold different keys")))
    return both.withColumn("disagreement", paired).withColumns({
        "entropy_norm": F.col("entropy") / F.lit(math.log(n_classes)),
        "composite": composite(F.col("entropy"), F.col("margin"), F.col("disagreement"), n_classes, weights),
    }).select(key, "class_index", "second_class", "confidence", "entropy_norm", "margin",
              "disagreement", "composite", "status")


def top(scores: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Best first, input order (the key) on ties; ``k`` rows when given (a heap per task)."""
    ordered = scores.orderBy(F.desc("composite"), key)
    return ordered if k is None else ordered.limit(k)


def rank_pool(pool: DataFrame, second: DataFrame, key: str, n_classes: int, k: int | None = None,
              weights: tuple[float, float, float] = WEIGHTS, second_class: str = "sam_index") -> DataFrame:
    return top(acquisition(pool, second, key, n_classes, weights, second_class), key, k)


def disagreement_rate(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.avg(F.col("disagreement").cast("double")), F.lit(0.0)).alias("disagreement_rate"))


def latest(log: DataFrame, ts: str, key: str, k: int = 10, by: str | None = None) -> DataFrame:
    """The ``k`` newest entries, newest first; per group when ``by`` is given.

    Grouped, the window group limit prunes each task to ``k`` rows a group before the shuffle.
    """
    if by is None:
        return log.orderBy(F.desc(ts), F.desc(key)).limit(k)
    order = W.partitionBy(by).orderBy(F.desc(ts), F.desc(key))
    return log.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
