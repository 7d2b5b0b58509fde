"""The scorer contract and what happens around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import kernels
from ..functions import vectors as V
from ..functions.uncertainty import Thresholds, with_uncertainty


class Scorer(Protocol):
    """Anything that adds ``probabilities`` and ``ilmenite_fraction`` to rows with ``features``."""

    def score(self, df: DataFrame) -> DataFrame: ...


class ColumnScorer:
    """Scorer made of column expressions."""

    def __init__(self, probabilities, ilmenite):
        self.probabilities, self.ilmenite = probabilities, ilmenite

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"probabilities": self.probabilities, "ilmenite_fraction": self.ilmenite})


class BatchScorer:
    """Scorer around a numpy model ``matrix -> (logits, ilmenite)``, called once per Arrow batch.

    ``load`` runs once per task, so an ONNX session or any other model object lives on the
    executor and is never sent over. Rows of another width, or null, come out null.
    """

    def __init__(self, load: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]],
                 width: int, features: str = "features"):
        self.load, self.width, self.features = load, width, features

    def score(self, df: DataFrame) -> DataFrame:
        load, width, features = self.load, self.width, self.features
        out = T.StructType(df.schema.fields + [
            T.StructField("logits", T.ArrayType(T.DoubleType())),
            T.StructField("ilmenite_fraction", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                m, good = kernels.to_matrix(batch.column(batch.schema.get_field_index(features)), width)
                if len(m):
                    logits, ilmenite = model(m.astype(np.float32))
                    scores = kernels.from_matrix(np.asarray(logits, dtype=float), good)
                    value = np.full(len(good), np.nan)
                    value[good] = np.asarray(ilmenite, dtype=float).ravel()
                    value = pa.array(value, mask=~good)
                else:
                    scores = pa.nulls(batch.num_rows, pa.list_(pa.float64()))
                    value = pa.nulls(batch.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, scores, value], names=[*batch.schema.names, "logits", "ilmenite_fraction"])

        scored = df.mapInArrow(run, out)
        return scored.withColumn("probabilities", V.softmax(F.col("logits")))


def onnx_scorer(path: str, width: int) -> BatchScorer:
    """Scorer for an ONNX model with (logits, ilmenite) outputs and (batch, 1, width) input.

    ``path`` must be readable on every executor.
    """
    def load():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda m: session.run(None, {name: m[:, None, :]})

    return BatchScorer(load, width)


def score(df: DataFrame, scorer: Scorer, mode: str | None = None, features: str = "features",
          t: Thresholds = Thresholds()) -> DataFrame:
    """Score rows: width check, probabilities, first-largest class, clipped ilmenite, uncertainty.

    With a ``mode``, a feature vector of another width fails the job before the model sees it.
    """
    if mode is not None:
        width = schema.feature_count(mode)
        df = df.withColumn(features, F.when(F.size(features) == width, F.col(features)).otherwise(
            F.raise_error(F.concat(F.lit(f"sensor_mode {mode} expects {width} features, got "),
                                   F.coalesce(F.size(features), F.lit(0)).cast("string")))))
    scored = scorer.score(df)
    scored = scored.withColumn("ilmenite_fraction", V.clip(F.col("ilmenite_fraction"), 0.0, 1.0))
    return with_uncertainty(scored, "probabilities", t)


def payload(scored: DataFrame, names=schema.MINERAL_CLASSES, version: str = "") -> DataFrame:
    """Scored rows in the shape the prediction service answers with."""
    return scored.withColumns({
        "predicted_class": F.get(F.lit(list(names)), F.col("class_index")),
        "probabilities": F.transform("probabilities", lambda x, i: F.struct(
            F.get(F.lit(list(names)), i).alias("name"), x.alias("probability"))),
        "model_version": F.lit(version),
    }).withColumnRenamed("class_index", "predicted_class_index")


def cross_models(scorers: dict[str, Scorer], tests: dict[str, DataFrame]) -> DataFrame:
    """Every model on every test set: the long scored table behind an ablation."""
    out = None
    for model, scorer in scorers.items():
        for name, df in tests.items():
            part = score(df, scorer).withColumns({"train_model": F.lit(model), "test_model": F.lit(name)})
            out = part if out is None else out.unionByName(part)
    return out
