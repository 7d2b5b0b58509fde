"""Baseline models: random forest for the class, partial least squares for the fraction."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import features as FX
from ..functions import kernels
from ..functions import vectors as V
from .forest import Forest, fit_forest


def baseline_features(df: DataFrame, mode: str = "full", include_swir: bool = False, out: str = "features") -> DataFrame:
    """Model input of the baselines: smoothed spectrum, [18 bands,] LEDs, fluorescence and the
    eight spectral features; multispectral rows use their raw channels."""
    schema.check_mode(mode)
    names = df.columns
    swir = [F.col("swir")] if include_swir else []
    if mode == "multispectral":
        return df.withColumn(out, F.concat(F.col("as7"), *swir, F.col("led"), F.array(schema.LIF)))
    smoothed = df.withColumn("_s", kernels.savgol(schema.SPEC_WIDTH)(F.col("spec")))
    expert = FX.spectral_features(smoothed, spec="_s")
    bands = [F.col("as7")] if mode == "combined" else []
    vector = F.concat(F.col("_s"), *bands, *swir, F.col("led"), F.array(schema.LIF), F.array(*FX.SPECTRAL_FEATURES))
    return expert.select(*names, vector.alias(out))


def baseline_width(mode: str = "full", include_swir: bool = False) -> int:
    """Length of the vectors of :func:`baseline_features`."""
    return schema.feature_count(mode, include_swir) + (0 if mode == "multispectral" else len(FX.SPECTRAL_FEATURES))


# ---------------------------------------------------------------- moments


#: Most summaries the last merging task may receive.
MAX_FAN = 1_024


@dataclass(frozen=True)
class Moments:
    """Sums over rows of ``[1, x, y]`` outer products: everything the linear models need."""

    n: float
    mean: np.ndarray
    cov: np.ndarray  # population covariance of (x..., y)

    @property
    def std(self) -> np.ndarray:
        s = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        return np.where(s < 1e-9, 1.0, s)


def _merge(a, b):
    """Combine two (n, mean, scatter) summaries without cancelling large sums."""
    na, ma, sa = a
    nb, mb, sb = b
    n = na + nb
    d = mb - ma
    return n, ma + d * (nb / n), sa + sb + np.outer(d, d) * (na * nb / n)


def moments(df: DataFrame, width: int, features: str = "features", target: str = "target") -> Moments:
    """Count, mean and covariance of the features and the target in one pass over the rows.

    Each task streams its batches into one summary of (width + 1)^2 numbers. Summaries are
    merged on as many tasks as the session shuffles to (at most :data:`MAX_FAN`), and those few
    by a last task, so no task or driver receives one summary per input partition. A null target
    and features that are null or of another width fail the job.
    """
    columns = "n double, mean array<double>, scatter array<double>"
    k = width + 1

    def emit(total):
        n, mean, scatter = total
        return pa.RecordBatch.from_pydict({
            "n": pa.array([float(n)]), "mean": pa.array([mean.tolist()]),
            "scatter": pa.array([scatter.ravel().tolist()])})

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch, x in kernels.batches_as_matrix(batches, "x", width):
            m = np.column_stack([x, batch.column("y").to_numpy(zero_copy_only=False)])
            mean = m.mean(axis=0)
            c = m - mean
            part = (len(m), mean, c.T @ c)
            total = part if total is None else _merge(total, part)
        if total is not None:
            yield emit(total)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, mean, scatter in zip(batch.column("n"), batch.column("mean"), batch.column("scatter")):
                part = (n.as_py(), mean.values.to_numpy(), scatter.values.to_numpy().reshape(k, k))
                total = part if total is None else _merge(total, part)
        if total is not None:
            yield emit(total)

    y = F.coalesce(F.col(target).cast("double"), F.raise_error(F.lit("null target")).cast("double"))
    rows = df.select(F.col(features).alias("x"), y.alias("y"))
    fan = min(MAX_FAN, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = rows.mapInArrow(summarise, columns).repartition(fan).mapInArrow(combine, columns)
    final = parts.repartition(1).mapInArrow(combine, columns).collect()
    if not final:
        raise ValueError("no rows to fit on")
    n, mean, scatter = final[0]
    return Moments(n, np.array(mean), np.array(scatter).reshape(k, k) / n)


# ---------------------------------------------------------------- partial least squares


def pls_coefficients(xx: np.ndarray, xy: np.ndarray, n_components: int) -> np.ndarray:
    """Single-response partial least squares from the centred X'X and X'y.

    Works on the covariances alone: each component's direction is the covariance with the
    response that earlier components left unexplained.
    """
    k = len(xy)
    left = xy.astype(float).copy()
    scale = np.linalg.norm(xy)
    weights, loadings, gains = [], [], []
    for _ in range(n_components):
        length = np.linalg.norm(left)
        if length <= 1e-12 * max(scale, 1e-300):
            break
        r = left / length
        # Turn the direction away from what earlier components already span.
        for w, p in zip(weights, loadings):
            r = r - w * (p @ r)
        t2 = r @ xx @ r
        if t2 <= 0:
            break
        p = xx @ r / t2
        q = (xy @ r) / t2
        weights.append(r)
        loadings.append(p)
        gains.append(q)
        left = left - p * (q * t2)
    beta = np.zeros(k)
    for r, q in zip(weights, gains):
        beta += r * q
    return beta


@dataclass(frozen=True)
class PlsModel:
    coefficients: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """Linear prediction clipped to [0, 1]."""
        value = kernels.linear_kernel(self.coefficients[None, :], np.array([self.intercept]))(F.col(features))
        return df.withColumn(out, V.clip(F.get(value, F.lit(0)), 0.0, 1.0))


def components_for(n_rows: float, width: int, wanted: int = 8) -> int:
    return int(max(1, min(wanted, n_rows - 1, width)))


def fit_pls(m: Moments, n_components: int = 8, standardise: bool = True) -> PlsModel:
    """Fit from the moments; features are standardised by them, the response only centred."""
    k = len(m.mean) - 1
    std = m.std[:k] if standardise else np.ones(k)
    xx = m.cov[:k, :k] / np.outer(std, std)
    xy = m.cov[:k, k] / std
    beta = pls_coefficients(xx, xy, components_for(m.n, k, n_components)) / std
    return PlsModel(beta, float(m.mean[k] - beta @ m.mean[:k]))


# ---------------------------------------------------------------- the baseline pair


@dataclass
class BaselineModel:
    """Forest and regression over the same features; a :class:`~spectrel.operators.scoring.Scorer`."""

    forest: Forest
    pls: PlsModel
    features: str = "features"

    def score(self, df: DataFrame) -> DataFrame:
        return self.pls.predict(self.forest.score(df, self.features), self.features, "ilmenite_fraction")

    def save(self, path: str) -> None:
        """The forest's tables, and the regression as one parquet row next to them."""
        self.forest.save(f"{path}/forest")
        SparkSession.active().createDataFrame(
            [(self.pls.coefficients.tolist(), self.pls.intercept, self.features)],
            "coefficients array<double>, intercept double, features string",
        ).write.mode("overwrite").parquet(f"{path}/linear")

    @classmethod
    def load(cls, spark, path: str) -> BaselineModel:
        row = spark.read.parquet(f"{path}/linear").first()
        return cls(Forest.load(spark, f"{path}/forest"), PlsModel(np.array(row["coefficients"]), row["intercept"]), row["features"])


def fit_baseline(train: DataFrame, width: int, n_components: int = 8, n_trees: int = 200, seed: int = 0,
                 features: str = "features", label: str = "class_index", target: str = "ilmenite_fraction",
                 max_bins: int = 64, key: str | None = None) -> BaselineModel:
    """Fit both models: one pass gathers the moments, the forest makes its own (:func:`~spectrel.operators.forest.fit_forest`).

    Trees grow until their leaves are pure; ``max_bins`` are the split candidates of a feature. A split
    compares one feature with itself, so the forest needs no standardising. Null labels fail the job.
    """
    rows = train.select(features, label, F.col(target).alias("target"), *([key] if key else []))
    m = moments(rows, width, features, "target")
    forest = fit_forest(rows, width, n_trees=n_trees, seed=seed, features=features, label=label, key=key, max_bins=max_bins)
    return BaselineModel(forest, fit_pls(m, n_components), features)
