"""Train the baselines on a measurement table and evaluate them on held-out samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import vectors as V
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import scoring, splits
from ..session import materialise
from ..sources import stores


@dataclass
class Run:
    model: M.BaselineModel
    splits: DataFrame
    scored: DataFrame
    metrics: DataFrame
    settings: dict


def train(measurements: DataFrame, mode: str = "full", val_frac: float = 0.15, test_frac: float = 0.15,
          seed: int = 0, n_components: int = 8, n_trees: int = 200) -> Run:
    """Split by sample, fit on train, score every row, metrics per split.

    Fails when a sample has two classes (it could land in two splits), when a feature vector has
    not the width of its mode, and when a label is unknown.

    The feature table is written once and read by the fit (several passes) and the scoring.
    """
    table = splits.split_samples(measurements, val_frac, test_frac, seed)
    table = materialise(table, "splits")
    rows = splits.assign_split(measurements, splits.split_cutoffs(table), seed)
    features = M.baseline_features(rows, mode).select(
        "measurement_id", "sample_id", "split", "features", "ilmenite_fraction",
        schema.class_index().alias("class_index"))
    features = materialise(features, "features")
    width = M.baseline_width(mode)
    model = M.fit_baseline(features.where("split = 'train'"), width, n_components, n_trees, seed, key="measurement_id")
    scored = materialise(_scored(features, model), "scored")
    settings = {"model": "baseline", "seed": seed, "sensor_mode": mode, "n_components": n_components, "n_trees": n_trees,
                "val_frac": val_frac, "test_frac": test_frac}
    return Run(model, table, scored, E.metrics(scored, ("split",)), settings)


def _scored(features: DataFrame, model: M.BaselineModel) -> DataFrame:
    truth = features.withColumnsRenamed({"class_index": "class_true", "ilmenite_fraction": "value_true"})
    return scoring.score(truth, model).select(
        "measurement_id", "sample_id", "split", "class_true", F.col("class_index").alias("class_pred"),
        "value_true", F.col("ilmenite_fraction").alias("value_pred"), "probabilities", "status")


def evaluate(run: Run, split: str = "test", n: int = 500, seed: int = 0) -> dict[str, DataFrame]:
    """Report of one split, from the stored split table (never a re-drawn split)."""
    return E.build_report(run.scored.where(F.col("split") == split), len(schema.MINERAL_CLASSES), n=n, seed=seed)


def store(run: Run, path: str, run_id: str) -> None:
    """Keep a run under its id: settings, split table, model, and the temperature fitted on its val rows.

    Storing a run again replaces it; other runs in the folder stay.
    """
    spark = run.scored.sparkSession
    logits = run.scored.withColumn("logits", F.transform("probabilities", lambda p: F.log(F.greatest(p, F.lit(1e-12)))))
    calibration = E.recalibrate(logits, len(schema.MINERAL_CLASSES), label="class_true").first()
    run.model.save(f"{path}/models/{run_id}")
    stores.save_run_splits(run.splits, f"{path}/splits", run_id)
    stores.save_temperature(spark, f"{path}/temperature", run_id, *calibration)
    # The settings come last: a run that can be found is whole.
    stores.save_run(spark, f"{path}/runs", run_id=run_id, **run.settings)


def score_stored(spark: SparkSession, path: str, run_id: str, measurements: DataFrame,
                 held_out: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Held-out measurements scored by a stored run: its model, its split, its temperature.

    Rows are placed by the stored split table, never by a new draw; only held-out rows are featurised.
    ``probabilities`` are recalibrated by the stored temperature, which leaves the predicted class.
    """
    settings = stores.load_run(spark, f"{path}/runs", run_id)
    table = stores.load_run_splits(spark, f"{path}/splits", run_id)
    model = M.BaselineModel.load(spark, f"{path}/models/{run_id}")
    temperature = stores.load_temperature(spark, f"{path}/temperature", run_id).select("temperature").scalar()
    rows = splits.assign_split(measurements, splits.split_cutoffs(table), settings["seed"]).where(F.col("split").isin(*held_out))
    features = M.baseline_features(rows, settings["sensor_mode"]).select(
        "measurement_id", "sample_id", "split", "features", "ilmenite_fraction", schema.class_index().alias("class_index"))
    scored = _scored(materialise(features, "features"), model).withColumn("temperature", temperature)
    warmed = F.transform("probabilities", lambda p: F.log(F.greatest(p, F.lit(1e-12))) / F.col("temperature"))
    return scored.withColumn("probabilities", V.softmax(warmed))


def train_ablation(tables: dict[str, DataFrame], width: int, val_frac: float = 0.15, test_frac: float = 0.15, seed: int = 0,
                   n_components: int = 8, n_trees: int = 200, held_out: str = "test") -> DataFrame:
    """Scored held-out rows of every pair of tables: the model trained on one, tested on the other.

    Each table holds one form of the same samples: ``measurement_id, sample_id, mineral_class, features,
    class_index, ilmenite_fraction``. The split is drawn once over the samples of all tables, so no model
    has seen, in any form, a sample it is tested on. The result has ``train_model`` and ``test_model``.
    """
    samples = None
    for df in tables.values():
        part = df.select("sample_id", "mineral_class")
        samples = part if samples is None else samples.unionByName(part)
    cutoffs = materialise(splits.split_cutoffs(materialise(splits.split_samples(samples, val_frac, test_frac, seed), "splits")), "cutoffs")
    models, tests = {}, {}
    for name, df in tables.items():
        rows = materialise(splits.assign_split(df, cutoffs, seed), "ablation")
        models[name] = M.fit_baseline(rows.where("split = 'train'"), width, n_components, n_trees, seed, key="measurement_id")
        tests[name] = rows.where(F.col("split") == held_out).withColumnsRenamed(
            {"class_index": "class_true", "ilmenite_fraction": "value_true"})
    scored = scoring.cross_models(models, tests)
    return scored.withColumnsRenamed({"class_index": "class_pred", "ilmenite_fraction": "value_pred"})
