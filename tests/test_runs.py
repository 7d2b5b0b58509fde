"""Runs kept in a registry, and ablation over trained models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel import schema
from spectrel.operators import evaluate as E
from spectrel.operators import models as M
from spectrel.operators import scoring, splits
from spectrel.plans import train_evaluate as TE
from spectrel.session import scratch_path
from spectrel.sources import stores


def measured(spark, n=240, seed=0):
    """Multispectral rows whose first bands tell the class and whose fluorescence tells the fraction."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        k = i % 6
        as7, frac = rng.uniform(.2, .4, 18), float(rng.uniform())
        as7[k] += .4 * rng.uniform()
        rows.append((f"S{i % 60}", f"m{i}", "2024-01-01T00:00:00", schema.MINERAL_CLASSES[k], frac, 100, 22.5, "loose",
                     "multispectral", None, as7.tolist(), [.1, .1], rng.uniform(.1, .9, 12).tolist(), .2 + .5 * frac))
    names = ["sample_id", "measurement_id", "timestamp", "mineral_class", "ilmenite_fraction", "integration_time_ms", "ambient_temp_c",
             "packing_density", "sensor_mode", "spec", "as7", "swir", "led", schema.LIF]
    of = dict(zip(names, range(len(names))))
    return spark.createDataFrame([tuple(r[of[f]] for f in schema.MEASUREMENT.fieldNames()) for r in rows], schema.MEASUREMENT).repartition(3)


def test_a_stored_run_evaluates_as_when_it_was_trained(spark):
    df, path = measured(spark), scratch_path(spark, "registry")
    run = TE.train(df, "multispectral", seed=5, n_trees=15)
    for run_id in ("7", "a b=c", "7"):
        TE.store(run, path, run_id)
    want = {r["measurement_id"]: r for r in run.scored.where("split <> 'train'").collect()}
    got = {r["measurement_id"]: r for r in TE.score_stored(spark, path, "7", df).collect()}
    assert set(got) == set(want) and 50 < len(want) < 120
    # Stored twice, kept once: one row of settings and of temperature, the split table as it was.
    t = stores.load_temperature(spark, f"{path}/temperature", "7").collect()
    assert len(t) == 1 and stores.load_run(spark, f"{path}/runs", "7")["n_trees"] == 15
    assert spark.read.parquet(f"{path}/runs").count() == spark.read.parquet(f"{path}/temperature").count() == 2
    assert sorted(map(str, stores.load_run_splits(spark, f"{path}/splits", "7").select("sample_id", "split").collect())) == \
        sorted(map(str, run.splits.select("sample_id", "split").collect()))
    for k, w in want.items():
        g = got[k]
        assert (g["split"], g["class_true"], g["class_pred"]) == (w["split"], w["class_true"], w["class_pred"])
        assert np.isclose(g["value_pred"], w["value_pred"])
        z = np.log(np.maximum(w["probabilities"], 1e-12)) / t[0]["temperature"]
        assert np.allclose(g["probabilities"], np.exp(z) / np.exp(z).sum())
    with pytest.raises(KeyError):
        TE.score_stored(spark, path, "never", df)


def test_settings_of_a_run_are_replaced_and_others_stay(spark):
    path = scratch_path(spark, "runs")
    for run_id, seed in (("a", 1), ("b", 2), ("a", 3)):
        stores.save_run(spark, path, run_id=run_id, model="m", seed=seed)
    assert [stores.load_run(spark, path, r)["seed"] for r in "ab"] == [3, 2] and spark.read.parquet(path).count() == 2


def test_ablation_trains_on_each_table_and_tests_on_held_out_rows_of_both(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x = rng.uniform(.1, .9, 8)
        x[i % 3] += 1.0
        rows.append((f"m{i}", f"s{i % 75}", f"c{i % 3}", x.tolist(), i % 3, float(x[5])))
    a = spark.createDataFrame(rows, "measurement_id string, sample_id string, mineral_class string, features array<double>, "
                                    "class_index int, ilmenite_fraction double").repartition(4)
    b = a.withColumn("features", F.transform("features", lambda x: 1.0 - x))
    scored = TE.train_ablation({"a": a, "b": b}, 8, n_trees=12, n_components=4)
    got = {(r["train_model"], r["test_model"]): r for r in E.ablation(scored).collect()}
    cut = splits.sample_level_split(a, seed=0)
    place = {r[0]: r[1] for r in cut.select("measurement_id", "split").collect()}
    held = {m for m, s in place.items() if s == "test"}
    assert {r[0] for r in scored.select("measurement_id").collect()} == held and len(held) > 20
    place = F.col("split")
    for i, train in (("a", a), ("b", b)):
        mine = train.join(cut.select("measurement_id", "split"), "measurement_id").where(place == "train")
        model = M.fit_baseline(mine, 8, 4, 12, 0, key="measurement_id")
        for j, test in (("a", a), ("b", b)):
            out = test.where(F.col("measurement_id").isin(*held)).withColumnsRenamed({"class_index": "t", "ilmenite_fraction": "y"})
            r = scoring.score(out, model).select("t", "class_index", "y", "ilmenite_fraction").toPandas()
            row = got[i, j]
            assert row["n"] == len(r) and np.isclose(row["top1_acc"], (r.t == r.class_index).mean())
            assert np.isclose(row["ilm_rmse"], np.sqrt(((r.y - r.ilmenite_fraction) ** 2).mean()))
    assert got["a", "a"]["top1_acc"] > .9 > got["a", "b"]["top1_acc"]
    path = scratch_path(spark, "ablation")
    stores.write_ablation(E.ablation(scored), path)
    back = {(r["train_model"], r["test_model"]): r for r in stores.read_ablation(spark, path).collect()}
    assert back.keys() == got.keys() and all(np.isclose(back[k]["ilm_r2"], got[k]["ilm_r2"]) for k in got)
