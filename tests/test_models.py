import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel import schema
from spectrel.functions import features as FX
from spectrel.functions import vectors as V
from spectrel.operators import augment, models, scoring
from spectrel.session import scratch_path
from test_measurements import measurements


def data(spark, n=240, k=12, seed=0, parts=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * rng.uniform(.5, 3, k) + rng.uniform(-2, 2, k)
    x[:, 3] = 7.0
    y = .4 + .05 * x[:, 0] - .03 * x[:, 1] + rng.normal(0, .01, n)
    c = (y > .4).astype(int)
    df = spark.createDataFrame([(i, a.tolist(), float(b), int(d)) for i, (a, b, d) in enumerate(zip(x, y, c))],
                               "id int, features array<double>, ilmenite_fraction double, class_index int").repartition(parts)
    return df, x, y, c


def nipals(x, y, comps):
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-9, 1, sd)
    a, b = (x - mu) / sd, y - y.mean()
    x0, w_, p_, q_ = a.copy(), [], [], []
    for _ in range(comps):
        w = a.T @ b
        w /= np.linalg.norm(w)
        t = a @ w
        p, q = a.T @ t / (t @ t), b @ t / (t @ t)
        a, b = a - np.outer(t, p), b - q * t
        w_.append(w), p_.append(p), q_.append(q)
    w, p = np.array(w_).T, np.array(p_).T
    return np.clip(x0 @ (w @ np.linalg.inv(p.T @ w) @ np.array(q_)) + y.mean(), 0, 1)


def test_moments_match_numpy_for_any_partitioning(spark):
    df, x, y, _ = data(spark)
    for part in (df.coalesce(1), df.repartition(13)):
        m = models.moments(part, 12, target="ilmenite_fraction")
        full = np.column_stack([x, y])
        assert m.n == 240 and np.allclose(m.mean, full.mean(0)) and np.allclose(m.cov, np.cov(full.T, bias=True))
    with pytest.raises(ValueError):
        models.moments(df.where("id < 0"), 12, target="ilmenite_fraction")


@pytest.mark.parametrize("comps", [1, 3, 8])
def test_pls_matches_row_wise_nipals(spark, comps):
    df, x, y, _ = data(spark)
    m = models.moments(df, 12, target="ilmenite_fraction")
    got = {r["id"]: r["prediction"] for r in models.fit_pls(m, comps).predict(df).collect()}
    assert np.allclose([got[i] for i in range(240)], nipals(x, y, comps), atol=1e-8)


def test_full_rank_pls_is_least_squares(spark):
    df, x, y, _ = data(spark)
    m = models.moments(df, 12, target="ilmenite_fraction")
    got = {r["id"]: r["prediction"] for r in models.fit_pls(m, 12).predict(df).collect()}
    a = np.column_stack([np.ones(240), np.delete(x, 3, 1)])
    assert np.allclose([got[i] for i in range(240)], np.clip(a @ np.linalg.lstsq(a, y, rcond=None)[0], 0, 1), atol=1e-6)
    assert models.components_for(4, 100) == 3 and models.components_for(1, 100) == 1 and models.components_for(100, 2) == 2


def test_baseline_pair_learns_saves_and_loads(spark):
    df, _, y, c = data(spark)
    model = models.fit_baseline(df, 12, n_trees=10)
    rows = df.select("id", "features")
    out = {r["id"]: r for r in scoring.score(rows, model).collect()}
    assert np.mean([out[i]["class_index"] == c[i] for i in range(240)]) > .9
    assert np.sqrt(np.mean([(out[i]["ilmenite_fraction"] - np.clip(y[i], 0, 1)) ** 2 for i in range(240)])) < .03
    path = scratch_path(spark, "model")
    model.save(path)
    back = {r["id"]: r for r in scoring.score(rows, models.BaselineModel.load(spark, path)).collect()}
    assert all(np.allclose(back[i]["probabilities"], out[i]["probabilities"]) for i in out)


def test_baseline_inputs_by_mode(spark):
    df, rows = measurements(spark, 9)
    for mode, width in (("full", 309), ("combined", 327)):
        part = df.where("spec is not null and as7 is not null")
        assert {r[0] for r in models.baseline_features(part, mode).select(F.size("features")).collect()} == {width}
    assert {r[0] for r in models.baseline_features(df.where("as7 is not null"), "multispectral").select(F.size("features")).collect()} == {31}
    with pytest.raises(ValueError):
        models.baseline_features(df, "radar")


def expected_spectral(spec, led, lif):
    g, w = schema.SPEC_GRID, {n: i for i, n in enumerate(schema.LED_NM)}
    m = lambda lo, hi: (g >= lo) & (g <= hi)
    hull_up = np.array([max(spec[k] if i == j else spec[i] + (spec[j] - spec[i]) * (g[k] - g[i]) / (g[j] - g[i])
                            for i in range(k + 1) for j in range(k, len(g), 1)) for k in np.nonzero(m(600, 720))[0]])
    cr = np.ones(len(g))
    cr[m(600, 720)] = spec[m(600, 720)] / hull_up
    alb = spec[m(500, 800)].mean()
    return [alb, np.polyfit(g[m(500, 800)], spec[m(500, 800)], 1)[0], spec[m(340, 420)].mean() / (spec[m(500, 600)].mean() + 1e-6),
            1 - cr[m(680, 720)].min(), 1 - cr[m(600, 640)].min(), led[w[660]] / (led[w[450]] + 1e-6),
            np.mean([led[w[x]] for x in (730, 780, 850)]) / (np.mean([led[w[x]] for x in (450, 525)]) + 1e-6), lif / (alb + 1e-6)]


def test_spectral_features_from_their_formulas(spark):
    df, rows = measurements(spark, 3)
    got = {r["measurement_id"]: [r[c] for c in FX.SPECTRAL_FEATURES] for r in FX.spectral_features(df.where("spec is not null")).collect()}
    for r in rows:
        if r["spec"] is not None:
            assert np.allclose(got[r["measurement_id"]], expected_spectral(np.array(r["spec"]), r["led"], r["lif_450lp"]), atol=1e-9)
            break


def test_expert_feature_widths_and_missing_blocks(spark):
    df, _ = measurements(spark, 9)
    got = FX.expert_features(df).select("sensor_mode", F.size("expert").alias("n")).distinct().collect()
    assert {(r[0], r[1]) for r in got} == {("full", 8), ("multispectral", 9), ("combined", 17)}
    broken = FX.expert_features(df.withColumn("as7", F.lit(None).cast("array<double>")).where("sensor_mode = 'combined'"))
    assert {r["expert"] for r in broken.collect()} == {None}


class Batch(scoring.BatchScorer):
    def __init__(self, width):
        super().__init__(lambda: lambda m: (np.column_stack([m[:, 0], m[:, 1], -m[:, 0]]), m.mean(1)), width)


def test_batch_scorer_contract(spark):
    df, x, *_ = data(spark, 30, 33)
    out = {r["id"]: r for r in scoring.score(df.select("id", "features"), Batch(33), "multispectral").collect()}
    for i in range(30):
        z = x[i].astype(np.float32)
        z = np.array([z[0], z[1], -z[0]], float)
        p = np.exp(z - z.max())
        assert np.allclose(out[i]["probabilities"], p / p.sum(), atol=1e-6) and out[i]["class_index"] == int(p.argmax())
        assert 0 <= out[i]["ilmenite_fraction"] <= 1
    with pytest.raises(Exception, match="expects 303 features, got 33"):
        scoring.score(df.select("id", "features"), Batch(33), "full").collect()


def test_test_time_averaging(spark):
    df, x, *_ = data(spark, 20, 8)
    x = np.abs(x) % 1
    rows = spark.createDataFrame([(str(i), a.tolist()) for i, a in enumerate(x)], "measurement_id string, features array<double>").repartition(4)
    scorer = scoring.ColumnScorer(V.softmax(F.col("features")), F.get("features", F.lit(0)))
    plain = {r["measurement_id"]: r for r in scorer.score(rows).collect()}
    still = {r["measurement_id"]: r for r in augment.tta(rows, scorer, 8, 8, sigma=0.0).collect()}
    noisy = {r["measurement_id"]: r for r in augment.tta(rows, scorer, 8, 8).collect()}
    again = {r["measurement_id"]: r for r in augment.tta(rows.coalesce(1), scorer, 8, 8).collect()}
    for k in plain:
        assert still[k]["tta_n"] == 8 and np.allclose(still[k]["probabilities"], plain[k]["probabilities"])
        assert np.allclose(noisy[k]["probabilities"], plain[k]["probabilities"], atol=.02)
        assert np.allclose(noisy[k]["probabilities"], again[k]["probabilities"])
    assert any(noisy[k]["probabilities"] != plain[k]["probabilities"] for k in plain)


def test_augmented_measurements_leave_the_bands_alone(spark):
    df, rows = measurements(spark, 9)
    out = augment.augment(df, copies=2).collect()
    by = {r["measurement_id"]: r for r in rows}
    assert len(out) == 18
    for r in out:
        src = by[r["measurement_id"]]
        assert r["as7"] == src["as7"] and r["led"] != src["led"] and np.allclose(r["led"], src["led"], atol=.1)
        assert (r["spec"] is None) == (src["spec"] is None)
        if r["spec"]:
            assert min(r["spec"]) >= 0 and max(r["spec"]) <= 1.5


def test_augmented_measurements_query_covers_all_modes(spark):
    from spectrel.plans import inputs, q_models

    sf = "/root/testdata/sf0.001"
    modes = {r["measurement_id"]: r["sensor_mode"] for r in inputs.measurements(spark, sf).select("measurement_id", "sensor_mode").collect()}
    specs = {r["measurement_id"]: r["spec"] for r in augment.augment(inputs.measurements(spark, sf)).select("measurement_id", "spec").collect()}
    got = {r["measurement_id"]: r for r in q_models.augmented_measurements(spark, sf).collect()}
    assert set(got) == set(modes) and set(modes.values()) == {"full", "combined", "multispectral"}
    for k, r in got.items():
        assert all(r[c] is not None for c in ("led_total", "swir_total", "lif"))
        if modes[k] == "multispectral":
            assert (r["width"], r["total"], r["position_sum"]) == (None, None, None)
        else:
            x = np.array(specs[k])
            assert r["width"] == 288 and np.isclose(r["total"], x.sum(), atol=1e-4) and np.isclose(r["position_sum"], x @ np.arange(1, 289), atol=1e-3)


@pytest.mark.parametrize("row", [([1.0], 0.5), (None, 0.5), ([1.0, 2.0], None)])
def test_bad_rows_fail_the_fit(spark, row):
    df = spark.createDataFrame([([1.0, 2.0], 0.1), row], "features array<double>, target double")
    with pytest.raises(Exception, match="null"):
        models.moments(df, 2)


def test_channel_moments_of_a_crowded_key(spark, monkeypatch):
    from spectrel.operators import channels

    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", rng.normal(5, 1, 4 if i % 7 else 3).tolist(), float(i % 9)) for i in range(900)]
    rows += [("hot", None, 1.0), ("gap", [1.0, None], 2.0), (None, [1.0, 2.0], None), ("t", [3.0], None)]
    df = spark.createDataFrame(rows, "k string, x array<double>, t double").repartition(5)
    got = {r["k"]: r for r in channels.channel_moments(df, "x", ["k"], F.col("t")).collect()}
    assert len(got) == len({r[0] for r in rows}) and got["hot"]["bare"] == 1 and got["gap"]["n"] == [1.0, 0.0] and got["t"]["n"] == [0.0]
    for k in ("hot", "k1", "k20"):
        for i in range(4):
            pairs = np.array([(x[i], t) for kk, x, t in rows if kk == k and x and len(x) > i])
            x, t = pairs[:, 0], pairs[:, 1]
            r = got[k]
            assert r["n"][i] == len(x) and np.isclose(r["sum"][i], x.sum()) and np.isclose(r["m2"][i], x.var() * len(x))
            assert np.isclose(r["cov"][i], ((x - x.mean()) * (t - t.mean())).sum()) and (r["b_min"][i], r["b_max"][i]) == (t.min(), t.max())
    assert channels.channel_moments(df.limit(0), "x", ["k"]).count() == 0


def test_channel_moments_without_keys_fold_in_the_scanning_tasks(spark):
    from spectrel.operators import channels

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for b in batches:
            yield pa.record_batch({"x": pa.array([[float(TaskContext.get().partitionId())]] * b.num_rows, pa.list_(pa.float64()))})

    df = spark.range(0, 800, 1, 8).mapInArrow(place, "x array<double>")
    got = channels.channel_moments(df, "x").collect()
    x = np.repeat(np.arange(8.0), 100)
    assert len(got) == 1 and got[0]["rows"] == 800 and got[0]["sum"] == [x.sum()] and np.isclose(got[0]["m2"][0], x.var() * 800)
    assert channels.channel_moments(df.limit(0), "x").count() == 0
