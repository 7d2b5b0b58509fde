import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.functions import uncertainty as U
from spectrel.operators import evaluate as E
from spectrel.operators import fusion, ranking


def probs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(rows)], "id int, probabilities array<double>").repartition(3)


def test_entropy_margin_and_first_largest_class(spark):
    u = [1 / 6] * 6
    out = {r["id"]: r for r in U.with_uncertainty(probs(spark, [u, [0, 0, 1, 0, 0, 0], [.4, .4, .2, 0, 0, 0]])).collect()}
    assert math.isclose(out[0]["entropy"], math.log(6)) and out[0]["class_index"] == 0 and out[0]["margin"] == 0
    assert abs(out[1]["entropy"]) < 1e-9 and out[1]["margin"] == 1
    assert out[2]["class_index"] == 0


@pytest.mark.parametrize("p,state", [
    ([.95, .01, .01, .01, .01, .01], "nominal"), ([.5, .45, .05, 0, 0, 0], "borderline"),
    ([.65, .35, 0, 0, 0, 0], "low_confidence"), ([.35, .3, .2, .05, .05, .05], "likely_ood"),
    ([.55, .09, .09, .09, .09, .09], "likely_ood"), ([.5, .4, .1, 0, 0, 0], "borderline"),
])
def test_status(spark, p, state):
    row = U.with_uncertainty(probs(spark, [p])).withColumn("ok", U.trustworthy()).first()
    assert row["status"] == state and row["ok"] == (state in ("nominal", "borderline"))


def test_margin_needs_enough_classes(spark):
    with pytest.raises(Exception, match="at least 2"):
        U.with_uncertainty(probs(spark, [[1.0]])).collect()


def test_temperature_identities(spark):
    with pytest.raises(ValueError):
        U.temperature_scaled("z", 0)
    with pytest.raises(ValueError):
        U.retempered("p", -1)
    row = probs(spark, [[.7, .2, .1]]).select(
        U.retempered("probabilities", 1.0).alias("a"), U.retempered("probabilities", 50.0).alias("b")).first()
    assert row["a"] == [.7, .2, .1] and max(row["b"]) - min(row["b"]) < 0.05


def test_ranked_probabilities_keep_class_order_on_ties(spark):
    r = probs(spark, [[.2, .4, .4]]).select(U.ranked_probabilities("probabilities", ["a", "b", "c"]).alias("r")).first()["r"]
    assert [x["name"] for x in r] == ["b", "c", "a"]


def scored(spark, n=3000, parts=4, seed=0, k=4):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, k, n)
    p = np.where(rng.uniform(size=n) < .7, t, rng.integers(0, k, n))
    y = rng.uniform(size=n)
    e = y + rng.normal(0, .1, n) + .05
    rows = [(i, int(a), int(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(t, p, y, e))]
    df = spark.createDataFrame(rows, "id int, class_true int, class_pred int, value_true double, value_pred double").repartition(parts)
    return df, t, p, y, e


def test_confusion_and_class_metrics(spark):
    df, t, p, *_ = scored(spark, 500)
    df = df.where("class_true <> 3")
    t, p = t[t != 3], p[t != 3]
    k = 6
    cm = np.zeros((k, k), int)
    np.add.at(cm, (t, p), 1)
    table = E.confusion_matrix(df, k)
    got = np.zeros((k, k), int)
    for r in table.collect():
        got[r["class_true"], r["class_pred"]] = r["n"]
    assert (got == cm).all() and table.count() == 36
    for r in E.per_class(table).collect():
        i = r["class_index"]
        prec = cm[i, i] / cm[:, i].sum() if cm[:, i].sum() else 0.0
        rec = cm[i, i] / cm[i].sum() if cm[i].sum() else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        assert np.allclose([r["precision"], r["recall"], r["f1"], r["support"]], [prec, rec, f1, cm[i].sum()])
    for r in E.confusions(table).where("rank = 1").collect():
        row = cm[r["class_true"]].copy()
        row[r["class_true"]] = 0
        assert r["n"] == row.max() and r["class_pred"] == row.argmax()


def test_regression_metrics_and_empty_tables(spark):
    df, t, p, y, e = scored(spark)
    m = E.metrics(df).first()
    assert math.isclose(m["top1_acc"], (t == p).mean()) and math.isclose(m["ilm_rmse"], np.sqrt(((e - y) ** 2).mean()))
    assert math.isclose(m["ilm_r2"], 1 - np.var(e - y) / np.var(y), rel_tol=1e-9)
    none = E.metrics(df.where("id < 0")).first()
    assert none["n"] == 0 and all(math.isnan(none[c]) for c in ("top1_acc", "ilm_rmse", "ilm_r2"))
    flat = E.metrics(df.withColumn("value_true", F.lit(.5))).first()
    assert math.isnan(flat["ilm_r2"])


def test_moment_bootstrap_agrees_with_numpy(spark):
    df, t, p, y, e = scored(spark)
    got = E.intervals(df, "id", n=400).first()
    rng = np.random.default_rng(5)
    reps = [rng.integers(0, len(t), len(t)) for _ in range(400)]
    stats = {"accuracy": [(t[i] == p[i]).mean() for i in reps], "rmse": [np.sqrt(((e[i] - y[i]) ** 2).mean()) for i in reps],
             "r2": [1 - np.var(e[i] - y[i]) / np.var(y[i]) for i in reps]}
    for name, values in stats.items():
        lo, hi = np.percentile(values, [2.5, 97.5])
        width = hi - lo
        assert abs(got[f"{name}_lo"] - lo) < .25 * width and abs(got[f"{name}_hi"] - hi) < .25 * width
    again = E.intervals(df.repartition(9), "id", n=400).first()
    assert np.allclose(list(got), list(again))


def test_draw_bootstrap_takes_any_aggregate(spark):
    df, _, _, y, _ = scored(spark, 300)
    r = E.bootstrap_draws(df, "id", {"median": F.median("value_true"), "n": F.count("id")}, n=100).first()
    assert r["n_lo"] == r["n_hi"] == 300 and r["median_lo"] < np.median(y) < r["median_hi"]


def test_bootstrap_of_a_constant_truth_has_no_r2(spark):
    df = scored(spark, 200)[0].withColumn("value_true", F.lit(.1))
    r = E.intervals(df, "id", n=50).first()
    assert math.isnan(r["r2_lo"]) and math.isnan(r["r2_hi"]) and r["rmse_lo"] > 0


def test_bootstrap_of_nothing_is_nan(spark):
    df = scored(spark, 20)[0].where("id < 0")
    assert all(math.isnan(x) for x in E.intervals(df, "id").first())
    assert all(math.isnan(x) for x in E.bootstrap_draws(df, "id", {"m": F.avg("value_true")}, n=5).first())


def test_calibration_error_cases(spark):
    rows = spark.createDataFrame([([.5, .5], 0)] * 10 + [([1.0, 0.0], 0)] * 10, "probabilities array<double>, class_true int")
    half, sure = rows.where("probabilities[0] = 0.5"), rows.where("probabilities[0] = 1.0")
    assert math.isclose(E.expected_calibration_error(half).first()[0], .5)
    assert E.expected_calibration_error(sure).first()[0] == 0
    assert E.expected_calibration_error(rows.where("class_true = 9")).first()[0] == 0


def test_over_confident_logits_want_a_high_temperature(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 6, 400)
    z = 4 * (np.eye(6)[y] + rng.normal(0, 1.5, (400, 6)))
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(z, y)], "logits array<double>, class_true int").repartition(5)
    row = E.fit_temperature(df, 6).first()

    def nll(t):
        q = z / t
        q = q - q.max(1, keepdims=True)
        p = np.exp(q) / np.exp(q).sum(1, keepdims=True)
        return -np.log(np.clip(p[np.arange(400), y], 1e-12, 1)).mean()

    grid = np.linspace(.5, 5, 100)
    assert row["temperature"] > 1.5 and math.isclose(row["temperature"], grid[np.argmin([nll(t) for t in grid])])
    assert E.fit_temperature(df.where("class_true > 9"), 6).first()["temperature"] == 1.0


def test_fusion_matches_a_loop(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(6), 90)
    ilm = rng.uniform(-.2, 1.4, 90)
    sid = ["hot" if i < 60 else f"s{i % 4}" for i in range(90)]
    df = spark.createDataFrame([(s, a.tolist(), float(b)) for s, a, b in zip(sid, p, ilm)],
                               "sample_id string, probabilities array<double>, ilmenite_fraction double").repartition(6)
    mean = {r["sample_id"]: r for r in fusion.fuse(df, 6).collect()}
    vote = {r["sample_id"]: r for r in fusion.fuse(df, 6, method="vote").collect()}
    for s in set(sid):
        at = [i for i, x in enumerate(sid) if x == s]
        assert np.allclose(mean[s]["probabilities"], p[at].mean(0)) and mean[s]["fused_n"] == len(at)
        assert np.isclose(mean[s]["ilmenite_fraction"], np.clip(ilm[at].mean(), 0, 1))
        assert np.allclose(vote[s]["probabilities"], np.bincount(p[at].argmax(1), minlength=6) / len(at))
    with pytest.raises(ValueError):
        fusion.fuse(df, 6, method="median")


def pool(spark, n=50, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(6) * .5, n)
    sam = rng.integers(0, 6, n)
    scored = U.with_uncertainty(probs(spark, p))
    second = spark.createDataFrame([(i, int(c)) for i, c in enumerate(sam)], "id int, sam_index int").repartition(4)
    return scored, second, p, sam


def test_ranking_matches_a_loop(spark):
    scored_, second, p, sam = pool(spark)
    h = -(np.clip(p, 1e-12, 1) * np.log(np.clip(p, 1e-12, 1))).sum(1) / np.log(6)
    s = np.sort(p, axis=1)[:, ::-1]
    want = np.clip(.4 * h + .3 * (1 - s[:, 0] + s[:, 1]) + .3 * (p.argmax(1) != sam), 0, 1)
    got = ranking.rank_pool(scored_, second, "id", 6, k=12).collect()
    assert [r["id"] for r in got] == sorted(range(50), key=lambda i: -want[i])[:12]
    assert np.allclose([r["composite"] for r in got], sorted(want)[::-1][:12])
    scores = ranking.acquisition(scored_, second, "id", 6)
    assert math.isclose(ranking.disagreement_rate(scores).first()[0], (p.argmax(1) != sam).mean())
    assert ranking.disagreement_rate(scores.where("id < 0")).first()[0] == 0
    assert ranking.rank_pool(scored_, second, "id", 6).count() == 50


def test_pool_and_second_classifier_must_pair_up(spark):
    scored_, second, *_ = pool(spark)
    with pytest.raises(Exception, match="different keys"):
        ranking.rank_pool(scored_, second.where("id < 49"), "id", 6).collect()


def test_top_k_runs_as_a_heap(spark):
    scored_, second, *_ = pool(spark)
    plan = ranking.rank_pool(scored_, second, "id", 6, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_latest_entries(spark):
    log = spark.createDataFrame([(i, i % 3, i // 2) for i in range(60)], "id int, g int, t int").repartition(5)
    assert [r["id"] for r in ranking.latest(log, "t", "id").collect()] == list(range(59, 49, -1))
    by = ranking.latest(log, "t", "id", 2, "g").collect()
    assert sorted((r["g"], r["id"]) for r in by) == [(0, 54), (0, 57), (1, 55), (1, 58), (2, 56), (2, 59)]


@pytest.mark.parametrize("pair", [(0, 3), (-1, 0), (None, 1)])
def test_labels_out_of_range_fail(spark, pair):
    df = spark.createDataFrame([(0, 1), pair], "class_true int, class_pred int")
    with pytest.raises(Exception, match="label outside"):
        E.confusion_matrix(df, 3).collect()


@pytest.mark.parametrize("row", [([1.0], 0), (None, 0), ([1.0, 2.0], 5), ([1.0, 2.0], -1), ([1.0, 2.0], None)])
def test_bad_rows_fail_the_temperature_fit(spark, row):
    df = spark.createDataFrame([([1.0, 2.0], 1), row], "logits array<double>, class_true int")
    with pytest.raises(Exception, match="null or"):
        E.temperature_loss(df, 2).collect()


def test_bootstrap_draws_meet_their_rows_in_bounded_parts(spark, monkeypatch):
    df = scored(spark, 300)[0]
    stats = {"mean": F.avg("value_true"), "median": F.median("value_true")}
    want = list(E.bootstrap_draws(df, "id", stats, n=40).first())
    monkeypatch.setattr(E, "PART_DRAWS", 500)
    out = E.bootstrap_draws(df, "id", stats, n=40)
    assert np.allclose(list(out.first()), want, rtol=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # 300 x 40 draws in 24 parts, without a sort of the draws.
    assert plan.count(", 24), REPARTITION_BY_NUM") >= 2 and "ShuffledHashJoin" in plan


def test_bootstrap_draws_do_not_depend_on_partitions(spark):
    df = scored(spark, 300)[0]
    a, b = (list(E.intervals(df.repartition(n), "id", n=100).first()) for n in (1, 8))
    assert np.allclose(a, b, rtol=1e-12)


def test_recalibration_uses_val_and_measures_test(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = int(rng.integers(0, 3))
        z = rng.normal(0, 1, 3)
        z[y] += 1.0
        rows.append(((z * 4).tolist(), y, "val" if i % 2 else "test"))
    r = E.recalibrate(spark.createDataFrame(rows, "logits array<double>, class_true int, split string"), 3).first()
    assert r["temperature"] > 1.5 and r["ece_after"] < r["ece_before"]
