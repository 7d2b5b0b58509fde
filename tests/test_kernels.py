import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.functions import kernels as K
from spectrel.operators import augment as A


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)],
                                 "id int, spec array<double>").repartition(parts)


def run(df, kernel):
    return {r["id"]: r["out"] for r in df.select("id", kernel(F.col("spec")).alias("out")).collect()}


def test_savgol_keeps_cubics_and_their_slope(spark):
    x = np.linspace(-1, 1, 40)
    cubic = 0.3 + x - 2 * x ** 2 + 0.5 * x ** 3
    out = run(frame(spark, [cubic, np.ones(40)]), K.savgol(40))
    assert np.allclose(out[0], cubic) and np.allclose(out[1], 1)
    slope = run(frame(spark, [np.arange(40.0) * 2.5]), K.savgol(40, deriv=1))
    assert np.allclose(slope[0], 2.5)


@pytest.mark.parametrize("kw", [{"window": 10}, {"window": 3, "order": 3}])
def test_savgol_refuses_bad_windows(kw):
    with pytest.raises(ValueError):
        K.savgol(40, **kw)


def test_rows_of_another_width_and_nulls_come_out_null(spark):
    out = run(frame(spark, [np.ones(40), np.ones(39), None]), K.savgol(40))
    assert out[1] is None and out[2] is None and out[0] is not None


def test_nan_survives_kernels(spark):
    m = np.ones(20)
    m[3] = np.nan
    out = run(frame(spark, [m]), K.linear_kernel(np.eye(20)[3:4]))
    assert np.isnan(out[0][0])


def dense_asls(y, lam=1e5, p=0.01, n_iter=10):
    d = np.diff(np.eye(len(y)), n=2, axis=0)
    w = np.ones(len(y))
    for _ in range(n_iter):
        z = np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)
        w = p * (y > z) + (1 - p) * (y < z)
    return z


def test_asls_matches_a_dense_solve_and_lies_below_peaks(spark):
    x = np.linspace(0, 1, 120)
    rows = [0.2 + 0.3 * x + np.exp(-((x - c) / 0.05) ** 2) for c in (0.3, 0.5, 0.7)]
    out = run(frame(spark, rows), K.asls(120))
    for i, y in enumerate(rows):
        assert np.allclose(out[i], dense_asls(y), atol=1e-6)
        assert out[i][int(np.argmax(y))] < y.max() - 0.5


def test_asls_of_tiny_spectra_is_zero(spark):
    assert run(frame(spark, [[1, 2, 3]]), K.asls(3))[0] == [0, 0, 0]


def test_hull_matches_the_highest_chord(spark):
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(300, 900, 30))
    rows = rng.uniform(0.1, 0.9, (25, 30))
    out = run(frame(spark, rows), K.continuum_removal(x))
    for n, y in enumerate(rows):
        hull = [max(y[i] if i == j else y[i] + (y[j] - y[i]) * (x[k] - x[i]) / (x[j] - x[i])
                    for i in range(k + 1) for j in range(k, 30)) for k in range(30)]
        assert np.allclose(out[n], y / np.array(hull))


def test_hull_of_flat_linear_and_short_spectra(spark):
    x = np.arange(50.0)
    out = run(frame(spark, [np.full(50, 0.4), 0.1 + 0.01 * x]), K.continuum_removal(x))
    assert np.allclose(out[0], 1) and np.allclose(out[1], 1)
    assert run(frame(spark, [[0.3, 0.5]]), K.continuum_removal([1, 2]))[0] == [1, 1]


def test_bands_outside_the_grid_read_the_darkened_last_channel():
    grid = np.linspace(340, 850, 288)
    w = K.band_weights(grid, [600, 1050], 25.0)
    assert np.isclose(w[0].sum(), 1) and np.argmax(w[0]) == np.argmin(abs(grid - 600))
    assert np.isclose(w[1][-1], 0.85) and np.allclose(w[1][:-1], 0)


def test_window_mean_is_cut_at_the_ends():
    w = K.window_weights(np.arange(10.0), [0, 5], 2)
    assert np.allclose(w[0][:3], 1 / 3) and np.allclose(w[1][3:8], 0.2)


def test_running_mean_fills_the_ends(spark):
    y = np.random.default_rng(1).uniform(size=40)
    out = run(frame(spark, [y]), K.running_mean(40, 15))[0]
    inner = np.convolve(y, np.ones(15) / 15, "valid")
    assert np.allclose(out, np.concatenate([np.full(7, inner[0]), inner, np.full(7, inner[-1])]))


def test_draws_look_uniform_and_normal():
    keys = np.arange(4000, dtype=np.uint64)
    u, z = K.uniform_draws(keys, 50), K.normal_draws(keys, 50)
    assert abs(u.mean() - 0.5) < 0.005 and 0 < u.min() and u.max() < 1
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.05


def test_augmentation_steps():
    keys = np.arange(200, dtype=np.uint64)
    m = np.tile(np.linspace(0.2, 0.8, 30), (200, 1))
    assert np.allclose(A.jitter(m, keys, 0.1) / m, (A.jitter(m, keys, 0.1) / m)[:, :1])
    assert np.isclose(np.abs(A.drift(m, keys, 0.05) - m).max(), 0.05, atol=1e-6)
    moved = A.shift(m, keys, 1)
    kinds = {0: 0, 1: 0, -1: 0}
    for row in moved:
        for by in kinds:
            want = m[0][np.clip(np.arange(30) - by, 0, 29)]
            kinds[by] += np.allclose(row, want)
    assert sum(kinds.values()) == 200 and min(kinds.values()) > 30
    assert 0 < (A.dropout(m, keys, 0.1) == 0).mean() < 0.2


def test_augmentation_does_not_depend_on_partitions(spark):
    rows = np.random.default_rng(2).uniform(0.1, 0.9, (60, 32))
    df = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(rows)], "measurement_id string, spec array<double>")
    one = {(r[0], r["copy"]): r["spec"] for r in A.augment_spectra(df.coalesce(1), 32, 3).collect()}
    many = {(r[0], r["copy"]): r["spec"] for r in A.augment_spectra(df.repartition(8), 32, 3).collect()}
    assert one == many and len(one) == 180
    assert one[("0", 0)] != one[("0", 1)]
    still = A.augment_spectra(df, 32, 1, cfg=A.AugmentConfig(p_apply=0.0))
    assert all(np.allclose(r["spec"], rows[int(r[0])]) for r in still.collect())
