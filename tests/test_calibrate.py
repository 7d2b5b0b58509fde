from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.functions import reflectance as R
from spectrel.operators import calibrate as C

T0 = datetime(2024, 1, 1)
FRAME = "id int, session_id string, ts timestamp, counts array<double>, integration_time_ms int, ambient_temp_c double"
REF = "session_id string, ts timestamp, kind string, counts array<double>, integration_ms double, temp_c double"


def one(spark, expr, **values):
    row = spark.range(4).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("v")).first()
    return row["v"]


def test_white_reads_one_and_dark_reads_zero(spark):
    dark, white = [100.0, 120.0, 90.0], [3000.0, 3100.0, 90.0]
    v = R.normalise("raw", "dark", "white")
    assert one(spark, v, raw=white, dark=dark, white=white)[:2] == [1.0, 1.0]
    assert one(spark, v, raw=dark, dark=dark, white=white) == [0, 0, 0]
    assert one(spark, v, raw=[9999.0, 0.0, 500.0], dark=dark, white=white) == [1.5, 0, 1.5]
    assert one(spark, R.normalise_device("raw", "dark", "white"), raw=[500.0] * 3, dark=dark, white=white)[2] == 0


def test_exposure_scaling_and_its_guard(spark):
    v = R.scale_exposure("raw", "ms", F.lit(20.0))
    assert one(spark, v, raw=[10.0, 20.0], ms=10.0) == [20, 40]
    with pytest.raises(Exception, match="must be positive"):
        one(spark, v, raw=[10.0], ms=0.0)


def test_dark_warms_two_counts_a_degree(spark):
    assert one(spark, R.dark_at_temperature("d", "t"), d=[100.0, 5.0], t=25.0) == [106, 11]


def test_photometric_factors(spark):
    assert np.allclose(one(spark, R.lommel_seeliger("r", 60, 0), r=[0.2]), [0.6])
    assert np.allclose(one(spark, R.lambertian("r", 60), r=[0.2]), [0.4])
    for call in (lambda: R.lambertian("r", 90), lambda: R.lommel_seeliger("r", 95, 0)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="grazing"):
        one(spark, R.lambertian("r", F.col("i")), r=[0.2], i=90.0)


def test_saturation_counts_the_threshold_itself(spark):
    assert one(spark, R.saturation_mask("c"), c=[3999, 4000, 4095]) == [False, True, True]
    assert np.isclose(one(spark, R.saturation_fraction("c"), c=[3999, 4000, 4095]), 2 / 3)


def test_exposure_recommendation_follows_the_histogram_rule(spark):
    rng = np.random.default_rng(3)
    for old in (1, 10, 400):
        c = rng.integers(0, 6000, 288)
        p95 = int(np.sort(np.minimum(c, 4095))[::-1][288 // 20])
        want = min(max(old * 2800 // p95, 1), 500)
        assert one(spark, R.recommended_exposure("c", "ms"), c=c.tolist(), ms=old) == want
    assert one(spark, R.recommended_exposure("c", "ms"), c=[0] * 288, ms=10) == 500


def test_thermistor(spark):
    assert one(spark, R.thermistor_celsius("a"), a=4090) == 150
    assert 20 < one(spark, R.thermistor_celsius("a"), a=2047) < 30
    assert one(spark, R.thermistor_celsius("a"), a=0) == -273.15


def reference_calibration(raw, ms, temp, dark, dms, dt, white, wms):
    raw, dark, white = (np.array(x, float) for x in (raw, dark, white))
    d = dark * (wms / dms) + (temp - dt) * 2.0
    den = white - d
    den = np.where(abs(den) < 1e-6, 1e-6, den)
    return np.clip((raw * (wms / ms) - d) / den, 0, 1.5)


def random_session(seed, n_frames=60, n_refs=14):
    rng = np.random.default_rng(seed)
    pick = lambda: T0 + timedelta(seconds=int(rng.integers(0, 90_000)))
    frames = [(i, f"s{i % 3}", pick(), rng.uniform(100, 3000, 6).tolist(), int(rng.integers(0, 30)), float(rng.uniform(15, 35)))
              for i in range(n_frames)]
    refs = [(f"s{i % 2}", pick(), ("dark", "white")[i % 2 if i < 4 else int(rng.integers(0, 2))],
             rng.uniform(50, 150, 6).tolist() if i % 2 == 0 else rng.uniform(2000, 3000, 6).tolist(),
             float(rng.integers(5, 20)), float(rng.uniform(18, 30))) for i in range(n_refs)]
    return frames, refs


@pytest.mark.parametrize("partitions", [None, 1, 3, 50])
def test_calibration_finds_the_latest_references_whatever_the_ranges(spark, partitions):
    frames, refs = random_session(11)
    fdf = spark.createDataFrame(frames, FRAME).repartition(5)
    got = {r["id"]: r for r in C.calibrate(fdf, spark.createDataFrame(refs, REF), partitions=partitions).collect()}
    assert len(got) == len(frames)
    for i, session, ts, raw, ms, temp in frames:
        last = {}
        for k in ("dark", "white"):
            past = [r for r in refs if r[0] == session and r[2] == k and r[1] <= ts]
            last[k] = max(past, key=lambda r: (r[1], r[3])) if past else None
        row = got[i]
        if last["dark"] is None:
            assert row["reason"] == "no_dark_reference" and row["reflectance"] is None
        elif last["white"] is None:
            assert row["reason"] == "no_white_reference"
        elif ms <= 0:
            assert row["reason"] == "bad_exposure" and row["reflectance"] is None
        else:
            d, w = last["dark"], last["white"]
            assert np.allclose(row["reflectance"], reference_calibration(raw, ms, temp, d[3], d[4], d[5], w[3], w[4]))


def test_reference_at_the_same_instant_counts_and_frames_without_time_stay(spark):
    refs = [("s", T0, "dark", [0.0], 10.0, 22.0), ("s", T0, "white", [100.0], 10.0, 22.0)]
    frames = [(0, "s", T0, [50.0], 10, 22.0), (1, "s", T0 - timedelta(seconds=1), [50.0], 10, 22.0), (2, "s", None, [50.0], 10, 22.0)]
    got = {r["id"]: r for r in C.calibrate(spark.createDataFrame(frames, FRAME), spark.createDataFrame(refs, REF)).collect()}
    assert got[0]["reflectance"] == [0.5]
    assert got[1]["reason"] == got[2]["reason"] == "no_dark_reference"


def test_a_crowded_session_and_a_crowded_instant_are_spread_over_tasks(spark):
    """4,000 of 6,000 frames in one session, 1,500 of them at one instant, 7 rows a batch."""
    rng = np.random.default_rng(7)
    at = lambda s: T0 + timedelta(seconds=int(s))
    frames = [(i, "hot" if i < 4000 else f"s{i % 90}", at(5000) if i < 1500 else at(rng.integers(0, 10_000))) for i in range(6000)]
    refs = [("hot", at(s), k, [float(s)], 1.0, 1.0) for s, k in ((10, "dark"), (20, "white"), (4999, "dark"), (9000, "white"))]
    refs += [(f"s{i % 60}", at(rng.integers(0, 10_000)), ("dark", "white", "other")[i % 3], [float(i)], 1.0, 1.0) for i in range(300)]
    refs += [("hot", None, "dark", [0.0], 1.0, 1.0), (None, at(0), "dark", [0.0], 1.0, 1.0)]
    frames += [(6000, None, at(9999)), (6001, "hot", None)]
    fdf = spark.createDataFrame(frames, "id int, session_id string, ts timestamp")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["id"]: r for r in C.attach_references(fdf, spark.createDataFrame(refs, REF), partitions=40).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == len(frames)
    for i, session, ts in frames:
        for k in ("dark", "white"):
            past = [(r[1], r[3]) for r in refs if r[0] == session and r[2] == k and session and ts and r[1] and r[1] <= ts]
            want = max(past, default=None)
            assert (got[i][k] and (got[i][k]["ts"], got[i][k]["counts"])) == want
            assert got[i][f"{k}_ts"] == (want and want[0])


def test_no_frames_and_no_references(spark):
    frames, refs = random_session(5)
    fdf, rdf = spark.createDataFrame(frames, FRAME), spark.createDataFrame(refs, REF)
    assert C.calibrate(fdf.limit(0), rdf).count() == 0
    assert {r["reason"] for r in C.calibrate(fdf, rdf.limit(0)).collect()} == {"no_dark_reference"}
    with pytest.raises(ValueError, match="named as a kind"):
        C.attach_references(fdf.withColumn("dark", F.lit(1)), rdf)


def test_dark_profiles_recover_the_lines(spark):
    rng = np.random.default_rng(0)
    a, b = 100 + rng.normal(0, 5, 288), 2 + rng.normal(0, 1, 288)
    temps = np.linspace(15, 35, 9)
    rows = [("p", float(t), (a + (t - 22) * b).tolist()) for t in temps]
    rows += [("one", 20.0, a.tolist()), ("flat", 20.0, a.tolist()), ("flat", 20.0, b.tolist())]
    df = spark.createDataFrame(rows, "profile_id string, temp_c double, counts array<double>").repartition(4)
    got = {r["profile_id"]: r for r in C.fit_dark_profiles(df).collect()}
    assert np.allclose(got["p"]["dark_intercept"], a, atol=1e-9) and np.allclose(got["p"]["dark_slope"], b, atol=1e-9)
    assert got["p"]["fit_residual_mean"] < 1e-9 and got["p"]["n_temperatures_fitted"] == 9
    assert got["one"]["reason"] == "fewer_than_two_frames" and got["one"]["dark_slope"] is None
    assert got["flat"]["reason"] == "identical_temperatures"


def test_profile_calibration_warms_before_scaling(spark):
    prof = spark.createDataFrame([("p", [100.0, 110.0], [2.0, 3.0], [3000.0, 2900.0], 20.0, 10.0, 22.0)],
                                 "profile_id string, dark_intercept array<double>, dark_slope array<double>, white array<double>, "
                                 "white_integration_ms double, dark_integration_ms double, reference_temp_c double")
    frames = spark.createDataFrame([("p", [700.0, 800.0], 10, 30.0), ("none", [1.0, 1.0], 10, 30.0), ("p", [1.0, 1.0], 0, 30.0)],
                                   "profile_id string, counts array<double>, integration_time_ms int, ambient_temp_c double")
    got = [r["reflectance"] for r in C.calibrate_with_profiles(frames, prof).collect()]
    dark = (np.array([100, 110]) + 8 * np.array([2, 3])) * 2
    want = np.clip((np.array([1400, 1600]) - dark) / (np.array([3000, 2900]) - dark), 0, 1.5)
    assert sum(g is None for g in got) == 2
    assert np.allclose([g for g in got if g][0], want)
