import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel import schema
from spectrel.functions import features as FX
from spectrel.operators import rules
from spectrel.session import scratch_path
from spectrel.sources import library as SL
from spectrel.sources import measurements as SM
from spectrel.sources import stores


def row(i, mode, rng):
    v = lambda n: rng.uniform(.1, .9, n).tolist()
    return {
        "sample_id": f"S{i // 3}", "measurement_id": f"m{i}", "timestamp": "2024-01-01T00:00:00",
        "mineral_class": schema.MINERAL_CLASSES[i % 6], "ilmenite_fraction": float(rng.uniform()), "integration_time_ms": 100,
        "ambient_temp_c": 22.5, "packing_density": "loose", "sensor_mode": mode,
        "spec": None if mode == "multispectral" else v(288), "as7": None if mode == "full" else v(18), "swir": v(2),
        "led": v(12), "lif_450lp": float(rng.uniform()),
    }


def measurements(spark, n=12, modes=schema.SENSOR_MODES, seed=0):
    rng = np.random.default_rng(seed)
    rows = [row(i, modes[i % len(modes)], rng) for i in range(n)]
    return spark.createDataFrame([tuple(r[f] for f in schema.MEASUREMENT.fieldNames()) for r in rows], schema.MEASUREMENT).repartition(3), rows


def same(got, want):
    for c, w in want.items():
        g = got[c]
        assert (g is None) == (w is None), c
        if isinstance(w, (list, float)):
            assert np.allclose(g, w), c
        elif w is not None:
            assert g == w, c


@pytest.mark.parametrize("mode", [*schema.SENSOR_MODES, None])
def test_csv_round_trip(spark, mode):
    df, rows = measurements(spark, modes=(mode,) if mode else schema.SENSOR_MODES)
    path = scratch_path(spark, "csv")
    SM.write_measurements_csv(df, path, mode or "combined")
    back = SM.read_measurements(spark, path)
    assert back.columns == schema.MEASUREMENT.fieldNames()
    got = {r["measurement_id"]: r for r in back.collect()}
    for r in rows:
        same(got[r["measurement_id"]], r)


def test_column_order_and_widths():
    c = schema.columns_for_mode("combined")
    assert c[:9] == (*schema.META_COLUMNS, "sensor_mode") and c[9] == "spec_000" and c[9 + 288] == "as7_410"
    assert [schema.feature_count(m) for m in schema.SENSOR_MODES] == [303, 33, 321]
    assert [schema.feature_count(m, swir=False) for m in schema.SENSOR_MODES] == [301, 31, 319]
    with pytest.raises(ValueError):
        schema.columns_for_mode("radar")


def test_empty_table_writes_a_header(spark):
    df, _ = measurements(spark, 3)
    path = scratch_path(spark, "empty")
    SM.write_measurements_csv(df.where("1 = 0"), path, "full")
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".csv"))
    assert text.startswith("sample_id,measurement_id") and text.count("\n") == 1
    assert SM.read_measurements(spark, path).count() == 0


def test_structural_checks():
    full = list(schema.columns_for_mode("full"))
    schema.check_columns(full)
    schema.check_columns(list(schema.columns_for_mode("multispectral")))
    schema.check_columns([c for c in full if not c.startswith("swir") and c != "sensor_mode"])
    for bad in ([c for c in full if c != "spec_007"], full + ["extra"], [c for c in full if c != "swir_940"],
                [c for c in full if c != "sample_id"], full + ["as7_410"]):
        with pytest.raises(schema.SchemaError):
            schema.check_columns(bad)


# rule -> (column, SQL of a value that breaks it)
BREAK = {
    "sample_id_empty": ("sample_id", "''"), "mineral_class": ("mineral_class", "'basalt'"),
    "ilmenite_fraction": ("ilmenite_fraction", "1.5D"), "integration_time_ms": ("integration_time_ms", "0"),
    "packing_density": ("packing_density", "'dense'"), "sensor_mode": ("sensor_mode", "'half'"),
    "spec_width": ("spec", "slice(spec, 1, 287)"), "led_width": ("led", "slice(led, 1, 11)"),
    "spec_not_finite": ("spec", "transform(spec, (x, i) -> if(i = 5, double('inf'), x))"),
    "as7_not_finite": ("as7", "transform(as7, (x, i) -> if(i = 5, double('nan'), x))"),
    "led_missing": ("led", "cast(null as array<double>)"), "swir_width": ("swir", "array(0.1D)"),
    "lif_not_finite": ("lif_450lp", "double('nan')"), "spec_missing": ("spec", "cast(null as array<double>)"),
}


@pytest.mark.parametrize("rule", list(BREAK))
def test_each_rule_names_its_violation(spark, rule):
    df, _ = measurements(spark, 4, ("combined",))
    column, value = BREAK[rule]
    half = df.withColumn(column, F.when(F.col("measurement_id").isin("m0", "m2"), F.expr(value)).otherwise(F.col(column)))
    checked = rules.check(half, rules.measurement_rules())
    got = {r["measurement_id"]: r["violations"] for r in checked.collect()}
    assert got == {"m0": [rule], "m1": [], "m2": [rule], "m3": []}
    assert rules.good(checked).count() == 2 and rules.quarantined(checked).count() == 2
    with pytest.raises(Exception, match=rule):
        rules.require(half, rules.measurement_rules()).select("sample_id").collect()
    assert rules.require(df, rules.measurement_rules()).count() == 4


def test_legacy_csv_without_optional_blocks(spark):
    df, rows = measurements(spark, 4, ("full",))
    path = scratch_path(spark, "legacy")
    wide = schema.unpack(df, "full").drop("sensor_mode", "swir_940", "swir_1050")
    wide.write.csv(path, header=True)
    got = SM.read_measurements(spark, path).collect()
    assert {r["sensor_mode"] for r in got} == {"full"} and all(r["swir"] is None and r["as7"] is None for r in got)
    assert {r[0] for r in SM.read_measurements(spark, path).select(F.size(FX.feature_vector())).collect()} == {301}


def test_unparsable_channel_is_quarantined(spark):
    df, _ = measurements(spark, 4, ("full",))
    path = scratch_path(spark, "bad")
    wide = schema.unpack(df, "full")
    wide.withColumn("spec_003", F.when(F.col("measurement_id") == "m1", F.lit("oops")).otherwise(F.col("spec_003").cast("string"))).write.csv(path, header=True)
    tagged = {r["measurement_id"]: r["violations"] for r in SM.read_measurements(spark, path, "tag").collect()}
    assert tagged["m1"] == ["spec_not_finite"] and tagged["m0"] == []
    with pytest.raises(Exception, match="spec_not_finite"):
        SM.read_measurements(spark, path).count()


def test_missing_file(spark):
    with pytest.raises(Exception, match="(?i)path"):
        SM.read_measurements(spark, "/nowhere/at/all.csv")


def test_parquet_table_checks_its_version(spark):
    df, rows = measurements(spark)
    path = scratch_path(spark, "table")
    SM.write_measurements(df, path)
    got = {r["measurement_id"]: r for r in SM.read_measurement_table(spark, path).collect()}
    for r in rows:
        same(got[r["measurement_id"]], r)
    plan = SM.block(SM.read_measurement_table(spark, path).where("sensor_mode = 'full'"), "led")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sensor_mode" in plan and "as7" not in plan.split("ReadSchema")[1]
    old = scratch_path(spark, "old")
    df.withColumn("schema_version", F.lit("0.9")).write.partitionBy("sensor_mode").parquet(old)
    with pytest.raises(Exception, match="unsupported schema version 0.9"):
        SM.read_measurement_table(spark, old).collect()


def test_mode_detection_and_vectors(spark):
    df, _ = measurements(spark, 9)
    seen = df.withColumn("sensor_mode", F.lit(None).cast("string")).select(schema.detect_mode().alias("d"), F.size(FX.frame_vector()).alias("n"), "spec")
    assert {r["d"] for r in seen.collect()} == set(schema.SENSOR_MODES)
    widths = {(r[0], r[1]) for r in df.select("sensor_mode", F.size(FX.feature_vector())).collect()}
    assert widths == {("full", 303), ("multispectral", 33), ("combined", 321)}
    idx = {(r[0], r[1]) for r in df.select("mineral_class", schema.class_index()).collect()}
    assert idx == {(c, i) for i, c in enumerate(schema.MINERAL_CLASSES)}


def test_text_library_skips_bad_files(spark, tmp_path):
    for name, text in {"a": "# nm r\n340 0.1\n850 0.6\n", "b": "400 2.0\n500 2.0\n", "bad": "340 x\n850 1\n", "one": "340 0.5\n", "ragged": "1 2\n3 4 5\n"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    (tmp_path / "note.md").write_text("340 0.1\n850 0.6\n")
    got = {r["spectrum_id"]: r["spec"] for r in SL.read_ascii_library(spark, str(tmp_path), [300, 595, 900]).collect()}
    assert set(got) == {"a", "b"} and np.allclose(got["a"], [.1, .35, .6]) and got["b"] == [1, 1, 1]


def test_endmember_store(spark):
    from spectrel.operators import library

    em = library.build_endmembers(spark, schema.SPEC_GRID, schema.SWIR_NM)
    path = scratch_path(spark, "em")
    SL.write_endmembers(em.drop("swir"), path, schema.SPEC_GRID)
    back = SL.read_endmembers(spark, path, schema.SPEC_GRID).collect()
    assert all(np.allclose(r["swir"], [r["spec"][-1] * .95, r["spec"][-1] * .88]) for r in back) and len(back) == 5
    with pytest.raises(ValueError):
        SL.read_endmembers(spark, path, schema.SPEC_GRID + 1)
    assert {r["source"] for r in library.endmember_payload(em).collect()} == {"parametric"}


def test_stores(spark):
    p = scratch_path(spark, "profiles")
    spark.createDataFrame([("p", [1.0], [2.0])], "profile_id string, dark_intercept array<double>, dark_slope array<double>").write.parquet(p)
    row = stores.load_profiles(spark, p).first()
    assert row["reference_temp_c"] == 22 and row["n_temperatures_fitted"] == 0 and row["fit_residual_mean"] == 0
    r = scratch_path(spark, "runs")
    stores.save_run(spark, r, run_id="a", model="plsr", seed=3, val_frac=.2, test_frac=.1)
    stores.save_run(spark, r, run_id="b", model="plsr", seed=4)
    assert stores.load_run(spark, r, "a")["seed"] == 3 and stores.load_run(spark, r, "a")["val_frac"] == .2
    with pytest.raises(KeyError):
        stores.load_run(spark, r, "c")
    t = scratch_path(spark, "temperature")
    stores.save_temperature(spark, t, "a", 1.7, .05, .01)
    assert spark.read.parquet(t).first()["temperature"] == 1.7
