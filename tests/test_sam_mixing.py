import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectrel import schema
from spectrel.operators import channels, library, mixing, sam

GRID = schema.SPEC_GRID


def spectra(spark, rows, name="id"):
    rows = [(k, None if v is None else [float(x) for x in v]) for k, v in rows]
    kind = "long" if isinstance(rows[0][0], int) else "string"
    return spark.createDataFrame(rows, f"{name} {kind}, spec array<double>").repartition(3)


def test_angle_invariances(spark):
    s, t = np.arange(1.0, 9), np.random.default_rng(0).uniform(size=8)
    df = spark.createDataFrame([(s.tolist(), (3 * s).tolist(), t.tolist(), [0.0] * 8, [1.0, 0.0] * 4, [0.0, 1.0] * 4)],
                               "s array<double>, s3 array<double>, t array<double>, z array<double>, e array<double>, o array<double>")
    r = df.select(sam.angle("s", "s3"), sam.angle("s", "t"), sam.angle("s", "z"), sam.angle("e", "o")).first()
    want = np.arccos(s @ t / np.linalg.norm(s) / np.linalg.norm(t))
    assert r[0] < 1e-7 and np.isclose(r[1], want) and np.isclose(r[2], np.pi / 2) and np.isclose(r[3], np.pi / 2)


def test_classifier_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    refs = {f"c{i}": rng.uniform(size=20) for i in range(5)}
    rows = {str(i): rng.uniform(size=20) for i in range(40)}
    rows["zero"] = np.zeros(20)
    out = sam.sam_classify(spectra(spark, rows.items()), spectra(spark, refs.items(), "class_name"))
    tiled = {r["id"]: r for r in sam.sam_nearest(
        spectra(spark, rows.items()), spectra(spark, refs.items(), "class_name"), "id", few=0, pivots=3, tile=2).collect()}
    for r in out.collect():
        s = rows[r["id"]]
        if r["id"] == "zero":
            assert np.allclose(r["angles"], np.pi / 2) and r["sam_index"] == 0 and tiled["zero"]["sam_class"] == "c0"
            continue
        a = np.array([np.arccos(s @ v / np.linalg.norm(s) / np.linalg.norm(v)) for v in refs.values()])
        assert r["sam_class"] == f"c{a.argmin()}" and np.allclose(r["angles"], a)
        p = np.exp(-5 * a)
        assert np.allclose(r["probabilities"], p / p.sum())
        assert tiled[r["id"]]["sam_class"] == r["sam_class"] and np.isclose(tiled[r["id"]]["angle_rad"], a.min())


def plain_nearest(rows, refs):
    names, m = list(refs), np.array(list(refs.values()), float)
    out = []
    for i, s in rows:
        scale = np.linalg.norm(m, axis=1) * np.linalg.norm(s)
        d = np.where(scale < 1e-12, np.pi / 2, np.arccos(np.clip(m @ s / np.maximum(scale, 1e-300), -1, 1))).round(10)
        out.append((i, min(n for n, x in zip(names, d) if x == d.min()), d.min()))
    return sorted(out)


@pytest.mark.parametrize("few,pivots,tile,visits", [(0, 16, 64, 8_192), (0, 1, 7, 100), (0, 40, 1, 8_192), (10_000, 16, 256, 8_192)])
def test_nearest_in_a_library_of_any_size(spark, monkeypatch, few, pivots, tile, visits):
    monkeypatch.setattr(sam, "VISITS", visits)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(25, 8))
    refs = {f"r{i:04}": centre[i % 25] + rng.normal(scale=.1, size=8) for i in range(900)}
    refs |= {f"copy{i}": refs["r0003"] for i in range(300)} | {f"long{i}": refs["r0005"] * (i + 2) for i in range(50)} | {"zero": np.zeros(8)}
    rows = [(i, centre[i % 25] + rng.normal(scale=.2, size=8)) for i in range(400)] + [(1_000, np.zeros(8)), (1_001, refs["r0003"]), (1_001, -refs["r0007"])]
    rows += [(2_000 + i, centre[1]) for i in range(300)]
    got = sam.sam_nearest(spectra(spark, [*rows, (9_000, None), (9_001, [1.0])]), spectra(spark, [*refs.items(), ("empty", []), ("none", None)], "class_name"),
                          "id", few=few, pivots=pivots, tile=tile).collect()
    got = sorted((r["id"], r["sam_class"], r["angle_rad"]) for r in got if r["id"] < 9_000 or r["sam_class"] is not None or r["angle_rad"] is not None)
    want = plain_nearest(rows, refs)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        same = a[1] == b[1] or {a[1][:4], b[1][:4]} == {"r000", "long"}  # multiples differ in the last digits of an angle
        assert a[0] == b[0] and same and np.isclose(a[2], b[2], atol=3e-8), (a, b)


def test_a_spectrum_visits_few_tiles(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(60, 32))
    refs = [(i, centre[i % 60] + rng.normal(scale=.15, size=32)) for i in range(10_000)]
    rows = [(i, centre[i % 60] + rng.normal(scale=.15, size=32)) for i in range(1_000)]
    known = spectra(spark, refs, "class_name").select(F.col("spec").alias("_r"), F.col("class_name").alias("_n"))
    library_, bounds, centres = sam._tiles(known, 32, sam.PIVOTS, 64)
    class Shared:
        value = (centres, bounds)
    m, r = (np.array([x for _, x in t]) for t in (rows, refs))
    d = sam._angles(m, r)
    batch = pa.record_batch({"_row": pa.array(range(1_000), pa.int64()), "_s": pa.array(list(m), pa.list_(pa.float64())), "_angle": d.min(1), "_tile": pa.array(np.zeros(1_000), pa.int32())})
    visits = sum(b.num_rows for b in sam._to_tiles(Shared, 32, True)(iter([batch])))
    assert len(bounds[0]) > 100 and visits < 0.5 * 1_000 * len(bounds[0]), (visits, len(bounds[0]))
    print("visited", visits / 1_000 / len(bounds[0]))
    got = {x["id"]: x["sam_class"] for x in sam.sam_nearest(spectra(spark, rows), spectra(spark, refs, "class_name"), "id", tile=64).collect()}
    assert [got[i] for i in range(1_000)] == d.argmin(1).tolist()


def test_a_spectrum_travels_once_to_a_group_of_tiles(spark, monkeypatch):
    """Vectors without any order, where the bounds rule nothing out."""
    rng = np.random.default_rng(12)
    refs = [(i, rng.normal(size=24)) for i in range(3_000)]
    rows = [(i, rng.normal(size=24)) for i in range(200)] + [(i, refs[i][1] * 1.0) for i in range(200, 220)]
    travelled, put = [], sam.materialise

    def counted(df, name="stage"):
        out = put(df, name)
        if name == "visits":
            travelled.append(out.count())
        return out

    monkeypatch.setattr(sam, "materialise", counted)
    got = {x["id"]: (x["sam_class"], x["angle_rad"]) for x in sam.sam_nearest(
        spectra(spark, rows), spectra(spark, refs, "class_name"), "id", few=0, tile=32).collect()}
    d = sam._angles(np.array([x for _, x in rows]), np.array([x for _, x in refs]))
    assert [got[i][0] for i in range(220)] == d.argmin(1).tolist() and np.allclose([got[i][1] for i in range(220)], d.min(1), atol=3e-8)
    assert sum(travelled) <= 2 * 220  # one group holds all tiles


def test_many_spectra_are_compared_with_many_tiles_at_once(spark):
    """A library of 40,000 tiles: slices of a batch do not shrink to a few spectra, and the bounds stay right."""
    rng = np.random.default_rng(21)
    centres = np.linalg.qr(rng.normal(size=(32, 16)))[0].T
    low = rng.uniform(.2, 1.5, size=(40_000, 16))
    high = low + rng.uniform(0, .6, size=low.shape)
    m = np.concatenate([rng.normal(size=(599, 32)), np.zeros((1, 32))])

    class Shared:
        value = (centres, (low, high))

    batch = pa.record_batch({"_row": pa.array(range(600), pa.int64()), "_s": pa.array(list(m), pa.list_(pa.float64()))})
    out = list(sam._to_tiles(Shared, 32, False)(iter([batch])))
    assert len(out) <= 8 and [r for b in out for r in b.column("_row").to_pylist()] == list(range(600))
    d = sam._angles(m, centres)
    want = np.array([np.maximum(x - high, low - x).max(1) for x in d])
    want[-1] = 0.0
    got = [t for b in out for t in b.column("_tile").to_pylist()]
    assert np.allclose(want[range(600), got], want.min(1), atol=4e-6)
    bound = sam._bounds(m[-50:], centres, low, high)
    assert (bound <= want[-50:]).all() and np.allclose(bound, want[-50:], atol=4e-6)


@pytest.mark.parametrize("count,partitions", [(0, 1), (7, 7), (50, 13)])
def test_meetings_are_dealt_out_evenly(spark, count, partitions):
    keys = sam.dealt_keys(spark, count, partitions)
    assert len(set(keys.tolist())) == count
    df = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "i int, k long").repartition(partitions, "k")
    assert all(r["p"] == r["i"] % partitions for r in df.select("i", F.spark_partition_id().alias("p")).collect())


def test_parts_of_groups_and_spectra_that_are_null(spark, monkeypatch):
    """Several groups met in several parts each; spectra of which none can be compared."""
    monkeypatch.setattr(sam, "LEAST_CELLS", 1 << 9)
    rng = np.random.default_rng(22)
    refs = [(i, rng.normal(size=16)) for i in range(1_500)]
    rows = [(i, rng.normal(size=16)) for i in range(300)]
    got = {x["id"]: (x["sam_class"], x["angle_rad"]) for x in sam.sam_nearest(
        spectra(spark, [*rows, (900, None)]), spectra(spark, refs, "class_name"), "id", few=0, tile=16).collect()}
    d = sam._angles(np.array([x for _, x in rows]), np.array([x for _, x in refs]))
    assert [got[i][0] for i in range(300)] == d.argmin(1).tolist() and np.allclose([got[i][1] for i in range(300)], d.min(1), atol=3e-8)
    assert got[900] == (None, None)
    none = sam.sam_nearest(spectra(spark, [(1, None)]), spectra(spark, refs, "class_name"), "id", few=0, tile=16).collect()
    assert [tuple(r) for r in none] == [(1, None, None)]


def test_class_order_must_fit_the_references(spark):
    refs = spectra(spark, [("a", [1, 2]), ("b", [2, 1])], "class_name")
    with pytest.raises(ValueError):
        sam.sam_classify(spectra(spark, [("x", [1, 1])]), refs, order=["a"])


def test_endmembers_are_matched_by_name(spark):
    em = library.build_endmembers(spark, GRID, schema.SWIR_NM)
    refs = sam.references_from_endmembers(em).collect()
    by = {r["class_name"]: r["spec"] for r in refs}
    pure = {r["endmember"]: r["spec"] for r in em.collect()}
    assert set(by) == set(schema.MINERAL_CLASSES)
    assert np.allclose(by["ilmenite_rich"], pure["ilmenite"]) and np.allclose(by["anorthositic"], pure["anorthite"])
    assert np.allclose(by["mixed"], np.mean(list(pure.values()), axis=0))


def test_library_follows_the_band_formula(spark):
    em = {r["endmember"]: r for r in library.build_endmembers(spark, GRID, schema.SWIR_NM).collect()}
    for name, (level, rise, power) in library.CONTINUA.items():
        for grid, column in ((GRID, "spec"), (np.array(schema.SWIR_NM, float), "swir")):
            want = level + rise * ((grid - 340) / 510) ** power
            for c, s, d in library.BANDS[name]:
                want = want * (1 - d * np.exp(-0.5 * ((grid - c) / s) ** 2))
            assert np.allclose(em[name][column], np.clip(want, 0, 1))


def test_soils_are_weathered_mixtures(spark):
    em = library.build_endmembers(spark, GRID, schema.SWIR_NM)
    soils = {r["endmember"]: np.array(r["spec"]) for r in library.build_soils(em, GRID).collect()}
    pure = {r["endmember"]: np.array(r["spec"]) for r in em.collect()}
    assert set(soils) == set(library.SOILS)
    s = 0.55 * pure["pyroxene"] + 0.25 * pure["olivine"] + 0.15 * pure["ilmenite"] + 0.05 * pure["anorthite"]
    s = s * (1 + 0.30 * (GRID - 340) / 510) * 0.65
    inner = np.convolve(s, np.ones(15) / 15, "valid")
    smooth = np.concatenate([np.full(7, inner[0]), inner, np.full(7, inner[-1])])
    assert np.allclose(soils["lunar_mare_soil"], np.clip(0.35 * s + 0.65 * smooth, 0, 1))


def toy(spark):
    x = (GRID - 340) / 510
    rows = {"olivine": .2 + .6 * x, "pyroxene": .15 + .5 * x, "anorthite": .55 + .3 * x, "ilmenite": .05 + .05 * x, "glass_agglutinate": .04 + .22 * x}
    return spectra(spark, rows.items(), "endmember"), rows


def fractions(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, endmember string, fraction double").repartition(3)


def test_pure_mixtures_and_hapke_is_darker(spark):
    em, pure = toy(spark)
    f = fractions(spark, [("pure", "olivine", 1.0), ("half", "ilmenite", .5), ("half", "anorthite", .5)])
    linear = {r[0]: np.array(r[1]) for r in mixing.mix(f, em).collect()}
    hapke = {r[0]: np.array(r[1]) for r in mixing.mix(f, em, "hapke").collect()}
    assert np.allclose(linear["pure"], pure["olivine"]) and np.allclose(hapke["pure"], pure["olivine"])
    assert (hapke["half"] < linear["half"]).all()


def test_mixing_guards(spark):
    em, _ = toy(spark)
    with pytest.raises(ValueError):
        mixing.mix(fractions(spark, [("a", "olivine", 1.0)]), em, "cubic")
    bad = fractions(spark, [("a", "granite", 1.0)])
    with pytest.raises(Exception, match="unknown end-member"):
        mixing.mix(bad, em).collect()
    twice = spark.createDataFrame([("a", [.1, .2]), ("a", [.3, .4])], "endmember string, spec array<double>")
    with pytest.raises(Exception, match="repeated end-member"):
        mixing.mix(fractions(spark, [("s", "a", 1.0)]), twice).collect()


def test_fluorescence(spark):
    f = fractions(spark, [("a", "anorthite", .8), ("a", "ilmenite", .2), ("b", "ilmenite", 1.0)])
    got = {r[0]: r[1] for r in mixing.fluorescence(f).collect()}
    assert np.isclose(got["a"], .8 * .85 * .8 ** 1.5) and got["b"] == 0


def test_resampling_equals_interp_on_long_curves(spark):
    rng = np.random.default_rng(4)
    grid = np.linspace(10, 20, 15)
    curves = {k: np.sort(rng.uniform(lo, hi, n)) for k, lo, hi, n in (("hot", 5, 25, 4000), ("short", 12, 13, 2), ("one", 14, 15, 1))}
    rows, want = [], {}
    for k, x in curves.items():
        y = rng.uniform(size=len(x))
        rows += [(k, float(a), float(b)) for a, b in zip(x, y)]
        want[k] = np.interp(grid, x, y)
    df = spark.createDataFrame(rows, "spectrum_id string, nm double, reflectance double").repartition(6)
    for r in library.resample(df, grid).collect():
        assert np.allclose(r["spec"], want[r["spectrum_id"]])


def test_resampling_of_many_curves_on_any_grid(spark):
    """Points on grid values, equal wavelengths, unsorted grids, null points; every curve against np.interp."""
    rng = np.random.default_rng(9)
    grid = [12.0, 10.0, 17.5, 11.0, 30.0, -3.0]
    rows, want = [], {}
    for k in range(200):
        n = int(rng.integers(1, 30))
        points = sorted({(float(a), float(b)) for a, b in zip(rng.integers(5, 25, n), rng.uniform(size=n))})
        rows += [(k, *p) for p in points]
        x, y = np.array(points).T
        want[k] = np.interp(grid, x, y)
    rows += [(0, None, 1.0), (1, 3.0, None), (777, None, None)]
    df = spark.createDataFrame(rows, "spectrum_id int, nm double, reflectance double").repartition(3)
    got = {r["spectrum_id"]: r["spec"] for r in library.resample(df, grid).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-13, atol=0) for k in want)
    assert library.resample(df.limit(0), grid).count() == 0
    some = library.resample(df, grid, extremes=("nm",), accept=F.expr("rows > 10 and nm_max < 24"))
    sizes = {k: (sum(r[0] == k for r in rows), max((r[1] for r in rows if r[0] == k and r[1] is not None), default=99)) for k in want}
    assert {r["spectrum_id"] for r in some.collect()} == {k for k, (n, top) in sizes.items() if n > 10 and top < 24}


def test_grid_match_takes_the_first_point_inside_the_tolerance(spark):
    a, b = np.linspace(340, 850, 288), np.arange(300.0, 900, 1.3)
    left = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "i int, nm double")
    right = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "i int, nm double")
    for r in library.match_grid(left, right, 2.0).collect():
        hits = np.nonzero(np.abs(b - r["nm"]) < 2)[0]
        assert r["j"] == (hits[0] if len(hits) else None)


def test_standardiser_of_constant_columns(spark):
    df = spectra(spark, [("a", [1, 5, 2]), ("b", [3, 5, 2])])
    fit = channels.fit_standardiser(df, "spec")
    r = fit.first()
    assert r["mean"] == [2, 5, 2] and r["std"] == [1, 1, 1]
    assert sorted(x["spec"] for x in channels.apply_standardiser(df, fit, "spec").collect()) == [[-1, 0, 0], [1, 0, 0]]


def test_grid_check():
    library.check_grid(GRID, GRID)
    with pytest.raises(ValueError):
        library.check_grid(GRID[:-1], GRID)
