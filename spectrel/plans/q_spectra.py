"""Queries over spectra: standardising, angle mapping, smoothing, hulls, mixing, libraries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import schema
from ..functions import features as FX
from ..functions import mixing as MF
from ..functions import vectors as V
from ..operators import channels, library, mixing, preprocess, sam
from . import inputs as I
from .inputs import (BEST, ENDMEMBERS, FRACTIONS, LONG, MEANS, REFLECTANCE, SAM_PROBS, SCORED, SPECTRA,
                     doubles, fr, rd)
from .registry import query

GRID_SQL = "g AS (SELECT unnest(range(64)) AS i, unnest(" + doubles(I.GRID) + ") AS nm)"


# ---------------------------------------------------------------- channel statistics


@query("A1", sql=f"""WITH {SPECTRA}, {LONG}
SELECT i, {rd('avg(v)', 8)} AS mean, {rd('CASE WHEN stddev_pop(v) < 1e-9 THEN 1.0 ELSE stddev_pop(v) END', 8)} AS std
FROM l GROUP BY i""")
def channel_standardiser(spark, sf):
    fit = channels.fit_standardiser(I.spectra(spark, sf), "spec")
    pairs = F.arrays_zip("mean", "std")
    return fit.select(F.posexplode(pairs).alias("i", "p")).select(
        "i", I.rounded("p.mean", 8).alias("mean"), I.rounded("p.std", 8).alias("std"))


@query("A2", sql=f"""WITH {SPECTRA}, {LONG}, st AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM l GROUP BY i)
SELECT vec_id, i, {rd('(v - mu) / sd')} AS v FROM l JOIN st USING (i)""")
def standardised_spectra(spark, sf):
    s = I.spectra(spark, sf)
    return I.long(channels.apply_standardiser(s, channels.fit_standardiser(s, "spec"), "spec"), ["vec_id"], "spec")


@query("A6", sql=f"WITH {SPECTRA}, {LONG}, {MEANS} SELECT label, i, {rd('v', 8)} AS v FROM m")
def class_mean_spectra(spark, sf):
    return I.long(channels.class_means(I.spectra(spark, sf), "label", "spec"), ["label"], "spec", digits=8)


# ---------------------------------------------------------------- spectral angles


@query("J1", "F24", "T2", sql=f"WITH {SCORED} SELECT vec_id, label, pred, {rd('angle')} AS angle_rad, "
       f"{rd('degrees(angle)', 4)} AS angle_deg FROM b")
def sam_classification(spark, sf):
    return I.scores(spark, sf).select(
        "vec_id", "label", F.col("sam_class").alias("pred"), I.rounded("angle_rad").alias("angle_rad"),
        I.rounded("angle_deg", 4).alias("angle_deg"))


@query("F25", sql=f"""WITH {SAM_PROBS}
SELECT vec_id, unnest(range(len(p))) AS i, unnest(list_transform(p, lambda x: {rd('x')})) AS v FROM p""")
def sam_pseudo_probabilities(spark, sf):
    return I.long(I.scores(spark, sf), ["vec_id"], "probabilities")


@query("F24", sql=f"""WITH {SCORED} SELECT a.vec_id, {rd('angle')} AS angle FROM a WHERE label = ref_label""")
def angle_to_own_class(spark, sf):
    s = I.spectra(spark, sf)
    # A row for each class: packed and looked up, so the spectra are not shuffled on ten keys.
    refs = channels.class_means(s, "label", "spec").agg(F.map_from_entries(F.collect_list(F.struct("label", "spec")))).scalar()
    own = s.withColumn("_refs", refs).withColumn("ref", F.try_element_at("_refs", F.col("label"))).drop("_refs")
    return own.select("vec_id", I.rounded(sam.angle("spec", "ref")).alias("angle"))


@query("A7", "U4", sql=f"""WITH {SPECTRA}, {LONG}, {MEANS},
allm AS (SELECT label::VARCHAR AS name, i, v FROM m UNION ALL SELECT 'mixed', i, avg(v) FROM m GROUP BY i),
r AS (SELECT name AS label, list(v ORDER BY i) AS ref FROM allm GROUP BY name),{I.ANGLES}, {BEST.strip()}
SELECT pred, count(*) AS n FROM b GROUP BY pred""")
def sam_with_mixed_reference(spark, sf):
    s = I.spectra(spark, sf)
    pure = channels.class_means(s, "label", "spec").select(F.col("label").cast("string").alias("class_name"), "spec")
    hits = sam.sam_classify(s, sam.with_mixed(pure))
    return hits.groupBy(F.col("sam_class").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("J1", sql=f"WITH {SCORED} SELECT vec_id, pred AS sam_class, {rd('angle')} AS angle_rad FROM b")
def sam_tiled_library(spark, sf):
    s = I.spectra(spark, sf)
    refs = channels.class_means(s, "label", "spec")
    out = sam.sam_nearest(s, refs, "vec_id", name="label", few=0, pivots=4, tile=3)
    return out.withColumn("angle_rad", I.rounded("angle_rad"))


TURNS = 20


@query("J1", sql=f"""WITH {SPECTRA}, r AS (SELECT vec_id * 32 + k AS name, list_concat(spec[k + 1:], spec[:k]) AS ref, sqrt(list_dot_product(spec, spec)) AS rn
  FROM s, range(1, {TURNS + 1}) AS t(k)),
a AS (SELECT vec_id, name, list_dot_product(spec, ref) / (rn * sqrt(list_dot_product(spec, spec))) AS c FROM s CROSS JOIN r)
SELECT vec_id, arg_min(name, (-round(c, 13), name)) AS sam_class, {rd('acos(greatest(-1.0, least(1.0, max(c))))')} AS angle_rad FROM a GROUP BY vec_id""")
def sam_nearest_of_many(spark, sf):
    """Nearest of twenty turns of every vector: a library of twenty times the table, too large to go to every task."""
    s = I.spectra(spark, sf)
    turned = s.select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(TURNS))).alias("k"), "spec").select(
        (F.col("vec_id") * 32 + F.col("k")).alias("name"),
        F.concat(F.slice("spec", F.col("k") + 1, F.size("spec") - F.col("k")), F.slice("spec", F.lit(1), F.col("k"))).alias("spec"))
    return sam.sam_nearest(s, turned, "vec_id", name="name").withColumn("angle_rad", I.rounded("angle_rad"))


# ---------------------------------------------------------------- smoothing and hulls

# Discrete orthogonal polynomials on eleven points give the fit at any window position.
_SAVGOL_SQL = """WITH {spectra}, {long},
tt AS (SELECT unnest(range(-5, 6)) AS t),
pol AS (SELECT t, 1.0::DOUBLE AS p0, t::DOUBLE AS p1, (t*t - 10)::DOUBLE AS p2, t*t*t - 17.8*t AS p3,
          0.0::DOUBLE AS d0, 1.0::DOUBLE AS d1, 2.0*t AS d2, 3.0*t*t - 17.8 AS d3 FROM tt),
nrm AS (SELECT sum(p0*p0) AS n0, sum(p1*p1) AS n1, sum(p2*p2) AS n2, sum(p3*p3) AS n3 FROM pol),
co AS (SELECT a.t AS pos, b.t AS t, {at0}*b.p0/n0 + {at1}*b.p1/n1 + {at2}*b.p2/n2 + {at3}*b.p3/n3 AS c
       FROM pol a CROSS JOIN pol b CROSS JOIN nrm),
ch AS (SELECT unnest(range(64)) AS i),
cw AS (SELECT i, least(greatest(i, 5), 58) AS mid FROM ch),
k AS (SELECT i, mid + t AS j, c FROM cw JOIN co ON co.pos = i - mid)
SELECT vec_id, k.i, {value} AS v FROM l JOIN k ON l.i = k.j GROUP BY vec_id, k.i"""


def _savgol_sql(prefix: str) -> str:
    names = {f"at{n}": f"a.{prefix}{n}" for n in range(4)}
    return _SAVGOL_SQL.format(spectra=SPECTRA, long=LONG, value=rd("sum(l.v * c)"), **names)


@query("W4", sql=_savgol_sql("p"))
def smoothed_spectra(spark, sf):
    return I.long(preprocess.smooth(I.spectra(spark, sf), I.WIDTH), ["vec_id"], "spec")


@query("F14", sql=_savgol_sql("d"))
def derivative_spectra(spark, sf):
    return I.long(preprocess.first_derivative(I.spectra(spark, sf), I.WIDTH), ["vec_id"], "spec")


_HULL = f"""{REFLECTANCE}, {LONG}, {GRID_SQL},
pt AS (SELECT vec_id, l.i, nm, v FROM l JOIN g USING (i)),
chord AS (SELECT c.vec_id, x.i, max(CASE WHEN a.i = b.i THEN a.v
            ELSE a.v + (b.v - a.v) * (x.nm - a.nm) / (b.nm - a.nm) END) AS hull
  FROM (SELECT DISTINCT vec_id FROM l) c
  JOIN pt a ON a.vec_id = c.vec_id JOIN pt b ON b.vec_id = c.vec_id AND b.i >= a.i
  JOIN g x ON x.i BETWEEN a.i AND b.i GROUP BY c.vec_id, x.i),
cr AS (SELECT l.vec_id, l.i, l.v / greatest(hull, 1e-9) AS v FROM l JOIN chord USING (vec_id, i))"""


@query("F13", sql=f"WITH {_HULL} SELECT vec_id, i, {rd('v')} AS v FROM cr")
def continuum_removed_spectra(spark, sf):
    return I.long(preprocess.remove_continuum(I.reflectance(spark, sf), I.GRID), ["vec_id"], "spec")


def _baseline_sql(width: int, lam: float = 1e5, p: float = 0.01, rounds: int = 10) -> str:
    """Reweighted least squares: each round folds along the channels to factorise the banded system, then back to solve it."""
    g0 = [1.0, 5.0, *[6.0] * (width - 4), 5.0, 1.0]
    g1 = [-2.0, *[-4.0] * (width - 3), -2.0, 0.0]
    g2 = [*[1.0] * (width - 2), 0.0, 0.0]
    main, off1, off2 = (I.doubles([lam * x for x in g]) for g in (g0, g1, g2))
    at = lambda name, back: f"coalesce(f.{name}[x.n - {back}], 0.0)"
    a = f"(x.a - {at('l1', 1)} * {at('l1', 1)} * {at('d', 1)}) - {at('l2', 2)} * {at('l2', 2)} * {at('d', 2)}"
    b = f"(x.b - {at('l1', 1)} * {at('z', 1)}) - {at('l2', 2)} * {at('z', 2)}"
    c = f"(x.o1 - {at('l2', 1)} * {at('d', 1)} * {at('l1', 1)}) * CASE WHEN x.n < {width} THEN 1.0 ELSE 0.0 END"
    none = "[]::DOUBLE[]"
    cell = (f"{{'n': n, 'a': w[n] + ({main})[n], 'b': w[n] * v, 'o1': ({off1})[n], 'o2': ({off2})[n], "
            f"'d': {none}, 'l1': {none}, 'l2': {none}, 'z': {none}}}")
    empty = f"{{'n': 0::BIGINT, 'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'o1': 0.0::DOUBLE, 'o2': 0.0::DOUBLE, 'd': {none}, 'l1': {none}, 'l2': {none}, 'z': {none}}}"
    fold = (f"list_reduce(list_transform(spec, lambda v, n: {cell}), lambda f, x: {{'n': x.n, 'a': x.a, 'b': x.b, 'o1': x.o1, 'o2': x.o2, "
            f"'d': list_append(f.d, {a}), 'l1': list_append(f.l1, ({c}) / ({a})), 'l2': list_append(f.l2, x.o2 / ({a})), 'z': list_append(f.z, {b})}}, {empty})")
    # Solved values are kept last channel first, so the two after a channel are the last two of the list.
    step = "{'v': x.v, 'l1': x.l1, 'l2': x.l2, 'z': list_append(g.z, (x.v - x.l1 * coalesce(g.z[-1], 0.0)) - x.l2 * coalesce(g.z[-2], 0.0))}"
    back = (f"list_reverse(list_reduce(list_transform(range({width}, 0, -1), lambda n: {{'v': f.z[n] / f.d[n], 'l1': f.l1[n], 'l2': f.l2[n], 'z': {none}}}), "
            f"lambda g, x: {step}, {{'v': 0.0::DOUBLE, 'l1': 0.0::DOUBLE, 'l2': 0.0::DOUBLE, 'z': {none}}}).z)")
    steps = ["r0 AS MATERIALIZED (SELECT vec_id, spec, spec AS base, list_transform(spec, lambda v: 1.0::DOUBLE) AS w FROM s)"]
    for k in range(rounds):
        steps.append(f"""f{k} AS MATERIALIZED (SELECT vec_id, spec, {fold} AS f FROM r{k}),
b{k} AS MATERIALIZED (SELECT vec_id, spec, {back} AS base FROM f{k}),
r{k + 1} AS MATERIALIZED (SELECT *, list_transform(spec, lambda v, n: CASE WHEN v > base[n] THEN {p} WHEN v < base[n] THEN 1.0 - {p} ELSE 0.0 END::DOUBLE) AS w FROM b{k})""")
    return f"""WITH {I.REFLECTANCE}, {', '.join(steps)}
SELECT vec_id, CAST(unnest(range({width})) AS INTEGER) AS i, unnest(list_transform(spec, lambda v, n: {rd('v - base[n]')})) AS v FROM r{rounds}"""


@query("F12", sql=_baseline_sql(I.WIDTH))
def baseline_corrected_spectra(spark, sf):
    return I.long(preprocess.baseline_correct(I.reflectance(spark, sf), I.WIDTH), ["vec_id"], "spec")


def _chain_sql() -> str:
    smooth = _SAVGOL_SQL.format(spectra="{SPECTRA}", long="{LONG}", value="sum(l.v * c)", **{f"at{n}": f"a.p{n}" for n in range(4)})
    head, _, tail = smooth.partition("WITH {SPECTRA}, {LONG}")
    body, _, select = tail.rpartition("SELECT vec_id, k.i")
    return f"""WITH {SPECTRA}, {LONG}{body}, sm AS (SELECT vec_id, k.i{select}),
d AS (SELECT vec_id, k.i, sum(sm.v * c) AS v FROM sm JOIN k ON sm.i = k.j GROUP BY vec_id, k.i) SELECT vec_id, i, {rd('v')} AS v FROM d"""


@query("W4", "F14", sql=_chain_sql())
def preprocessed_spectra(spark, sf):
    """A chain of named steps: smoothed, then smoothed again."""
    return I.long(preprocess.preprocess(I.spectra(spark, sf), I.GRID, ["smooth", ("smooth", {"window": 11})]), ["vec_id"], "spec")


@query("W2", sql=f"""WITH {SPECTRA}, {LONG},
rm AS (SELECT vec_id, i, avg(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM l)
SELECT x.vec_id, x.i, {rd('y.v')} AS v FROM rm x JOIN rm y ON y.vec_id = x.vec_id AND y.i = least(greatest(x.i, 7), 56)""")
def running_mean_spectra(spark, sf):
    from ..functions import kernels

    return I.long(I.spectra(spark, sf).withColumn("spec", kernels.running_mean(I.WIDTH, 15)(F.col("spec"))), ["vec_id"], "spec")


# ---------------------------------------------------------------- features


def _with_sensors(df):
    """LED and 18-band readings of a spectrum, and a fluorescence value: a full measurement."""
    df = mixing.band_response(df, I.GRID, schema.LED_NM, 25.0, out="led")
    df = mixing.band_response(df, I.GRID, schema.AS7_NM, 20.0, out="as7")
    return df.withColumn(schema.LIF, V.mean(F.col("spec")) * 0.4)


def _band_sql(name: str, centres, fwhm: float) -> str:
    sigma = float(fwhm / (2.0 * np.sqrt(2.0 * np.log(2.0))))
    return f"""
{name}c AS (SELECT unnest(range({len(centres)})) AS j, unnest({doubles(centres)}) AS centre),
{name}w AS (SELECT j, i, exp(-0.5 * ((nm - centre) / {sigma!r}) * ((nm - centre) / {sigma!r})) AS w FROM {name}c CROSS JOIN g),
{name} AS (SELECT vec_id, j, CASE WHEN sum(w) < 1e-9 THEN max(CASE WHEN l.i = 63 THEN v END) * 0.85
                ELSE sum(w * v) / sum(w) END AS v FROM l JOIN {name}w USING (i) GROUP BY vec_id, j)"""


@query("F36", sql=f"WITH {REFLECTANCE}, {LONG}, {GRID_SQL},{_band_sql('led', schema.LED_NM, 25.0)} "
       f"SELECT vec_id, j AS i, {rd('v')} AS v FROM led")
def led_band_response(spark, sf):
    return I.long(_with_sensors(I.reflectance(spark, sf)), ["vec_id"], "led")


@query("F37", sql=f"WITH {REFLECTANCE}, {LONG}, {GRID_SQL},{_band_sql('as7', schema.AS7_NM, 20.0)} "
       f"SELECT vec_id, j AS i, {rd('v')} AS v FROM as7")
def multispectral_band_response(spark, sf):
    return I.long(_with_sensors(I.reflectance(spark, sf)), ["vec_id"], "as7")


@query("J8", sql=f"""WITH {REFLECTANCE}, {LONG}, {GRID_SQL},
c AS (SELECT unnest(range(18)) AS j, unnest({doubles(schema.AS7_NM)}) AS centre),
near AS (SELECT j, i AS mid FROM (SELECT j, i, row_number() OVER (PARTITION BY j ORDER BY abs(nm - centre), i) AS rn
         FROM c CROSS JOIN g) WHERE rn = 1)
SELECT vec_id, j AS i, {rd('avg(v)')} AS v FROM near JOIN l ON l.i BETWEEN mid - 2 AND mid + 2 GROUP BY vec_id, j""")
def band_window_means(spark, sf):
    return I.long(mixing.band_window_mean(I.reflectance(spark, sf), I.GRID, schema.AS7_NM), ["vec_id"], "bands")


_SENSORS = f"""{_HULL},{_band_sql('led', schema.LED_NM, 25.0)},{_band_sql('as7', schema.AS7_NM, 20.0)},
lif AS (SELECT vec_id, avg(v) * 0.4 AS lif FROM l GROUP BY vec_id),
ledp AS (SELECT vec_id, list(v ORDER BY j) AS led FROM led GROUP BY vec_id),
as7p AS (SELECT vec_id, list(v ORDER BY j) AS as7 FROM as7 GROUP BY vec_id),
ls AS (SELECT vec_id, led[8] / (led[3] + 1e-6) AS led_red_blue_ratio,
         (led[9] + led[10] + led[11]) / 3.0 / ((led[3] + led[5]) / 2.0 + 1e-6) AS led_nir_vis_ratio FROM ledp),
sf AS (SELECT vec_id,
    avg(v) FILTER (nm BETWEEN 500 AND 800) AS broad_albedo,
    regr_slope(v, nm) FILTER (nm BETWEEN 500 AND 800) AS vis_red_slope,
    avg(v) FILTER (nm BETWEEN 340 AND 420) / (avg(v) FILTER (nm BETWEEN 500 AND 600) + 1e-6) AS uv_blue_drop
  FROM pt GROUP BY vec_id),
bd AS (SELECT vec_id, 1.0 - min(v) FILTER (nm BETWEEN 680 AND 720) AS band_depth_700,
         1.0 - min(v) FILTER (nm BETWEEN 600 AND 640) AS band_depth_620 FROM cr JOIN g USING (i) GROUP BY vec_id),
fx AS (SELECT sf.vec_id, broad_albedo, vis_red_slope, uv_blue_drop, band_depth_700, band_depth_620,
         led_red_blue_ratio, led_nir_vis_ratio, lif / (broad_albedo + 1e-6) AS lif_normalised
       FROM sf JOIN bd USING (vec_id) JOIN ls USING (vec_id) JOIN lif USING (vec_id)),
a7 AS (SELECT vec_id, as7,
         (as7[5]+as7[6]+as7[7]+as7[8]+as7[9]+as7[10]+as7[11]) / 7.0 AS albedo FROM as7p),
sl AS (SELECT vec_id, regr_slope(v, centre) AS slope FROM as7 JOIN as7c USING (j) GROUP BY vec_id),
bx AS (SELECT a7.vec_id, albedo AS as7_broad_albedo, slope AS as7_vis_nir_slope,
         as7[3] / (as7[11] + 1e-6) AS as7_blue_red_ratio,
         (as7[15]+as7[16]+as7[17]) / 3.0 / ((as7[3]+as7[5]+as7[7]) / 3.0 + 1e-6) AS as7_nir_vis_ratio,
         1.0 - as7[11] / ((as7[10]+as7[13]) / 2.0 + 1e-6) AS as7_band_depth_700,
         as7[1] / (as7[6] + 1e-6) AS as7_uv_drop, led_red_blue_ratio, led_nir_vis_ratio,
         lif / (albedo + 1e-6) AS lif_normalised
       FROM a7 JOIN sl USING (vec_id) JOIN ls USING (vec_id) JOIN lif USING (vec_id))"""


@query("F15", "F16", "F17", "F18", "F19", "F20", "F21", sql=f"WITH {_SENSORS} SELECT vec_id, " + ", ".join(
    f"{rd(c)} AS {c}" for c in FX.SPECTRAL_FEATURES) + " FROM fx")
def spectral_feature_table(spark, sf):
    out = FX.spectral_features(_with_sensors(I.reflectance(spark, sf)), grid=I.GRID)
    return out.select("vec_id", *[I.rounded(c).alias(c) for c in FX.SPECTRAL_FEATURES])


@query("F22", sql=f"WITH {_SENSORS} SELECT vec_id, " + ", ".join(
    f"{rd(c)} AS {c}" for c in FX.BAND_FEATURES) + " FROM bx")
def band_feature_table(spark, sf):
    out = FX.band_features(_with_sensors(I.reflectance(spark, sf)))
    return out.select("vec_id", *[I.rounded(c).alias(c) for c in FX.BAND_FEATURES])


def _mode_mix(df):
    """Full, multispectral and combined rows side by side, by label."""
    mode = F.get(F.lit(list(schema.SENSOR_MODES)), F.pmod(F.col("label"), F.lit(3)))
    df = _with_sensors(df).withColumn("sensor_mode", mode)
    last = F.element_at("spec", -1)
    return df.select(
        "vec_id", "label", "sensor_mode",
        F.when(mode != "multispectral", F.col("spec")).alias("spec"),
        F.when(mode != "full", F.col("as7")).alias("as7"),
        F.when(F.col("label") < 5, F.array(last * 0.95, last * 0.88)).alias("swir"), "led", schema.LIF)


_ALL_FULL = ", ".join(FX.SPECTRAL_FEATURES)
_MODE_SQL = "['full', 'multispectral', 'combined'][label % 3 + 1]"


@query("F23", "P6", sql=f"""WITH {_SENSORS},
fv AS (SELECT vec_id, [{_ALL_FULL}] AS fv FROM fx), bv AS (SELECT vec_id, [{', '.join(FX.BAND_FEATURES)}] AS bv FROM bx),
e AS (SELECT vec_id, CASE {_MODE_SQL} WHEN 'full' THEN fv WHEN 'multispectral' THEN bv ELSE list_concat(fv, bv) END AS e
  FROM s JOIN fv USING (vec_id) JOIN bv USING (vec_id))
SELECT vec_id, unnest(range(len(e))) AS i, unnest(list_transform(e, lambda x: {rd('x')})) AS v FROM e""")
def expert_features_by_mode(spark, sf):
    return I.long(FX.expert_features(_mode_mix(I.reflectance(spark, sf)), grid=I.GRID), ["vec_id"], "expert")


@query("P1", "P2", "P3", "P5", sql=f"""WITH {_SENSORS},
fvec AS (SELECT s.vec_id, {_MODE_SQL} AS mode, list_concat(list_concat(
   CASE WHEN {_MODE_SQL} <> 'multispectral' THEN spec ELSE [] END, CASE WHEN {_MODE_SQL} <> 'full' THEN as7 ELSE [] END),
   list_concat(CASE WHEN label < 5 THEN [spec[64] * 0.95, spec[64] * 0.88] ELSE [] END, list_concat(led, [lif]))) AS x
  FROM s JOIN ledp USING (vec_id) JOIN as7p USING (vec_id) JOIN lif USING (vec_id))
SELECT vec_id, mode AS sensor_mode, len(x) AS width, {rd('list_sum(x)')} AS total,
  {rd('list_dot_product(x, range(1, len(x) + 1)::DOUBLE[])', 4)} AS position_sum FROM fvec""")
def feature_vectors(spark, sf):
    x = F.col("x")
    df = _mode_mix(I.reflectance(spark, sf)).withColumn("x", FX.feature_vector())
    return df.select("vec_id", "sensor_mode", F.size(x).cast("bigint").alias("width"), I.rounded(V.total(x)).alias("total"),
                     I.rounded(V.total(F.transform(x, lambda v, i: v * (i + 1))), 4).alias("position_sum"))


# ---------------------------------------------------------------- mixing


@query("F33", "J2", "F35", sql=f"""WITH {ENDMEMBERS}, {FRACTIONS}
SELECT sample_id, i, {rd('sum(fraction * v)')} AS v FROM f JOIN em USING (endmember) GROUP BY sample_id, i""")
def linear_mixtures(spark, sf):
    return I.long(mixing.mix(I.fractions(spark, sf), I.endmembers(spark, sf)), ["sample_id"], "spec")


_SSA = "1.0 - ((1.0 - least(v, 1 - 1e-9)) / (1.0 + least(v, 1 - 1e-9))) * ((1.0 - least(v, 1 - 1e-9)) / (1.0 + least(v, 1 - 1e-9)))"
_BACK = "w / ((1.0 + sqrt(1.0 - w)) * (1.0 + sqrt(1.0 - w)))"


@query("F34", "F35", sql=f"""WITH {ENDMEMBERS}, {FRACTIONS},
wm AS (SELECT sample_id, i, sum(fraction * ({_SSA})) AS w FROM f JOIN em USING (endmember) GROUP BY sample_id, i)
SELECT sample_id, i, {rd(_BACK)} AS v FROM wm""")
def intimate_mixtures(spark, sf):
    return I.long(mixing.mix(I.fractions(spark, sf), I.endmembers(spark, sf), "hapke"), ["sample_id"], "spec")


@query("J2", "F34", sql=f"""WITH {ENDMEMBERS}, {FRACTIONS},
wm AS (SELECT sample_id, i, sum(fraction * ({_SSA})) AS w FROM f JOIN em USING (endmember) GROUP BY sample_id, i)
SELECT sample_id, i, {rd(_BACK)} AS v FROM wm""")
def intimate_mixtures_by_join(spark, sf):
    out = mixing.mix(I.fractions(spark, sf), I.endmembers(spark, sf), "hapke")
    return I.long(out, ["sample_id"], "spec")


@query("F31", "F32", sql=f"""WITH {REFLECTANCE}, {LONG}, w AS (SELECT vec_id, i, {_SSA} AS w FROM l)
SELECT vec_id, i, {rd('w')} AS albedo, {rd(_BACK)} AS reflectance FROM w""")
def albedo_roundtrip(spark, sf):
    df = I.reflectance(spark, sf).withColumn("w", MF.to_albedo("spec")).withColumn("r", MF.to_reflectance("w"))
    return df.select("vec_id", F.posexplode(F.arrays_zip("w", "r")).alias("i", "p")).select(
        "vec_id", "i", I.rounded("p.w").alias("albedo"), I.rounded("p.r").alias("reflectance"))


_YIELD = {"click": 0.30, "error": 0.40, "purchase": 0.85, "signup": 0.00, "view": 0.15}


@query("F39", sql=f"""WITH {FRACTIONS}, y AS (SELECT unnest({list(_YIELD)!r}) AS endmember, unnest({list(_YIELD.values())!r}::DOUBLE[]) AS y)
SELECT sample_id, {rd("sum(fraction * y) * pow(1.0 - sum(CASE WHEN endmember = 'signup' THEN fraction ELSE 0.0 END), 1.5)")} AS lif
FROM f JOIN y USING (endmember) GROUP BY sample_id""")
def mixture_fluorescence(spark, sf):
    out = mixing.fluorescence(I.fractions(spark, sf), efficiency=_YIELD, quencher="signup")
    return out.select("sample_id", I.rounded("lif").alias("lif"))


# ---------------------------------------------------------------- libraries

_PART_BANDS = """
pb AS (SELECT p_brand, 340.0::DOUBLE + p_size * 10.0 AS centre_nm, 20.0::DOUBLE + p_partkey % 40 AS sigma_nm,
         ((p_partkey % 7) - 1) / 400.0::DOUBLE AS depth FROM part),
pc AS (SELECT p_brand, 0.2::DOUBLE + 0.001 * min(p_size) AS level, avg(p_retailprice) / 10000.0 AS rise, 1.4::DOUBLE AS power FROM part GROUP BY p_brand)"""


@query("F40", sql=f"""WITH {GRID_SQL},{_PART_BANDS},
th AS (SELECT p_brand, i, product(1.0 - depth * exp(-0.5 * ((nm - centre_nm) / sigma_nm) * ((nm - centre_nm) / sigma_nm))) AS th
       FROM pb CROSS JOIN g GROUP BY p_brand, i)
SELECT p_brand, i, {rd('least(greatest((level + rise * pow((nm - 340.0) / 510.0, power)) * th, 0.0), 1.0)')} AS v
FROM pc CROSS JOIN g JOIN th USING (p_brand, i)""")
def band_model_library(spark, sf):
    p = I.table(spark, sf, "part")
    bands = p.select("p_brand", (340.0 + F.col("p_size") * 10.0).alias("centre_nm"),
                     (20.0 + F.col("p_partkey") % 40).alias("sigma_nm"), ((F.col("p_partkey") % 7 - 1) / 400.0).alias("depth"))
    continua = p.groupBy("p_brand").agg((0.2 + 0.001 * F.min("p_size")).alias("level"),
                                        (F.avg("p_retailprice") / 10000.0).alias("rise")).withColumn("power", F.lit(1.4))
    return I.long(library.build_library(continua, bands, I.GRID, key="p_brand"), ["p_brand"], "spec")


@query("F41", "W2", sql=f"""WITH {REFLECTANCE}, {LONG}, {GRID_SQL},
o AS (SELECT vec_id, i, v * (1.0 + 0.25 * (nm - 340.0) / 510.0) * 0.75 AS v FROM l JOIN g USING (i)),
rm AS (SELECT vec_id, i, avg(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM o)
SELECT o.vec_id, o.i, {rd('least(greatest(0.5 * o.v + 0.5 * y.v, 0.0), 1.0)')} AS v
FROM o JOIN rm y ON y.vec_id = o.vec_id AND y.i = least(greatest(o.i, 7), 56)""")
def weathered_spectra(spark, sf):
    return I.long(library.weather(I.reflectance(spark, sf), I.GRID), ["vec_id"], "spec")


_EVENT_GRID = [float(x) for x in np.linspace(0.0, 200.0, 41)]


@query("J9", "S8", sql=f"""WITH {I.EVENTS},
p AS (SELECT user_id, value AS x, avg(k) / 100.0 AS y FROM e GROUP BY user_id, value),
seg AS (SELECT user_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lag(x) OVER w AS x0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY x)),
g AS (SELECT unnest(range(41)) AS i, unnest({doubles(_EVENT_GRID)}) AS nm)
SELECT user_id, i, {fr('CASE WHEN nm < x OR x2 IS NULL THEN y ELSE y + (y2 - y) * (nm - x) / (x2 - x) END')} AS v
FROM seg JOIN g ON (nm >= x OR x0 IS NULL) AND (nm < x2 OR x2 IS NULL)""")
def resampled_curves(spark, sf):
    points = I.events(spark, sf).groupBy("user_id", "value").agg((F.avg("k") / 100.0).alias("y"))
    return I.long(library.resample(points, _EVENT_GRID, key="user_id", x="value", y="y"), ["user_id"], "spec", digits=I.FINE)


_OTHER_GRID = [float(x) for x in np.linspace(350.0, 665.0, 64)]


@query("J7", "S7", sql=f"""WITH {ENDMEMBERS}, {GRID_SQL},
o AS (SELECT unnest(range(64)) AS j, unnest({doubles(_OTHER_GRID)}) AS nm2),
hit AS (SELECT g.i, g.nm, min(j) AS j FROM g LEFT JOIN o ON abs(nm2 - nm) < 2.0 GROUP BY g.i, g.nm),
mean AS (SELECT i, avg(v) AS measured FROM l GROUP BY i), names AS (SELECT DISTINCT endmember FROM em)
SELECT hit.i, {rd('nm')} AS nm, {rd('measured')} AS measured, names.endmember, {rd('v')} AS reflectance
FROM hit JOIN mean USING (i) CROSS JOIN names LEFT JOIN em ON em.i = hit.j AND em.endmember = names.endmember""")
def reference_overlay(spark, sf):
    pure = library.endmember_payload(I.endmembers(spark, sf)).withColumnRenamed("reflectance", "spec")
    out = library.overlay(I.reflectance(spark, sf), I.GRID, pure, _OTHER_GRID)
    return out.select("i", I.rounded("nm").alias("nm"), I.rounded("measured").alias("measured"), "endmember", I.rounded("reflectance").alias("reflectance"))


@query("S6", sql=f"""WITH {ENDMEMBERS} SELECT endmember, {rd('max(v) FILTER (i = 63) * 0.95')} AS swir_940,
{rd('max(v) FILTER (i = 63) * 0.88')} AS swir_1050 FROM em GROUP BY endmember""")
def short_wave_fallback(spark, sf):
    out = mixing.with_swir(I.endmembers(spark, sf))
    return out.select("endmember", I.rounded(F.get("swir", F.lit(0))).alias("swir_940"), I.rounded(F.get("swir", F.lit(1))).alias("swir_1050"))
