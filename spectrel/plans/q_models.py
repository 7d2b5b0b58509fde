"""Queries over models: partial least squares, forest, augmentation, test-time averaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import features as FX
from ..functions import mixing as MF
from ..functions import vectors as V
from ..operators import augment, models, scoring
from ..operators import evaluate as evaluation
from ..session import materialise, scratch_path
from ..sources import measurements, stores
from . import inputs as I
from .inputs import LONG, REFLECTANCE, digest_sql, rd
from .registry import query
from .train_evaluate import evaluate, score_stored, store, train, train_ablation


def _labelled(spark, sf):
    """Spectra as features with the label as class and a tenth of it as the fraction."""
    return I.reflectance(spark, sf).select(
        "vec_id", F.col("spec").alias("features"), F.col("label").alias("class_index"),
        (F.col("label") / 10.0).alias("ilmenite_fraction"))


@query("M5", sql=f"""WITH {REFLECTANCE}, {LONG},
st AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM l GROUP BY i),
x AS (SELECT vec_id, label / 10.0 AS y, i, (v - mu) / sd AS x FROM l JOIN st USING (i)),
yb AS (SELECT avg(label / 10.0) AS yb FROM s),
w0 AS (SELECT i, sum(x * (y - yb)) AS w FROM x CROSS JOIN yb GROUP BY i),
w AS (SELECT i, w / (SELECT sqrt(sum(w * w)) FROM w0) AS w FROM w0),
t AS (SELECT vec_id, y, sum(x * w) AS t FROM x JOIN w USING (i) GROUP BY vec_id, y),
q AS (SELECT sum(t * (y - yb)) / sum(t * t) AS q FROM t CROSS JOIN yb)
SELECT vec_id, {rd('least(greatest(yb + q * t, 0.0), 1.0)')} AS prediction FROM t CROSS JOIN q CROSS JOIN yb""")
def pls_one_component(spark, sf):
    df = _labelled(spark, sf)
    m = models.moments(df, I.WIDTH, target="ilmenite_fraction")
    out = models.fit_pls(m, 1).predict(df)
    return out.select("vec_id", I.rounded("prediction").alias("prediction"))


@query("M5", sql=f"""WITH {REFLECTANCE}, {LONG},
st AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM l GROUP BY i),
yb AS (SELECT avg(label / 10.0) AS yb FROM s),
x AS (SELECT vec_id, label / 10.0 - yb AS y, i, (v - mu) / sd AS x FROM l JOIN st USING (i) CROSS JOIN yb),
w0 AS (SELECT i, sum(x * y) AS w FROM x GROUP BY i),
w AS (SELECT i, w / (SELECT sqrt(sum(w * w)) FROM w0) AS w FROM w0),
t AS (SELECT vec_id, y, sum(x * w) AS t FROM x JOIN w USING (i) GROUP BY vec_id, y),
q AS (SELECT sum(t * y) / sum(t * t) AS q, sum(t * t) AS tt FROM t),
pl AS (SELECT i, sum(x * t) / any_value(tt) AS p FROM x JOIN t USING (vec_id) CROSS JOIN q GROUP BY i),
x2 AS (SELECT x.vec_id, x.y - q * t AS y, x.i, x - t * p AS x FROM x JOIN t USING (vec_id) JOIN pl USING (i) CROSS JOIN q),
v0 AS (SELECT i, sum(x * y) AS w FROM x2 GROUP BY i),
v AS (SELECT i, w / (SELECT sqrt(sum(w * w)) FROM v0) AS w FROM v0),
t2 AS (SELECT vec_id, any_value(y) AS y, sum(x * w) AS t FROM x2 JOIN v USING (i) GROUP BY vec_id),
q2 AS (SELECT sum(t * y) / sum(t * t) AS q FROM t2)
SELECT vec_id, {rd('least(greatest(yb + q.q * t.t + q2.q * t2.t, 0.0), 1.0)')} AS prediction
FROM t JOIN t2 USING (vec_id) CROSS JOIN q CROSS JOIN q2 CROSS JOIN yb""")
def pls_two_components(spark, sf):
    df = _labelled(spark, sf)
    out = models.fit_pls(models.moments(df, I.WIDTH, target="ilmenite_fraction"), 2).predict(df)
    return out.select("vec_id", I.rounded("prediction").alias("prediction"))


def _pls_sql(n: int) -> str:
    """Regression with ``n`` components: each one is found on what the ones before have left of ``x`` and ``y``."""
    steps = [f"""x0 AS MATERIALIZED (SELECT vec_id, label / 10.0 - yb AS y, i, (v - mu) / sd AS x FROM l JOIN st USING (i) CROSS JOIN yb)"""]
    for k in range(n):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT i, sum(x * y) AS w FROM x{k} GROUP BY i),
w{k} AS MATERIALIZED (SELECT i, w / (SELECT sqrt(sum(w * w)) FROM d{k}) AS w FROM d{k}),
t{k} AS MATERIALIZED (SELECT vec_id, any_value(y) AS y, sum(x * w) AS t FROM x{k} JOIN w{k} USING (i) GROUP BY vec_id),
q{k} AS MATERIALIZED (SELECT sum(t * y) / sum(t * t) AS q, sum(t * t) AS tt FROM t{k}),
p{k} AS MATERIALIZED (SELECT i, sum(x * t) / any_value(tt) AS p FROM x{k} JOIN t{k} USING (vec_id) CROSS JOIN q{k} GROUP BY i),
x{k + 1} AS MATERIALIZED (SELECT x{k}.vec_id, x{k}.y - q * t AS y, x{k}.i, x - t * p AS x FROM x{k} JOIN t{k} USING (vec_id) JOIN p{k} USING (i) CROSS JOIN q{k})""")
    parts = " UNION ALL ".join(f"SELECT vec_id, q * t AS part FROM t{k} CROSS JOIN q{k}" for k in range(n))
    return f"""WITH {REFLECTANCE}, {LONG},
st AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM l GROUP BY i), yb AS (SELECT avg(label / 10.0) AS yb FROM s),
{', '.join(steps)}
SELECT vec_id, {rd('least(greatest(any_value(yb) + sum(part), 0.0), 1.0)')} AS prediction FROM ({parts}) CROSS JOIN yb GROUP BY vec_id"""


@query("M5", sql=_pls_sql(8))
def pls_eight_components(spark, sf):
    df = _labelled(spark, sf)
    out = models.fit_pls(models.moments(df, I.WIDTH, target="ilmenite_fraction"), 8).predict(df)
    return out.select("vec_id", I.rounded("prediction").alias("prediction"))


@query("M4", "M6", "X1")
def forest_predictions(spark, sf):
    df = _labelled(spark, sf)
    model = models.fit_baseline(df, I.WIDTH)
    out = scoring.score(df.withColumnRenamed("class_index", "label").drop("ilmenite_fraction"), model)
    return out.select("vec_id", "label", "class_index", I.rounded("confidence").alias("confidence"),
                      I.rounded("ilmenite_fraction").alias("ilmenite_fraction"), "status")


@query("M2", "M3", "M6", "M7", "A16")
def trained_split_metrics(spark, sf):
    run = train(_trainable(spark, sf), "full", seed=0)
    return run.metrics.select("split", "n", *[I.rounded(c).alias(c) for c in ("top1_acc", "ilm_rmse", "ilm_r2")])


@query("A14", "A16")
def trained_test_report(spark, sf):
    report = evaluate(train(_trainable(spark, sf), "full", seed=0), "test")
    bounds = report["intervals"].select(F.struct("*").alias("b")).scalar()
    return report["metrics"].withColumn("b", bounds).select("*", "b.*").select(
        "n", *[I.rounded(c).alias(c) for c in ("top1_acc", "accuracy_lo", "accuracy_hi", "ilm_rmse", "rmse_lo", "rmse_hi")])


@query("S10", "S9", "M7", "A18")
def run_from_registry(spark, sf):
    """A multispectral run is trained, stored twice under one id beside another, and evaluated from its store."""
    rows = materialise(I.measurements(spark, sf, "multispectral"), "trainable")
    path = scratch_path(spark, "registry")
    run = train(rows, "multispectral", seed=3, n_trees=50)
    for run_id in ("other", "first", "first"):
        store(run, path, run_id)
    scored = score_stored(spark, path, "first", rows)
    kept = stores.load_temperature(spark, f"{path}/temperature", "first").select(F.struct("*").alias("t")).scalar()
    out = evaluation.metrics(scored, ("split",)).withColumn("t", kept).select("*", "t.*")
    return out.select("split", "n", *[I.rounded(c).alias(c) for c in (
        "top1_acc", "ilm_rmse", "ilm_r2", "temperature", "ece_before", "ece_after")])


@query("A23", "J11", "M6", "S12")
def trained_mixing_ablation(spark, sf):
    """A baseline for the linear and for the albedo form of the vectors, each tested on both; held-out rows only."""
    linear = _labelled(spark, sf).select(
        F.col("vec_id").cast("string").alias("measurement_id"), F.col("vec_id").cast("string").alias("sample_id"),
        F.col("class_index").cast("string").alias("mineral_class"), "features", "class_index", "ilmenite_fraction")
    tables = {"linear": linear, "hapke": linear.withColumn("features", MF.to_albedo("features"))}
    scored = train_ablation(tables, I.WIDTH, seed=0, n_trees=100)
    path = scratch_path(spark, "ablation")
    stores.write_ablation(evaluation.ablation(scored), path)
    out = stores.read_ablation(spark, path)
    return out.select("train_model", "test_model", "n", I.fine("top1_acc").alias("top1_acc"),
                      *[I.rounded(c).alias(c) for c in ("ilm_rmse", "ilm_r2")])


def _trainable(spark, sf):
    """All measurements in full mode: the 288-channel form of every vector."""
    return materialise(I.measurements(spark, sf, "full"), "trainable")


@query("M3", sql=f"""WITH {I.REFLECTANCE}, {LONG}, g AS (SELECT unnest(range(64)) AS i, unnest({I.doubles(I.GRID)}) AS nm),
bw AS (SELECT c.j, g.i, exp(-0.5 * ((nm - centre) / {25.0 / 2.3548200450309493!r}) ** 2) AS w
  FROM (SELECT unnest(range(12)) AS j, unnest({I.doubles(schema.LED_NM)}) AS centre) c CROSS JOIN g),
aw AS (SELECT c.j, g.i, exp(-0.5 * ((nm - centre) / {20.0 / 2.3548200450309493!r}) ** 2) AS w
  FROM (SELECT unnest(range(18)) AS j, unnest({I.doubles(schema.AS7_NM)}) AS centre) c CROSS JOIN g),
bl AS (SELECT vec_id, j, CASE WHEN sum(w) < 1e-9 THEN max(v) FILTER (l.i = 63) * 0.85 ELSE sum(w * v) / sum(w) END AS v FROM l JOIN bw USING (i) GROUP BY ALL),
al AS (SELECT vec_id, j, CASE WHEN sum(w) < 1e-9 THEN max(v) FILTER (l.i = 63) * 0.85 ELSE sum(w * v) / sum(w) END AS v FROM l JOIN aw USING (i) GROUP BY ALL),
bp AS (SELECT vec_id, list(v ORDER BY j) AS led FROM bl GROUP BY vec_id), ap AS (SELECT vec_id, list(v ORDER BY j) AS as7 FROM al GROUP BY vec_id),
f AS (SELECT s.vec_id, list_concat(as7, list_concat(led, [list_avg(spec) * 0.4])) AS x FROM s JOIN bp USING (vec_id) JOIN ap USING (vec_id) WHERE label % 3 > 0)
SELECT vec_id, {digest_sql('x')} FROM f""")
def multispectral_model_input(spark, sf):
    m = I.measurements(spark, sf).where("as7 IS NOT NULL").withColumn("vec_id", F.col("measurement_id").cast("bigint"))
    return I.digest(models.baseline_features(m, "multispectral"), ["vec_id"], "features")


def _full_input_sql(combined: bool = False) -> str:
    """The 288-channel model input from first principles: orthogonal-polynomial smoothing, highest
    chords for the hull, direct sums for the other features."""
    sigma = 25.0 / 2.3548200450309493
    return f"""WITH {I.REFLECTANCE}, {LONG}, g AS (SELECT unnest(range(64)) AS i, unnest({I.doubles(I.GRID)}) AS nm),
bw AS (SELECT c.j, g.i, exp(-0.5 * ((nm - centre) / {sigma!r}) ** 2) AS w
  FROM (SELECT unnest(range(12)) AS j, unnest({I.doubles(schema.LED_NM)}) AS centre) c CROSS JOIN g),
bl AS (SELECT vec_id, j, CASE WHEN sum(w) < 1e-9 THEN max(v) FILTER (l.i = 63) * 0.85 ELSE sum(w * v) / sum(w) END AS v FROM l JOIN bw USING (i) GROUP BY ALL),
led AS (SELECT vec_id, list(v ORDER BY j) AS led FROM bl GROUP BY vec_id),
aw AS (SELECT c.j, g.i, exp(-0.5 * ((nm - centre) / {20.0 / 2.3548200450309493!r}) ** 2) AS w
  FROM (SELECT unnest(range(18)) AS j, unnest({I.doubles(schema.AS7_NM)}) AS centre) c CROSS JOIN g),
al AS (SELECT vec_id, j, CASE WHEN sum(w) < 1e-9 THEN max(v) FILTER (l.i = 63) * 0.85 ELSE sum(w * v) / sum(w) END AS v FROM l JOIN aw USING (i) GROUP BY ALL),
bands AS (SELECT vec_id, list(v ORDER BY j) AS as7 FROM al GROUP BY vec_id),
f AS (SELECT vec_id, list_avg(spec) * 0.4 AS lif, unnest(range(288)) AS i, unnest([spec[q % 64 + 1] for q in range(288)]) AS v FROM s WHERE label % 3 = {2 if combined else 0}),
tt AS (SELECT unnest(range(-5, 6)) AS t),
pol AS (SELECT t, 1.0::DOUBLE AS p0, t::DOUBLE AS p1, (t*t - 10)::DOUBLE AS p2, t*t*t - 17.8*t AS p3 FROM tt),
nrm AS (SELECT sum(p0*p0) AS n0, sum(p1*p1) AS n1, sum(p2*p2) AS n2, sum(p3*p3) AS n3 FROM pol),
co AS (SELECT a.t AS pos, b.t AS t, a.p0*b.p0/n0 + a.p1*b.p1/n1 + a.p2*b.p2/n2 + a.p3*b.p3/n3 AS c FROM pol a CROSS JOIN pol b CROSS JOIN nrm),
cw AS (SELECT i, least(greatest(i, 5), 282) AS mid FROM (SELECT unnest(range(288)) AS i)),
k AS (SELECT i, mid + t AS j, c FROM cw JOIN co ON co.pos = i - mid),
w288 AS (SELECT unnest(range(288)) AS i, unnest({I.doubles(schema.SPEC_GRID)}) AS nm),
sm AS (SELECT vec_id, k.i, any_value(lif) AS lif, any_value(nm) AS nm, sum(f.v * c) AS v FROM f JOIN k ON f.i = k.j JOIN w288 ON w288.i = k.i GROUP BY vec_id, k.i),
wn AS (SELECT i, nm FROM w288 WHERE nm BETWEEN 600 AND 640 OR nm BETWEEN 680 AND 720),
hl AS (SELECT a.vec_id, wn.i, any_value(wn.nm) AS nm, max(CASE WHEN a.i = b.i THEN a.v ELSE a.v + (b.v - a.v) * (wn.nm - a.nm) / (b.nm - a.nm) END) AS hull
  FROM wn JOIN sm a ON a.i <= wn.i JOIN sm b ON b.vec_id = a.vec_id AND b.i >= wn.i GROUP BY a.vec_id, wn.i),
bd AS (SELECT hl.vec_id, 1.0 - min(sm.v / greatest(hull, 1e-9)) FILTER (hl.nm BETWEEN 680 AND 720) AS b700,
  1.0 - min(sm.v / greatest(hull, 1e-9)) FILTER (hl.nm BETWEEN 600 AND 640) AS b620 FROM hl JOIN sm ON sm.vec_id = hl.vec_id AND sm.i = hl.i GROUP BY hl.vec_id),
fx AS (SELECT vec_id, any_value(lif) AS lif, list(v ORDER BY i) AS sm, avg(v) FILTER (nm BETWEEN 500 AND 800) AS alb,
  regr_slope(v, nm) FILTER (nm BETWEEN 500 AND 800) AS slope,
  avg(v) FILTER (nm BETWEEN 340 AND 420) / (avg(v) FILTER (nm BETWEEN 500 AND 600) + 1e-6) AS uv FROM sm GROUP BY vec_id),
x AS (SELECT vec_id, list_concat(list_concat({'list_concat(sm, as7)' if combined else 'sm'}, led), [lif, alb, slope, uv, b700, b620, led[8] / (led[3] + 1e-6),
  (led[9] + led[10] + led[11]) / 3.0 / ((led[3] + led[5]) / 2.0 + 1e-6), lif / (alb + 1e-6)]) AS x
  FROM fx JOIN bd USING (vec_id) JOIN led USING (vec_id) JOIN bands USING (vec_id))
SELECT vec_id, {digest_sql('x')} FROM x"""


@query("M3", sql=_full_input_sql())
def full_model_input(spark, sf):
    m = I.measurements(spark, sf).where("sensor_mode = 'full'").withColumn("vec_id", F.col("measurement_id").cast("bigint"))
    return I.digest(models.baseline_features(m, "full"), ["vec_id"], "features")


@query("M3", sql=_full_input_sql(True))
def combined_model_input(spark, sf):
    m = I.measurements(spark, sf).where("sensor_mode = 'combined'").withColumn("vec_id", F.col("measurement_id").cast("bigint"))
    return I.digest(models.baseline_features(m, "combined"), ["vec_id"], "features")


_BANDS = f"""bw AS (SELECT c.j, g.i, exp(-0.5 * ((nm - centre) / {25.0 / 2.3548200450309493!r}) ** 2) AS w
  FROM (SELECT unnest(range(12)) AS j, unnest({I.doubles(schema.LED_NM)}) AS centre) c CROSS JOIN g),
aw AS (SELECT c.j, g.i, exp(-0.5 * ((nm - centre) / {20.0 / 2.3548200450309493!r}) ** 2) AS w
  FROM (SELECT unnest(range(18)) AS j, unnest({I.doubles(schema.AS7_NM)}) AS centre) c CROSS JOIN g),
bl AS (SELECT vec_id, j, CASE WHEN sum(w) < 1e-9 THEN max(v) FILTER (l.i = 63) * 0.85 ELSE sum(w * v) / sum(w) END AS v FROM l JOIN bw USING (i) GROUP BY ALL),
al AS (SELECT vec_id, j, CASE WHEN sum(w) < 1e-9 THEN max(v) FILTER (l.i = 63) * 0.85 ELSE sum(w * v) / sum(w) END AS v FROM l JOIN aw USING (i) GROUP BY ALL),
bp AS (SELECT vec_id, list(v ORDER BY j) AS led FROM bl GROUP BY vec_id), ap AS (SELECT vec_id, list(v ORDER BY j) AS as7 FROM al GROUP BY vec_id)"""


@query("P1", "P3", "P4", "P5", sql=f"""WITH {I.REFLECTANCE}, {LONG}, g AS (SELECT unnest(range(64)) AS i, unnest({I.doubles(I.GRID)}) AS nm), {_BANDS},
x AS (SELECT s.vec_id, label % 6 AS class_index, [303, 33, 321][label % 3 + 1] AS expected,
  list_concat(list_concat(CASE WHEN label % 3 = 1 THEN [] ELSE [spec[q % 64 + 1] for q in range(288)] END, CASE WHEN label % 3 = 0 THEN [] ELSE as7 END),
  list_concat([spec[64] * 0.95, spec[64] * 0.88], list_concat(led, [list_avg(spec) * 0.4]))) AS x FROM s JOIN bp USING (vec_id) JOIN ap USING (vec_id))
SELECT vec_id, CAST(class_index AS INTEGER) AS class_index, CAST(expected AS INTEGER) AS expected, {digest_sql('x')} FROM x""")
def contract_frame_vectors(spark, sf):
    """Frames at the full block widths as model input, with the width their mode prescribes."""
    m = I.measurements(spark, sf).withColumn("vec_id", F.col("measurement_id").cast("bigint"))
    empty = F.array().cast("array<double>")
    width = F.create_map(*[F.lit(x) for mode in schema.SENSOR_MODES for x in (mode, schema.feature_count(mode))])
    m = m.withColumns({"spec": F.coalesce("spec", empty), "class_index": schema.class_index(), "expected": width[F.col("sensor_mode")]})
    return I.digest(m.withColumn("features", FX.frame_vector()), ["vec_id", "class_index", "expected"], "features")


@query("P1", "P5", sql=f"""WITH {I.REFLECTANCE}, {LONG}, g AS (SELECT unnest(range(64)) AS i, unnest({I.doubles(I.GRID)}) AS nm), {_BANDS}
SELECT {rd('sum(list_sum(led))', 4)} AS total, count(*) AS n, 303 AS full_columns, 33 AS multispectral_columns FROM bp""")
def led_block(spark, sf):
    """One block read alone, beside the column counts of the modes."""
    led = measurements.block(I.measurements(spark, sf), "led")
    counts = {f"{mode}_columns": F.lit(len(schema.columns_for_mode(mode)) - len(schema.META_COLUMNS) - 1) for mode in ("full", "multispectral")}
    return led.agg(I.rounded(F.sum(V.total(F.col("led"))), 4).alias("total"), F.count("*").alias("n")).withColumns(counts)


# ---------------------------------------------------------------- reproducible draws in SQL


def _mix_sql(z: str) -> str:
    """The 64-bit finaliser of the draws; products are taken in 128 bits and cut."""
    word = "18446744073709551616::UHUGEINT"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = f"((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {word})::UBIGINT"
    return f"xor({z}, {z} >> 31)"


def _keys_sql(key: str, source: str, copies: int, columns: str) -> str:
    """``k``: every copy of every row with the base of its draws."""
    head = f"('0x' || substr(md5('0|' || {key} || '|' || copy), 1, 15))::UBIGINT"
    return (f"k0 AS (SELECT {columns}, copy, {head} AS key FROM {source} CROSS JOIN (SELECT unnest(range({copies})) AS copy)), "
            f"k AS (SELECT * EXCLUDE (key), {_mix_sql('key')} AS base FROM k0)")


def _uniform_sql(stream: int, at: str = "0") -> str:
    step, word = f"{0x9E3779B97F4A7C15}::UHUGEINT", "18446744073709551616::UHUGEINT"
    place = f"(({at} + 1 + {stream << 32})::UHUGEINT * {step}) % {word}"
    return f"((({_mix_sql(f'((base::UHUGEINT + {place}) % {word})::UBIGINT')}) >> 11)::DOUBLE + 0.5) / 9007199254740992.0"


def _normal_sql(stream: int, at: str = "0") -> str:
    return f"(sqrt(-2.0 * ln({_uniform_sql(2 * stream, at)})) * cos(2.0 * pi() * ({_uniform_sql(2 * stream + 1, at)})))"


def _noisy_sql(a: str, sigma: float, stream: int, hi: str = "1.5") -> str:
    return f"list_transform({a}, lambda v, n: least(greatest(v + {sigma} * {_normal_sql(stream, '(n - 1)')}, 0.0), {hi}))"


def _augmented_sql(width: int, cfg: augment.AugmentConfig = augment.AugmentConfig()) -> str:
    """``x``: ``spec`` of every row of ``k`` after the chain of gain, cubic drift, shift, noise and dropout."""
    cubic = "c[1] + c[2] * t + c[3] * t * t + c[4] * t * t * t"
    draws = ", ".join(f"2.0 * ({_uniform_sql(102, str(j))}) - 1.0" for j in range(4))
    last = width - 1
    return f"""k1 AS (SELECT *, ({_uniform_sql(100)}) < {cfg.p_apply} AS run, 1.0 + {cfg.intensity} * {_normal_sql(1)} AS gain, [{draws}] AS c,
  floor(({_uniform_sql(103)}) * {2 * cfg.max_shift + 1})::BIGINT - {cfg.max_shift} AS moved FROM k),
k2 AS (SELECT *, list_transform(list_transform(range({width}), lambda i: -1.0 + 2.0 * i / {last}.0), lambda t: {cubic}) AS cubic FROM k1),
k3 AS (SELECT *, list_max(list_transform(cubic, lambda q: abs(q))) + 1e-12 AS most FROM k2),
k4 AS (SELECT *, list_transform(spec, lambda v, n: v * gain + {cfg.baseline} * cubic[n] / most) AS drifted FROM k3),
k5 AS (SELECT *, list_transform(spec, lambda v, n: drifted[least(greatest(n - 1 - moved, 0), {last}) + 1]) AS shifted FROM k4),
k6 AS (SELECT *, list_transform(shifted, lambda v, n: (v + {cfg.noise} * {_normal_sql(4, '(n - 1)')}) * CASE WHEN ({_uniform_sql(105, '(n - 1)')}) >= {cfg.dropout} THEN 1.0 ELSE 0.0 END) AS out FROM k5),
x AS (SELECT *, list_transform(CASE WHEN run THEN out ELSE spec END, lambda v: least(greatest(v, {cfg.lo}), {cfg.hi})) AS x FROM k6)"""


@query("F44", "W3", sql=f"""WITH {I.REFLECTANCE}, {_keys_sql('vec_id', 's', 2, 'vec_id, spec')}, {_augmented_sql(I.WIDTH)}
SELECT vec_id, CAST(copy AS INTEGER) AS copy, {digest_sql('x')} FROM x""")
def augmented_spectra(spark, sf):
    out = augment.augment_spectra(I.reflectance(spark, sf), I.WIDTH, copies=2, key="vec_id")
    return I.digest(out, ["vec_id", "copy"], "spec")


@query("F45", sql=f"""WITH {I.REFLECTANCE}, {LONG}, g AS (SELECT unnest(range(64)) AS i, unnest({I.doubles(I.GRID)}) AS nm), {_BANDS},
m AS (SELECT s.vec_id, CASE WHEN label % 3 <> 1 THEN [spec[q % 64 + 1] for q in range(288)] END AS spec, led,
  [spec[64] * 0.95, spec[64] * 0.88] AS swir, list_avg(spec) * 0.4 AS lif FROM s JOIN bp USING (vec_id)),
{_keys_sql('vec_id', 'm', 1, 'vec_id, spec, led, swir, lif')}, {_augmented_sql(schema.SPEC_WIDTH)}
SELECT vec_id::VARCHAR AS measurement_id, CAST(copy AS INTEGER) AS copy, {rd(f"list_sum({_noisy_sql('led', 0.012, 11)})")} AS led_total,
 {rd(f"list_sum({_noisy_sql('swir', 0.012, 12)})")} AS swir_total, {rd(f"greatest(lif + 0.02 * {_normal_sql(13)}, 0.0)")} AS lif, {digest_sql('x')} FROM x""")
def augmented_measurements(spark, sf):
    """Every measurement; the digest of a block its mode lacks is null."""
    out = augment.augment(I.measurements(spark, sf), copies=1)
    return I.digest(out, ["measurement_id", "copy", I.rounded(V.total(F.col("led"))).alias("led_total"),
                          I.rounded(V.total(F.col("swir"))).alias("swir_total"), I.rounded(schema.LIF).alias("lif")], "spec")


_TTA = f"""WITH {I.REFLECTANCE}, {_keys_sql('vec_id', 's', 8, 'vec_id, spec')},
n AS (SELECT vec_id, list_avg(CASE WHEN copy = 0 THEN spec ELSE {_noisy_sql('spec', 0.005, 21)} END) AS ilm FROM k),
z AS (SELECT vec_id, ilm, list_transform(range(6), lambda j: -abs(ilm * 10.0 - j::DOUBLE)) AS z FROM n),
w AS (SELECT vec_id, ilm, {I.softmax_sql('z')} AS p FROM z),
a AS (SELECT vec_id, least(greatest(avg(ilm), 0.0), 1.0) AS ilm, [{', '.join(f'avg(p[{j}])' for j in range(1, 7))}] AS p, count(*) AS tta_n FROM w GROUP BY vec_id),
u AS (SELECT vec_id, ilm, tta_n, {I.uncertainty_sql('p')} FROM a)
SELECT vec_id, CAST(class_index AS INTEGER) AS class_index, tta_n, {rd('confidence')} AS confidence, {rd('ilm')} AS ilmenite_fraction,
 {I.status_sql('confidence', 'entropy', 'margin')} AS status FROM u"""


@query("M9", sql=_TTA)
def averaged_noisy_predictions(spark, sf):
    lif = V.mean(F.col("features"))
    logits = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: -F.abs(lif * 10.0 - j.cast("double")))
    scorer = scoring.ColumnScorer(V.softmax(logits), lif)
    out = augment.tta(_labelled(spark, sf), scorer, I.WIDTH, 6, key="vec_id")
    return out.select("vec_id", "class_index", "tta_n", I.rounded("confidence").alias("confidence"),
                      I.rounded("ilmenite_fraction").alias("ilmenite_fraction"), "status")
