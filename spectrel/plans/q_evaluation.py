"""Queries over scored tables: uncertainty, calibration of confidence, metrics, fusion, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mixing as MF
from ..functions import uncertainty as U
from ..functions import vectors as V
from ..operators import bootstrap, channels, evaluate, fusion, ranking, sam, scoring
from ..session import scratch_path
from ..sources import stores
from . import inputs as I
from .inputs import (LOGITS, LONG, PROBS, SAM_PROBS, SCORED, SHOTS, argmax_sql, doubles, fr, rd, softmax_sql,
                     status_sql, uncertainty_sql)
from .registry import query


def _probabilities(spark, sf):
    return I.logits(spark, sf).withColumn("probabilities", V.softmax(F.col("logits")))


_UNC = PROBS + f", un AS (SELECT vec_id, label, p, {uncertainty_sql('p')} FROM p), " \
    f"us AS (SELECT *, {status_sql('confidence', 'entropy', 'margin')} AS status FROM un)"


# ---------------------------------------------------------------- uncertainty


@query("F26", "F27", "F28", "M8", sql=f"""WITH {_UNC} SELECT vec_id, class_index, {rd('confidence')} AS confidence,
{rd('entropy')} AS entropy, {rd('margin')} AS margin, status FROM us""")
def uncertainty_status(spark, sf):
    out = U.with_uncertainty(_probabilities(spark, sf))
    return out.select("vec_id", "class_index", *[I.rounded(c).alias(c) for c in ("confidence", "entropy", "margin")], "status")


@query("P12", sql=f"""WITH {_UNC} SELECT status IN ('nominal', 'borderline') AS trustworthy, count(*) AS n,
{fr('avg((class_index = label)::INT)')} AS accuracy FROM us GROUP BY 1""")
def trustworthy_share(spark, sf):
    out = U.with_uncertainty(_probabilities(spark, sf)).withColumn("trustworthy", U.trustworthy())
    return out.groupBy("trustworthy").agg(
        F.count(F.lit(1)).alias("n"), I.fine(F.avg((F.col("class_index") == F.col("label")).cast("int"))).alias("accuracy"))


@query("T3", sql=f"""WITH {PROBS} SELECT vec_id, {rd('list_reverse_sort(p)[1] - list_reverse_sort(p)[2]')} AS margin_2,
{rd('list_reverse_sort(p)[1] - list_reverse_sort(p)[5]')} AS margin_5 FROM p""")
def top_k_margins(spark, sf):
    p = _probabilities(spark, sf)
    return p.select("vec_id", I.rounded(U.top_k_margin("probabilities")).alias("margin_2"),
                    I.rounded(U.top_k_margin("probabilities", 5)).alias("margin_5"))


@query("F29", sql=f"""WITH {LOGITS}, t AS (SELECT vec_id, list_transform(logits, lambda q: q / 2.5) AS z FROM z),
p AS (SELECT vec_id, {softmax_sql('z')} AS p FROM t)
SELECT vec_id, unnest(range(10)) AS i, unnest(list_transform(p, lambda x: {rd('x')})) AS v FROM p""")
def temperature_scaled_probabilities(spark, sf):
    return I.long(I.logits(spark, sf).withColumn("p", U.temperature_scaled("logits", 2.5)), ["vec_id"], "p")


@query("F30", sql=f"""WITH {PROBS}, t AS (SELECT vec_id, list_transform(p, lambda q: ln(least(greatest(q, 1e-12), 1.0)) / 1.7) AS z FROM p),
o AS (SELECT vec_id, {softmax_sql('z')} AS p FROM t)
SELECT vec_id, unnest(range(10)) AS i, unnest(list_transform(p, lambda x: {rd('x')})) AS v FROM o""")
def retempered_probabilities(spark, sf):
    return I.long(_probabilities(spark, sf).withColumn("p", U.retempered("probabilities", 1.7)), ["vec_id"], "p")


@query("T4", sql=f"""WITH {PROBS}, x AS (SELECT vec_id, unnest(range(10)) AS k, unnest(p) AS v FROM p)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) - 1 AS rank, 'class_' || k AS name, {rd('v')} AS probability FROM x""")
def ranked_class_probabilities(spark, sf):
    names = [f"class_{k}" for k in range(10)]
    out = _probabilities(spark, sf).select("vec_id", F.posexplode(U.ranked_probabilities("probabilities", names)).alias("rank", "r"))
    return out.select("vec_id", "rank", "r.name", I.rounded("r.probability").alias("probability"))


@query("M11", sql=f"""WITH {_UNC}, x AS (SELECT *, unnest(range(10)) AS k, unnest(p) AS v FROM us)
SELECT vec_id, 'class_' || class_index AS predicted_class, 'class_' || k AS name, {rd('v')} AS probability, status,
'table' AS model_version FROM x""")
def prediction_payload(spark, sf):
    scorer = scoring.ColumnScorer(V.softmax(F.col("logits")), F.lit(0.5))
    names = [f"class_{k}" for k in range(10)]
    out = scoring.payload(scoring.score(I.logits(spark, sf), scorer), names, "table")
    return out.select("vec_id", "predicted_class", F.explode("probabilities").alias("p"), "status", "model_version").select(
        "vec_id", "predicted_class", "p.name", I.rounded("p.probability").alias("probability"), "status", "model_version")


# ---------------------------------------------------------------- calibration of confidence

_BINS = doubles(evaluate.bin_edges(15))
_REL = PROBS + f""", c AS (SELECT list_max(p) AS c, ({argmax_sql('p')} = label)::INT AS hit FROM p),
bn AS (SELECT len(list_filter({_BINS}, lambda e: e < c)) - 1 AS bin, count(*) AS n, avg(c) AS confidence, avg(hit) AS accuracy FROM c GROUP BY 1)"""


@query("A17", sql=f"WITH {_REL} SELECT bin, n, {rd('confidence')} AS confidence, {fr('accuracy')} AS accuracy FROM bn")
def reliability_table(spark, sf):
    out = evaluate.reliability(_probabilities(spark, sf), label="label")
    return out.select("bin", "n", I.rounded("confidence").alias("confidence"), I.fine("accuracy").alias("accuracy"))


@query("A17", sql=f"WITH {_REL} SELECT {rd('sum(n * abs(confidence - accuracy)) / sum(n)')} AS ece FROM bn")
def calibration_error(spark, sf):
    return evaluate.expected_calibration_error(_probabilities(spark, sf), label="label").select(I.rounded("ece").alias("ece"))


_TGRID = doubles(evaluate.temperature_grid())
_LOSS = LOGITS + f""", tg AS (SELECT unnest({_TGRID}) AS t),
ls AS (SELECT t, avg(-ln(least(greatest(exp((logits[label + 1] - list_max(logits)) / t)
        / list_sum(list_transform(logits, lambda q: exp((q - list_max(logits)) / t))), 1e-12), 1.0))) AS nll
       FROM z CROSS JOIN tg GROUP BY t)"""


@query("A18", sql=f"WITH {_LOSS} SELECT {rd('t')} AS temperature, {rd('nll')} AS nll FROM ls")
def temperature_loss_curve(spark, sf):
    out = evaluate.temperature_loss(I.logits(spark, sf), I.N_LABELS, label="label")
    return out.select(I.rounded("temperature").alias("temperature"), I.rounded("nll").alias("nll"))


def _recalibration_sql() -> str:
    ece = lambda name, t: f"""p_{name} AS (SELECT label, list_transform(logits, lambda q: exp((q - list_max(logits)) / {t}) / list_sum(list_transform(logits, lambda r: exp((r - list_max(logits)) / {t})))) AS p
  FROM z CROSS JOIN best WHERE vec_id % 2 = 1),
b_{name} AS (SELECT len(list_filter({_BINS}, lambda e: e < list_max(p))) - 1 AS bin, count(*) AS n, avg(list_max(p)) AS c, avg(({argmax_sql('p')} = label)::INT) AS a FROM p_{name} GROUP BY 1)"""  # noqa: E731
    loss = _LOSS.replace("FROM z CROSS JOIN tg", "FROM z CROSS JOIN tg WHERE vec_id % 2 = 0")
    return f"""WITH {loss}, best AS (SELECT arg_min(t, (nll, t)) AS t FROM ls), {ece('old', '1.0')}, {ece('new', 't')}
SELECT {rd('t')} AS temperature, (SELECT {rd('sum(n * abs(c - a)) / sum(n)')} FROM b_old) AS ece_before,
(SELECT {rd('sum(n * abs(c - a)) / sum(n)')} FROM b_new) AS ece_after FROM best"""


@query("A17", "A18", "S10", sql=_recalibration_sql())
def recalibrated_probabilities(spark, sf):
    """Even rows set the temperature, odd rows measure it; it goes through its store."""
    rows = I.logits(spark, sf).withColumn("split", F.when(F.col("vec_id") % 2 == 0, F.lit("val")).otherwise(F.lit("test")))
    done = evaluate.recalibrate(rows, I.N_LABELS, label="label").first()
    path = scratch_path(spark, "temperature")
    stores.save_temperature(spark, path, "run", *done)
    return stores.load_temperature(spark, path, "run").select(*[I.rounded(c).alias(c) for c in ("temperature", "ece_before", "ece_after")])


@query("A18", sql=f"WITH {_LOSS} SELECT {rd('arg_min(t, (nll, t))')} AS temperature, {rd('min(nll)')} AS nll FROM ls")
def fitted_temperature(spark, sf):
    out = evaluate.fit_temperature(I.logits(spark, sf), I.N_LABELS, label="label")
    return out.select(I.rounded("temperature").alias("temperature"), I.rounded("nll").alias("nll"))


# ---------------------------------------------------------------- metrics

_CM = SCORED + """, cm AS (SELECT t.i AS class_true, p.i AS class_pred, count(b.vec_id) AS n
  FROM (SELECT unnest(range(10)) AS i) t CROSS JOIN (SELECT unnest(range(10)) AS i) p
  LEFT JOIN b ON b.label = t.i AND b.pred = p.i GROUP BY t.i, p.i)"""


def _confusion(spark, sf):
    return evaluate.confusion_matrix(I.scores(spark, sf), I.N_LABELS, "label", "sam_index").withColumnsRenamed(
        {"label": "class_true", "sam_index": "class_pred"})


@query("A10", sql=f"WITH {_CM} SELECT class_true, class_pred, n FROM cm")
def sam_confusion_matrix(spark, sf):
    return _confusion(spark, sf)


@query("A11", sql=f"""WITH {_CM}, ac AS (SELECT class_true AS k, sum(n) AS actual, sum(n) FILTER (class_true = class_pred) AS hit FROM cm GROUP BY 1),
c AS (SELECT class_pred AS k, sum(n) AS called FROM cm GROUP BY 1),
x AS (SELECT ac.k, actual, CASE WHEN called = 0 THEN 0.0 ELSE hit / called END AS p, CASE WHEN actual = 0 THEN 0.0 ELSE hit / actual END AS r
      FROM ac JOIN c USING (k))
SELECT k AS class_index, {fr('p')} AS precision, {fr('r')} AS recall,
{fr('CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END')} AS f1, actual::BIGINT AS support FROM x""")
def sam_class_report(spark, sf):
    out = evaluate.per_class(_confusion(spark, sf))
    return out.select("class_index", *[I.fine(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("A15", sql=f"""WITH {_CM} SELECT class_true, class_pred, n,
row_number() OVER (PARTITION BY class_true ORDER BY n DESC, class_pred) AS rank FROM cm WHERE class_true <> class_pred AND n > 0""")
def sam_failure_targets(spark, sf):
    return evaluate.confusions(_confusion(spark, sf))


def _scored_values(spark, sf):
    """Scored spectra with a regression target: the spectrum's mean against its predicted class's."""
    s = I.spectra(spark, sf).withColumn("value_true", V.mean(F.col("spec")))
    # One row for each class: packed and looked up, so the scored table is not shuffled on ten keys.
    packed = s.groupBy("label").agg(F.avg("value_true").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("label", "m")))).scalar()
    out = I.scores(spark, sf).select("vec_id", F.col("label").alias("class_true"), F.col("sam_index").alias("class_pred"),
                                     V.mean(F.col("spec")).alias("value_true"))
    return out.withColumn("_m", packed).withColumn("value_pred", F.try_element_at("_m", F.col("class_pred"))).drop("_m")


_VALUES = SCORED + """, sv AS (SELECT vec_id, label, list_avg(spec) AS v FROM s),
cv AS (SELECT label, avg(v) AS pv FROM sv GROUP BY label),
sc AS (SELECT b.vec_id, b.label AS class_true, b.pred AS class_pred, sv.v AS value_true, cv.pv AS value_pred
       FROM b JOIN sv USING (vec_id) JOIN cv ON cv.label = b.pred)"""
_METRICS = f"""count(*) AS n, {fr('avg((class_true = class_pred)::INT)')} AS top1_acc,
{rd('sqrt(avg((value_pred - value_true) * (value_pred - value_true)))')} AS ilm_rmse,
{rd('1 - var_pop(value_pred - value_true) / var_pop(value_true)')} AS ilm_r2"""


@query("A12", "M7", "A16", sql=f"WITH {_VALUES} SELECT {_METRICS} FROM sc")
def evaluation_metrics(spark, sf):
    out = evaluate.metrics(_scored_values(spark, sf))
    return out.select("n", I.fine("top1_acc").alias("top1_acc"), *[I.rounded(c).alias(c) for c in ("ilm_rmse", "ilm_r2")])


@query("J10", "A12", sql=f"WITH {_VALUES} SELECT class_true, {_METRICS} FROM sc GROUP BY class_true")
def evaluation_metrics_by_class(spark, sf):
    out = evaluate.metrics(_scored_values(spark, sf), ("class_true",))
    return out.select("class_true", "n", I.fine("top1_acc").alias("top1_acc"), *[I.rounded(c).alias(c) for c in ("ilm_rmse", "ilm_r2")])


_ABLATE = {"linear": "v", "hapke": "1.0 - ((1.0 - v) / (1.0 + v)) * ((1.0 - v) / (1.0 + v))"}


def _ablation_sql() -> str:
    ctes = [I.REFLECTANCE, LONG]
    for name, expr in _ABLATE.items():
        ctes.append(f"x_{name} AS (SELECT vec_id, label, i, {expr} AS v FROM l)")
        ctes.append(f"s_{name} AS (SELECT vec_id, label, list(v ORDER BY i) AS spec FROM x_{name} GROUP BY vec_id, label)")
        ctes.append(f"r_{name} AS (SELECT label, list(v ORDER BY i) AS ref FROM (SELECT label, i, avg(v) AS v FROM x_{name} GROUP BY label, i) GROUP BY label)")
    parts = []
    for train in _ABLATE:
        for test in _ABLATE:
            parts.append(f"""SELECT '{train}' AS train_model, '{test}' AS test_model, s.vec_id, s.label AS class_true, list_avg(spec) AS value_true,
 arg_min(r.label, (acos(greatest(-1.0, least(1.0, list_dot_product(spec, ref) / (sqrt(list_dot_product(spec, spec)) * sqrt(list_dot_product(ref, ref)))))), r.label)) AS class_pred
 FROM s_{test} s CROSS JOIN r_{train} r GROUP BY ALL""")
    return f"""WITH {', '.join(ctes)}, u AS ({' UNION ALL '.join(parts)}), w AS (SELECT *, class_pred / 10.0 AS value_pred FROM u)
SELECT train_model, test_model, {_METRICS} FROM w GROUP BY train_model, test_model"""


class _AngleScorer:
    def __init__(self, refs):
        self.refs = refs

    def score(self, df):
        out = sam.sam_classify(df, self.refs, name="label")
        return out.withColumn("ilmenite_fraction", F.col("sam_index") / 10.0).drop("angles", "sam_class", "sam_index", "angle_rad", "angle_deg")


@query("A23", "J11", "X1", sql=_ablation_sql())
def mixing_ablation(spark, sf):
    linear = I.reflectance(spark, sf)
    tests = {"linear": linear, "hapke": linear.withColumn("spec", MF.to_albedo("spec"))}
    tests = {k: t.withColumn("value_true", V.mean(F.col("spec"))) for k, t in tests.items()}
    scorers = {k: _AngleScorer(channels.class_means(t, "label", "spec")) for k, t in tests.items()}
    scored = scoring.cross_models(scorers, tests)
    out = evaluate.ablation(scored, class_true="label", class_pred="class_index", value_pred="ilmenite_fraction")
    return out.select("train_model", "test_model", "n", I.fine("top1_acc").alias("top1_acc"), *[I.rounded(c).alias(c) for c in ("ilm_rmse", "ilm_r2")])


# ---------------------------------------------------------------- bootstrap


@query("A13", "X3", sql=f"""WITH rk AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR)) AS rk, count(*) OVER () AS n FROM customer),
dr AS (SELECT b, (('0x' || substr(md5('0|' || b || '|' || (rk - 1)), 1, 15))::BIGINT % n) + 1 AS rk FROM rk CROSS JOIN (SELECT unnest(range(500)) AS b)),
rp AS (SELECT b, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM dr JOIN rk USING (rk) GROUP BY b)
SELECT {rd('quantile_cont(m, 0.025)', 4)} AS mean_lo, {rd('quantile_cont(m, 0.975)', 4)} AS mean_hi,
{rd('quantile_cont(sd, 0.025)', 4)} AS spread_lo, {rd('quantile_cont(sd, 0.975)', 4)} AS spread_hi FROM rp""")
def bootstrap_by_draws(spark, sf):
    stats = {"mean": F.avg("c_acctbal"), "spread": F.stddev_pop("c_acctbal")}
    rows = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = evaluate.bootstrap_draws(rows, "c_custkey", stats)
    return out.select(*[I.rounded(c, 4).alias(c) for c in out.columns])


def _bootstrap_sql(n: int = 500) -> str:
    factors = ", ".join(map(str, evaluate.replicate_factors(n)))
    steps = ", ".join(repr(p * evaluate.PRIME) for p in evaluate.POISSON)
    word = lambda at: f"(('0x' || substr(md5('0|' || vec_id), {at}, 8))::BIGINT % {evaluate.PRIME})"
    return f"""WITH {_VALUES}, k AS (SELECT (class_true = class_pred)::INT::DOUBLE AS hit, value_pred - value_true AS e, value_true AS y, {word(1)} AS u, {word(9)} AS v FROM sc),
mid AS (SELECT avg(e) AS e0, avg(y) AS y0 FROM k),
cen AS (SELECT hit, e * e AS sq, e - e0 AS e, y - y0 AS y, u, v FROM k CROSS JOIN mid),
wt AS (SELECT b, hit, sq, e, y, len(list_filter([{steps}], lambda x: x <= (u * f + v) % {evaluate.PRIME})) AS w
  FROM cen CROSS JOIN (SELECT unnest(range({n})) AS b, unnest([{factors}]) AS f)),
rep AS (SELECT sum(w * hit) / sum(w) AS accuracy, sqrt(sum(w * sq) / sum(w)) AS rmse,
  1 - (sum(w * e * e) / sum(w) - pow(sum(w * e) / sum(w), 2)) / (sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2)) AS r2 FROM wt GROUP BY b)
SELECT {', '.join(f"{rd(f'quantile_cont({c}, {q})')} AS {c}_{side}" for c in ('accuracy', 'rmse', 'r2') for q, side in ((0.025, 'lo'), (0.975, 'hi')))} FROM rep"""


@query("A13", "A14", sql=_bootstrap_sql())
def bootstrap_intervals(spark, sf):
    out = evaluate.intervals(_scored_values(spark, sf), "vec_id")
    return out.select(*[I.rounded(c).alias(c) for c in out.columns])


# ---------------------------------------------------------------- fusion


def _fusion_sql(parts: str) -> str:
    return f"""WITH {SHOTS}, fs AS (SELECT user_id, [{parts}] AS p, least(greatest(avg(ilm), 0.0), 1.0) AS ilm, count(*) AS n FROM sh GROUP BY user_id),
un AS (SELECT user_id, ilm, n, {uncertainty_sql('p')} FROM fs)
SELECT user_id, class_index, {fr('confidence')} AS confidence, {fr('entropy')} AS entropy, {fr('margin')} AS margin,
{status_sql('confidence', 'entropy', 'margin')} AS status, {fr('ilm')} AS ilmenite_fraction, n AS fused_n FROM un"""


def _fused(spark, sf, method):
    return _shown_fusion(fusion.fuse(I.shots(I.events(spark, sf)), 5, "user_id", method=method))


def _shown_fusion(out):
    return out.select("user_id", "class_index", *[I.fine(c).alias(c) for c in ("confidence", "entropy", "margin", "ilmenite_fraction")],
                      "status", "fused_n")


FUSED_MEAN_SQL = _fusion_sql(", ".join(f"avg(p[{k + 1}])" for k in range(5)))


@query("A8", sql=FUSED_MEAN_SQL)
def fused_shots_mean(spark, sf):
    return _fused(spark, sf, "mean")


@query("A9", sql=_fusion_sql(", ".join(f"count(*) FILTER ({argmax_sql('p')} = {k}) / count(*)::DOUBLE" for k in range(5))))
def fused_shots_vote(spark, sf):
    return _fused(spark, sf, "vote")


@query("A8", sql=FUSED_MEAN_SQL.replace(
    "FROM sh GROUP BY user_id", "FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM sh) GROUP BY user_id"))
def fused_shots_of_a_crowded_sample(spark, sf):
    """Fusion with a third of all shots moved onto one sample."""
    shots = I.shots(I.events(spark, sf)).withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    return _shown_fusion(fusion.fuse(shots, 5, "user_id"))


# ---------------------------------------------------------------- ranking

_POOL = SAM_PROBS + f""", lg AS (SELECT s.vec_id, list(120.0 * list_dot_product(spec, ref) ORDER BY r.label) AS z FROM s CROSS JOIN r GROUP BY s.vec_id),
lp AS (SELECT vec_id, {softmax_sql('z')} AS p FROM lg),
un AS (SELECT vec_id, {uncertainty_sql('p')} FROM lp),
ac AS (SELECT un.vec_id, class_index, b.pred AS second_class, confidence, entropy / ln(10) AS entropy_norm, margin,
        class_index <> b.pred AS disagreement, {status_sql('confidence', 'entropy', 'margin')} AS status FROM un JOIN b USING (vec_id)),
rk AS (SELECT *, least(greatest(0.4 * entropy_norm + 0.3 * (1.0 - margin) + 0.3 * disagreement::INT, 0.0), 1.0) AS composite FROM ac)"""
_RANK_COLS = f"""vec_id, class_index, second_class, {rd('confidence')} AS confidence, {rd('entropy_norm')} AS entropy_norm,
{rd('margin')} AS margin, disagreement, {rd('composite')} AS composite, status"""


def _acquisition(spark, sf):
    return ranking.acquisition(U.with_uncertainty(_probabilities(spark, sf)), I.scores(spark, sf), "vec_id", I.N_LABELS)


def _shown(df):
    return df.select("vec_id", "class_index", "second_class", *[I.rounded(c).alias(c) for c in ("confidence", "entropy_norm", "margin")],
                     "disagreement", I.rounded("composite").alias("composite"), "status")


@query("F42", "M10", "J6", "X2", sql=f"WITH {_POOL} SELECT {_RANK_COLS} FROM rk")
def acquisition_scores(spark, sf):
    return _shown(_acquisition(spark, sf))


@query("T1", "M10", sql=f"WITH {_POOL} SELECT {_RANK_COLS} FROM (SELECT * FROM rk ORDER BY composite DESC, vec_id LIMIT 25)")
def ranked_pool(spark, sf):
    return _shown(ranking.top(_acquisition(spark, sf), "vec_id", 25))


@query("A19", sql=f"WITH {_POOL} SELECT {fr('avg(disagreement::INT)')} AS disagreement_rate FROM rk")
def classifier_disagreement(spark, sf):
    return ranking.disagreement_rate(_acquisition(spark, sf)).select(I.fine("disagreement_rate").alias("disagreement_rate"))


@query("W5", "T5", sql="""SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
FROM events QUALIFY rank <= 10""")
def latest_log_entries(spark, sf):
    return ranking.latest(I.table(spark, sf, "events").select("user_id", "event_id", "ts"), "ts", "event_id", 10, "user_id")


@query("A13", "X3")
def bootstrap_by_tree(spark, sf):
    """Exactly as many draws as rows in each of 500 replicates; mean, spread, median and 90th percentile."""
    out = bootstrap.bootstrap_exact(I.table(spark, sf, "customer"), "c_acctbal", {"median": 0.5, "p90": 0.9})
    return out.select(*[I.rounded(c, 4).alias(c) for c in out.columns])
