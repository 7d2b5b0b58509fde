"""Queries over raw counts: normalising, references, profiles, exposure, device readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reflectance as R
from ..functions import vectors as V
from ..operators import calibrate, channels
from ..session import scratch_path
from ..sources import stores
from . import inputs as I
from .inputs import COUNTS, EVENTS, digest_sql, rd
from .registry import query

KEYS = ["l_orderkey", "l_linenumber", "l_suppkey"]
_K = ", ".join(KEYS)


def _norm_sql(raw: str, dark: str, white: str) -> str:
    """Reflectance of element i of three lists, clipped."""
    den = f"({white} - {dark})"
    return f"least(greatest(({raw} - {dark}) / (CASE WHEN abs({den}) < 1e-6 THEN 1e-6 ELSE {den} END), 0.0), 1.5)"


def _each(expr: str, width: int) -> str:
    return f"list_transform(range(1, {width + 1}), lambda i: {expr})"


@query("F1", sql=f"""WITH {COUNTS}, o AS (SELECT {_K}, {_each(_norm_sql('raw[i]', 'dark[i]', 'white[i]'), 8)} AS v FROM c)
SELECT {_K}, {digest_sql('v')} FROM o""")
def reflectance_of_counts(spark, sf):
    return I.digest(I.counts(spark, sf).withColumn("v", R.normalise("raw", "dark", "white")), KEYS, "v")


@query("F8", sql=f"""WITH {COUNTS}, o AS (SELECT {_K}, {_each("CASE WHEN white[i] = dark[i] THEN 0.0 ELSE least(greatest((raw[i] - dark[i]) / (white[i] - dark[i]), 0.0), 1.5) END", 8)} AS v FROM c)
SELECT {_K}, {digest_sql('v')} FROM o""")
def device_reflectance_of_counts(spark, sf):
    return I.digest(I.counts(spark, sf).withColumn("v", R.normalise_device("raw", "dark", "white")), KEYS, "v")


@query("F2", "F3", sql=f"""WITH {COUNTS}, o AS (SELECT {_K}, {_each("dark[i] * (50.0 / exposure_ms) + (temp_c - 22.0) * 2.0", 8)} AS v FROM c)
SELECT {_K}, {digest_sql('v')} FROM o""")
def dark_scaled_and_warmed(spark, sf):
    c = I.counts(spark, sf)
    v = R.dark_at_temperature(R.scale_exposure("dark", "exposure_ms", F.lit(50.0)), "temp_c")
    return I.digest(c.withColumn("v", v), KEYS, "v")


@query("F6", "F7", sql=f"""WITH {COUNTS}, o AS (SELECT {_K}, {_each(_norm_sql('raw[i]', 'dark[i]', 'white[i]'), 8)} AS r, cos(radians(exposure_ms)) AS mu0, cos(radians(temp_c)) AS mu FROM c)
SELECT {_K}, {rd('list_sum(r) * (mu0 + mu) / mu0', 4)} AS lommel_seeliger, {rd('list_sum(r) / mu0', 4)} AS lambertian FROM o""")
def photometric_corrections(spark, sf):
    c = I.counts(spark, sf).withColumn("r", R.normalise("raw", "dark", "white")).withColumn("r2", F.col("r"))
    c = calibrate.photometric(c, "lommel_seeliger", "r", F.col("exposure_ms"), F.col("temp_c"))
    c = calibrate.photometric(c, "lambertian", "r2", F.col("exposure_ms"))
    return c.select(*KEYS, I.rounded(V.total(F.col("r")), 4).alias("lommel_seeliger"), I.rounded(V.total(F.col("r2")), 4).alias("lambertian"))


@query("P11", "A5", sql=f"""WITH {COUNTS} SELECT {_K}, len(list_filter(raw, lambda x: x >= 4000)) AS saturated_pixels,
{rd('len(list_filter(raw, lambda x: x >= 4000)) / 8.0')} AS saturation_fraction FROM c""")
def saturated_pixels(spark, sf):
    out = calibrate.saturation(I.counts(spark, sf), "raw")
    n = F.size(F.filter("saturated", lambda b: b)).cast("bigint")
    return out.select(*KEYS, n.alias("saturated_pixels"), I.rounded("saturation_fraction").alias("saturation_fraction"))


# ---------------------------------------------------------------- session references


def _session_frames(spark, sf, session=None):
    """Sign-ups are dark frames, purchases white frames, other events the frames to calibrate."""
    e = I.table(spark, sf, "events").withColumn("k", I.payload_number())
    e = e.withColumn("session_id", F.col("user_id") if session is None else session)
    px = F.sequence(F.lit(0), F.lit(3))
    kind = F.when(F.col("event_type") == "signup", "dark").when(F.col("event_type") == "purchase", "white")
    e = e.withColumn("kind", kind)
    refs = e.where(kind.isNotNull()).select(
        "session_id", "ts", "kind",
        F.when(F.col("kind") == "dark", F.transform(px, lambda i: F.lit(100.0) + F.col("value") / 10.0 + i))
        .otherwise(F.transform(px, lambda i: F.lit(2500.0) + F.col("value") + i * 50.0)).alias("counts"),
        (F.lit(10.0) + F.col("k") % 5).alias("integration_ms"), (F.lit(20.0) + F.col("k") % 7).alias("temp_c"))
    frames = e.where(kind.isNull()).select(
        "event_id", "session_id", "ts", F.transform(px, lambda i: F.col("value") * 10.0 + i * 100.0).alias("counts"),
        F.col("k").alias("integration_time_ms"), (F.lit(15.0) + F.col("k") % 20).alias("ambient_temp_c"))
    return frames, refs


_ASOF = f"""{EVENTS},
fr AS (SELECT event_id, user_id AS session_id, ts, k, value, 15.0::DOUBLE + k % 20 AS temp FROM e WHERE event_type NOT IN ('signup', 'purchase')),
dk AS (SELECT user_id, ts, value, 10.0::DOUBLE + k % 5 AS ms, 20.0::DOUBLE + k % 7 AS temp FROM e WHERE event_type = 'signup'),
wh AS (SELECT user_id, ts, value, 10.0::DOUBLE + k % 5 AS ms FROM e WHERE event_type = 'purchase'),
j AS (SELECT fr.*, dk.ts AS dark_ts, dk.value AS dv, dk.ms AS dms, dk.temp AS dt, wh.ts AS white_ts, wh.value AS wv, wh.ms AS wms
  FROM fr ASOF LEFT JOIN dk ON dk.user_id = fr.session_id AND fr.ts >= dk.ts
          ASOF LEFT JOIN wh ON wh.user_id = fr.session_id AND fr.ts >= wh.ts)"""


@query("J5", sql=f"WITH {_ASOF} SELECT session_id, ts, dark_ts, white_ts FROM j")
def latest_session_references(spark, sf):
    frames, refs = _session_frames(spark, sf)
    return calibrate.asof_match(frames, refs, "session_id", "ts", "kind", ("dark", "white"))


@query("J5", sql=f"""WITH {EVENTS}, h AS (SELECT ts, event_type, CASE WHEN k % 3 = 0 THEN 0 ELSE user_id END AS session_id FROM e),
fr AS (SELECT DISTINCT session_id, ts FROM h WHERE event_type NOT IN ('signup', 'purchase')),
dk AS (SELECT session_id, ts FROM h WHERE event_type = 'signup'), wh AS (SELECT session_id, ts FROM h WHERE event_type = 'purchase')
SELECT fr.session_id, fr.ts, dk.ts AS dark_ts, wh.ts AS white_ts
FROM fr ASOF LEFT JOIN dk ON dk.session_id = fr.session_id AND fr.ts >= dk.ts
        ASOF LEFT JOIN wh ON wh.session_id = fr.session_id AND fr.ts >= wh.ts""")
def references_of_a_crowded_session(spark, sf):
    """As above with a third of all events moved into one session."""
    frames, refs = _session_frames(spark, sf, F.when(F.col("k") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    return calibrate.asof_match(frames, refs, "session_id", "ts", "kind", ("dark", "white"))


_CAL = _norm_sql("(value * 10.0 + (i - 1) * 100.0) * (wms / k)",
                 "((100.0 + dv / 10.0 + (i - 1)) * (wms / dms) + (temp - dt) * 2.0)", "(2500.0 + wv + (i - 1) * 50.0)")


@query("F4", "J5", sql=f"""WITH {_ASOF},
o AS (SELECT *, CASE WHEN dark_ts IS NULL THEN 'no_dark_reference' WHEN white_ts IS NULL THEN 'no_white_reference'
        WHEN k <= 0 THEN 'bad_exposure' END AS reason FROM j),
v AS (SELECT event_id, reason, CASE WHEN reason IS NULL THEN {_each(_CAL, 4)} END AS r FROM o)
SELECT event_id, reason, {rd('list_sum(r)')} AS total, {rd('r[1] + 2 * r[2] + 3 * r[3] + 4 * r[4]')} AS position_sum FROM v""")
def session_calibration(spark, sf):
    out = calibrate.calibrate(*_session_frames(spark, sf))
    r = F.col("reflectance")
    return out.select("event_id", "reason", I.rounded(V.total(r)).alias("total"),
                      I.rounded(V.total(F.transform(r, lambda x, i: x * (i + 1)))).alias("position_sum"))


# ---------------------------------------------------------------- profiles


def _sweeps(spark, sf):
    return I.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("profile_id"), F.col("l_quantity").alias("temp_c"),
        F.array(F.col("l_extendedprice") / 100.0, F.col("l_discount") * 100.0, F.col("l_tax") * 100.0).alias("counts"))


_PROFILE = """
sw AS (SELECT l_suppkey AS profile_id, l_quantity - 22.0 AS t, unnest([0, 1, 2]) AS i,
         unnest([l_extendedprice / 100.0, l_discount * 100.0, l_tax * 100.0]::DOUBLE[]) AS v FROM lineitem),
co AS (SELECT profile_id, i, regr_intercept(v, t) AS a, regr_slope(v, t) AS b, count(*) AS n FROM sw GROUP BY profile_id, i)"""


@query("A3", "A4", sql=f"""WITH {_PROFILE},
rs AS (SELECT sw.profile_id, avg(abs(v - (a + b * t))) AS m FROM sw JOIN co USING (profile_id, i) GROUP BY sw.profile_id)
SELECT profile_id, i, n AS n_temperatures_fitted, {rd('a')} AS intercept, {rd('b')} AS slope, {rd('m')} AS fit_residual_mean
FROM co JOIN rs USING (profile_id)""")
def dark_current_profiles(spark, sf):
    fit = calibrate.fit_dark_profiles(_sweeps(spark, sf))
    return fit.select("profile_id", "n_temperatures_fitted", "fit_residual_mean",
                      F.posexplode(F.arrays_zip("dark_intercept", "dark_slope")).alias("i", "c")).select(
        "profile_id", "i", "n_temperatures_fitted", I.rounded("c.dark_intercept").alias("intercept"),
        I.rounded("c.dark_slope").alias("slope"), I.rounded("fit_residual_mean").alias("fit_residual_mean"))


_PCAL = _norm_sql("v * (12.0 / q)", "((a + (q - 22.0) * b) * (12.0 / 10.0))", "(CASE fr.i WHEN 0 THEN 900.0 WHEN 1 THEN 15.0 ELSE 12.0 END)")


@query("F5", "S9", sql=f"""WITH {_PROFILE},
fr AS (SELECT l_suppkey, l_quantity AS q, unnest([0, 1, 2]) AS i,
         unnest([l_extendedprice / 100.0, l_discount * 100.0, l_tax * 100.0]::DOUBLE[]) AS v FROM lineitem),
o AS (SELECT l_suppkey, fr.i AS i, {_PCAL} AS r FROM fr JOIN co ON co.profile_id = fr.l_suppkey AND co.i = fr.i)
SELECT l_suppkey, i, count(*) AS n, {rd('avg(r)')} AS mean_reflectance, {rd('max(r)')} AS max_reflectance FROM o GROUP BY l_suppkey, i""")
def profile_calibration(spark, sf):
    fit = calibrate.fit_dark_profiles(_sweeps(spark, sf)).withColumns({
        "white": F.lit([900.0, 15.0, 12.0]), "white_integration_ms": F.lit(12.0), "dark_integration_ms": F.lit(10.0)})
    path = scratch_path(spark, "profiles")
    stores.save_profiles(fit, path)
    profiles = stores.load_profiles(spark, path).withColumn("profile_id", F.col("profile_id").cast("bigint"))
    frames = _sweeps(spark, sf).withColumns({"integration_time_ms": F.col("temp_c"), "ambient_temp_c": F.col("temp_c")})
    out = calibrate.calibrate_with_profiles(frames, profiles)
    long = out.select(F.col("profile_id").alias("l_suppkey"), F.posexplode("reflectance").alias("i", "r"))
    return long.groupBy("l_suppkey", "i").agg(F.count("r").alias("n"), I.rounded(F.avg("r")).alias("mean_reflectance"),
                                              I.rounded(F.max("r")).alias("max_reflectance"))


# ---------------------------------------------------------------- device readings


@query("F9", sql=f"""SELECT l_orderkey, l_linenumber, l_suppkey,
{rd('least(greatest(floor(l_extendedprice) / 65535.0 - floor(l_quantity * 100) / 65535.0, 0.0), 1.5)')} AS swir FROM lineitem""")
def short_wave_counts(spark, sf):
    line = I.table(spark, sf, "lineitem")
    return line.select(*KEYS, I.rounded(R.swir_reflectance(F.floor("l_extendedprice"), F.floor(F.col("l_quantity") * 100))).alias("swir"))


@query("F10", sql=f"""WITH {EVENTS}, v AS (SELECT event_id, k * 42.0 * 3.3 / 4095.0 AS v FROM e),
r AS (SELECT event_id, v, CASE WHEN v > 0 AND v < 3.29 THEN ln(10000.0 * v / (3.3 - v)) END AS r FROM v)
SELECT event_id, {rd('''CASE WHEN v >= 3.29 THEN 150.0 WHEN v <= 0 THEN -273.15
  ELSE 1.0 / (1.009249e-3 + 2.378405e-4 * r + 2.019202e-7 * r * r * r) - 273.15 END''')} AS celsius FROM r""")
def thermistor_temperatures(spark, sf):
    return I.events(spark, sf).select("event_id", I.rounded(R.thermistor_celsius(F.col("k") * 42.0)).alias("celsius"))


@query("F11", sql=f"""WITH {EVENTS},
c AS (SELECT event_id, k, list_transform(range(40), lambda i: least(floor(value * (i + 1))::BIGINT % 5000, 4095)) AS c FROM e),
p AS (SELECT event_id, k, list_reverse_sort(c)[3] AS p95 FROM c)
SELECT event_id, CASE WHEN p95 = 0 THEN 500 ELSE least(greatest((k * 2800) // p95, 1), 500) END::INTEGER AS exposure_ms FROM p""")
def recommended_exposures(spark, sf):
    counts = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.floor(F.col("value") * (i + 1)) % 5000)
    return I.events(spark, sf).select("event_id", R.recommended_exposure(counts, "k").alias("exposure_ms"))


@query("A21", sql=f"""WITH {COUNTS}, l AS (SELECT l_orderkey, unnest(range(8)) AS i, unnest(raw) AS v FROM c)
SELECT l_orderkey, i, (sum(v)::BIGINT // count(*))::INTEGER AS counts FROM l GROUP BY l_orderkey, i""")
def averaged_reads(spark, sf):
    out = channels.average_reads(I.counts(spark, sf), "l_orderkey", "raw")
    return out.select("l_orderkey", F.posexplode("counts").alias("i", "counts"))


@query("A22", sql=f"""WITH {COUNTS},
rf AS (SELECT o_orderkey, list_transform(range(8), lambda i: 100.0::DOUBLE + o_custkey % 50 + i) AS dk,
  list_transform(range(8), lambda i: CASE WHEN i = 3 THEN 103.0 + o_custkey % 50 ELSE 3000.0::DOUBLE - i * 100.0 END) AS wh FROM orders),
px AS (SELECT c.l_orderkey, l_linenumber, unnest({_each("CASE WHEN wh[i] = dk[i] THEN 0.0 ELSE least(greatest((raw[i] - dk[i]) / (wh[i] - dk[i]), 0.0), 1.5) END", 8)}) AS r
  FROM c JOIN rf ON o_orderkey = c.l_orderkey)
SELECT l_orderkey, l_linenumber, {rd('avg(r)')} AS reflectance FROM px GROUP BY l_orderkey, l_linenumber""")
def led_channel_reflectance(spark, sf):
    px = F.sequence(F.lit(0), F.lit(7))
    shade = F.lit(100.0) + F.col("o_custkey") % 50
    refs = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.transform(px, lambda i: shade + i).alias("dark"),
        F.transform(px, lambda i: F.when(i == 3, shade + 3.0).otherwise(F.lit(3000.0) - i * 100.0)).alias("white"))
    out = calibrate.led_reflectance(I.counts(spark, sf), refs, "l_orderkey", "l_linenumber", "raw")
    return out.select("l_orderkey", "l_linenumber", I.rounded("reflectance").alias("reflectance"))


@query("F38", sql=f"""WITH {I.REFLECTANCE}, q AS (SELECT vec_id, list_transform(spec, lambda x: least(greatest(round_even(x * 65535.0, 0) / 65535.0, 0.0), 1.5)) AS v FROM s)
SELECT vec_id, {digest_sql('v', 6)} FROM q""")
def quantised_spectra(spark, sf):
    return I.digest(I.reflectance(spark, sf).withColumn("v", R.quantise("spec")), ["vec_id"], "v", 6)
