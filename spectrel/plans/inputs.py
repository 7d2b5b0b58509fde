"""The given tables seen as spectra, frames, fractions and scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import kernels
from ..functions import vectors as V
from ..operators import channels, mixing, sam

#: Width of the given vectors and the wavelength grid they are read on.
WIDTH = 64
GRID = [float(x) for x in np.linspace(340.0, 850.0, WIDTH)]
N_LABELS = 10
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
DIGITS = 6
#: For ratios of small counts, which often end in a 5 just past the sixth digit.
FINE = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = DIGITS) -> Column:
    return F.round(V.col(c), digits) + F.lit(0.0)


def fine(c: Column | str) -> Column:
    return rounded(c, FINE)


def long(df: DataFrame, keys: list[str], column: str, value: str = "v", digits: int = DIGITS) -> DataFrame:
    """One row per array element, rounded for comparison."""
    out = df.select(*keys, F.posexplode(column).alias("i", value))
    return out.withColumn(value, rounded(value, digits))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, spec``."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("spec"))


def reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors moved into reflectance range: ``0.5 + 0.6 x``."""
    return spectra(spark, sf_dir).withColumn("spec", F.transform("spec", lambda x: x * 0.6 + 0.5))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra classified against the class means: the scored table of the evaluation queries."""
    s = spectra(spark, sf_dir)
    return sam.sam_classify(s, channels.class_means(s, "label", "spec"), name="label")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, logits``: 120 x the dot products with the class means, in label order."""
    s = spectra(spark, sf_dir)
    means = channels.class_means(s, "label", "spec").orderBy("label").collect()  # one row a class
    matrix = 120.0 * np.array([r["spec"] for r in means])
    return s.select("vec_id", "label", kernels.linear_kernel(matrix)(F.col("spec")).alias("logits"))


def payload_number() -> Column:
    """The number inside an event's JSON payload."""
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", payload_number())


def shots(events: DataFrame) -> DataFrame:
    """Each event as a scored shot of its user: five pseudo-probabilities and a fraction."""
    weights = F.array(*[F.exp(-F.abs(F.col("value") / 40.0 - F.lit(float(j)))) for j in range(5)])
    e = events.withColumn("w", weights)
    return e.select("event_id", "user_id", "event_type", "ts",
                    V.let(V.total(F.col("w")), lambda s: F.transform("w", lambda x: x / s)).alias("probabilities"),
                    (F.col("k") / 100.0).alias("ilmenite_fraction"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as an eight-pixel raw frame with its own dark and white frames."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax")
    pixel = F.sequence(F.lit(0), F.lit(7))
    return line.select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.transform(pixel, lambda i: F.pmod(F.floor(F.col("l_extendedprice") * (i + 1) / 25.0), F.lit(4096)).cast("double")).alias("raw"),
        F.transform(pixel, lambda i: (F.lit(100.0) + F.col("l_quantity") + i)).alias("dark"),
        F.transform(pixel, lambda i: (F.lit(3000.0) + F.col("l_quantity") * 10.0 - i * 400.0)).alias("white"),
        F.col("l_quantity").alias("exposure_ms"), (F.lit(15.0) + F.col("l_tax") * 200.0).alias("temp_c"),
    )


def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each event type in a user's events, as end-member fractions."""
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    whole = e.groupBy("user_id").agg(F.sum("n").alias("all"))
    return e.join(whole, "user_id").select(
        F.col("user_id").alias("sample_id"), F.col("event_type").alias("endmember"),
        (F.col("n") / F.col("all")).alias("fraction"))


def endmembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reflectances of the labels dealt out to the five event types."""
    name = F.get(F.lit(list(EVENT_TYPES)), F.pmod("label", F.lit(len(EVENT_TYPES))))
    return channels.class_means(reflectance(spark, sf_dir).withColumn("endmember", name), "endmember", "spec")


def measurements(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """The vectors as canonical measurements of all three sensor modes, or all in mode ``only``."""
    r = reflectance(spark, sf_dir)
    mode = F.lit(only) if only else F.get(F.lit(list(schema.SENSOR_MODES)), F.pmod("label", F.lit(3)))
    last = F.element_at("spec", -1)
    full = F.transform(F.sequence(F.lit(0), F.lit(schema.SPEC_WIDTH - 1)), lambda i: F.get("spec", i % WIDTH))
    r = mixing.band_response(r, GRID, schema.LED_NM, 25.0, out="led")
    r = mixing.band_response(r, GRID, schema.AS7_NM, 20.0, out="as7")
    klass = F.get(F.lit(list(schema.MINERAL_CLASSES)), F.pmod("label", F.lit(6)))
    return r.select(
        F.concat(F.lit("S"), F.pmod("vec_id", F.lit(50)).cast("string"), F.lit("_"), klass).alias("sample_id"),
        F.col("vec_id").cast("string").alias("measurement_id"), F.lit("2024-01-01T00:00:00").alias("timestamp"),
        klass.alias("mineral_class"), (F.col("label") / 10.0).alias("ilmenite_fraction"),
        F.lit(100).alias("integration_time_ms"), F.lit(22.5).alias("ambient_temp_c"),
        F.get(F.lit(list(schema.PACKING_DENSITIES)), F.pmod("label", F.lit(3))).alias("packing_density"),
        mode.alias("sensor_mode"), F.when(mode != "multispectral", full).alias("spec"),
        F.when(mode != "full", F.col("as7")).alias("as7"), F.array(last * 0.95, last * 0.88).alias("swir"), "led",
        (V.mean(F.col("spec")) * 0.4).alias(schema.LIF))


def digest(df: DataFrame, keys: list[str], column: str, digits: int = 4) -> DataFrame:
    """Per row: element count, sum and position-weighted sum of an array."""
    a = F.col(column)
    return df.select(*keys, F.size(a).cast("bigint").alias("width"), rounded(V.total(a), digits).alias("total"),
                     rounded(V.total(F.transform(a, lambda x, i: x * (i + 1))), digits).alias("position_sum"))


# ---------------------------------------------------------------- the same in SQL


def digest_sql(a: str, digits: int = 4) -> str:
    return (f"len({a}) AS width, {rd(f'list_sum({a})', digits)} AS total, "
            f"{rd(f'list_dot_product({a}::DOUBLE[], range(1, len({a}) + 1)::DOUBLE[])', digits)} AS position_sum")


def rd(expr: str, digits: int = DIGITS) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def fr(expr: str) -> str:
    return rd(expr, FINE)


def doubles(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


SPECTRA = "s AS (SELECT vec_id, label, embedding::DOUBLE[] AS spec FROM embeddings)"
LONG = "l AS (SELECT vec_id, label, unnest(range(len(spec))) AS i, unnest(spec) AS v FROM s)"
MEANS = "m AS (SELECT label, i, avg(v) AS v FROM l GROUP BY label, i)"
REFS = "r AS (SELECT label, list(v ORDER BY i) AS ref FROM m GROUP BY label)"
REFLECTANCE = ("s AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * 0.6 + 0.5) AS spec "
               "FROM embeddings)")
ANGLES = """
a AS (SELECT s.vec_id, s.label, r.label AS ref_label,
        acos(greatest(-1.0, least(1.0, list_dot_product(spec, ref)
             / (sqrt(list_dot_product(spec, spec)) * sqrt(list_dot_product(ref, ref)))))) AS angle
      FROM s CROSS JOIN r)"""
BEST = """
b AS (SELECT vec_id, label, ref_label AS pred, angle FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY angle, ref_label) AS rn FROM a) WHERE rn = 1)"""
SCORED = ", ".join([SPECTRA, LONG, MEANS, REFS]) + "," + ANGLES + "," + BEST
LOGITS = ", ".join([SPECTRA, LONG, MEANS, REFS]) + """,
z AS (SELECT s.vec_id, s.label, list(120.0 * list_dot_product(spec, ref) ORDER BY r.label) AS logits
      FROM s CROSS JOIN r GROUP BY s.vec_id, s.label)"""


def softmax_sql(z: str) -> str:
    e = f"list_transform({z}, lambda q: exp(q - list_max({z})))"
    return f"list_transform({e}, lambda q: q / list_sum({e}))"


PROBS = LOGITS + f""",
p AS (SELECT vec_id, label, logits, {softmax_sql('logits')} AS p FROM z)"""
SAM_PROBS = SCORED + f""",
t AS (SELECT vec_id, label, list(-5.0 * angle ORDER BY ref_label) AS z FROM a GROUP BY vec_id, label),
p AS (SELECT vec_id, label, {softmax_sql('z')} AS p FROM t)"""
EVENTS = "e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"
SHOTS = EVENTS + """,
w AS (SELECT event_id, user_id, event_type, ts, k / 100.0::DOUBLE AS ilm,
        list_transform(range(5), lambda j: exp(-abs(value / 40.0 - j::DOUBLE))) AS w FROM e),
sh AS (SELECT event_id, user_id, event_type, ts, ilm, list_transform(w, lambda x: x / list_sum(w)) AS p FROM w)"""
COUNTS = """
c AS (SELECT l_orderkey, l_linenumber, l_suppkey,
        list_transform(range(8), lambda i: (floor(l_extendedprice * (i + 1) / 25.0)::BIGINT % 4096)::DOUBLE) AS raw,
        list_transform(range(8), lambda i: 100.0::DOUBLE + l_quantity + i) AS dark,
        list_transform(range(8), lambda i: 3000.0::DOUBLE + l_quantity * 10.0 - i * 400.0) AS white,
        l_quantity AS exposure_ms, 15.0::DOUBLE + l_tax * 200.0 AS temp_c FROM lineitem)"""
FRACTIONS = """
n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
f AS (SELECT user_id AS sample_id, event_type AS endmember, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS fraction FROM n)"""
ENDMEMBERS = ", ".join([REFLECTANCE, LONG]) + f""",
em AS (SELECT {list(EVENT_TYPES)!r}[label % {len(EVENT_TYPES)} + 1] AS endmember, i, avg(v) AS v FROM l GROUP BY 1, 2)"""


def entropy_sql(p: str) -> str:
    return (f"-list_sum(list_transform({p}, lambda q: least(greatest(q, 1e-12), 1.0) "
            f"* ln(least(greatest(q, 1e-12), 1.0))))")


def argmax_sql(p: str) -> str:
    return f"(list_position({p}, list_max({p})) - 1)"


def status_sql(conf: str, ent: str, margin: str) -> str:
    return (f"CASE WHEN {conf} < 0.40 OR {ent} > 1.20 THEN 'likely_ood' WHEN {margin} < 0.15 THEN 'borderline' "
            f"WHEN {conf} < 0.70 THEN 'low_confidence' ELSE 'nominal' END")


def uncertainty_sql(p: str) -> str:
    """``class_index, confidence, entropy, margin`` of a list column."""
    return (f"{argmax_sql(p)} AS class_index, list_max({p}) AS confidence, {entropy_sql(p)} AS entropy, "
            f"list_reverse_sort({p})[1] - list_reverse_sort({p})[2] AS margin")
