"""Queries over files, wire frames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import vectors as V
from ..operators import rules, scoring
from ..session import scratch_path
from ..sources import frames as WF
from ..sources import library as SL
from ..sources import measurements as SM
from ..sources import stores
from ..sources.lines import read_lines
from ..streaming import ingest
from . import inputs as I
from .inputs import EVENTS, SHOTS, fr, rd
from .q_evaluation import FUSED_MEAN_SQL
from .registry import query

WIDTHS = {"spec": 4, "as7": 3, "swir": 2, "led": 2}


# ---------------------------------------------------------------- rules


def _derived_measurements(spark, sf) -> DataFrame:
    """Events as small measurements, with faults chosen by the payload number."""
    k, v = F.col("k"), F.col("value") / 100.0
    case = k % 12
    nan = F.lit(float("nan"))
    return I.events(spark, sf).select(
        "event_id", F.when(case == 1, F.lit("")).otherwise(F.concat(F.lit("U"), "user_id")).alias("sample_id"),
        F.col("event_id").cast("string").alias("measurement_id"), F.col("ts").cast("string").alias("timestamp"),
        F.when(case == 2, F.col("event_type")).otherwise(F.lit("mixed")).alias("mineral_class"),
        F.when(case == 3, v + 1.5).otherwise(F.lit(0.5)).alias("ilmenite_fraction"),
        F.when(case == 4, F.lit(0)).otherwise(k + 1).alias("integration_time_ms"), F.lit(22.5).alias("ambient_temp_c"),
        F.when(case == 5, F.lit("dense")).otherwise(F.lit("loose")).alias("packing_density"),
        F.when(case == 6, F.lit("half")).otherwise(F.lit("full")).alias("sensor_mode"),
        F.when(case == 7, F.array(v, v, v)).when(case == 8, F.array(v, nan, v, v)).when(case == 9, F.lit(None))
        .otherwise(F.array(v, v, v, v)).alias("spec"),
        F.when(case == 10, F.array(v, v)).alias("as7"), F.lit(None).cast("array<double>").alias("swir"),
        F.array(v, v).alias("led"), F.when(case == 11, nan).otherwise(v).alias(schema.LIF))


@query("P8", "P7", sql=f"""WITH {EVENTS}, c AS (SELECT event_id, k % 12 AS c FROM e)
SELECT event_id, CASE c WHEN 1 THEN 'sample_id_empty' WHEN 2 THEN 'mineral_class' WHEN 3 THEN 'ilmenite_fraction'
 WHEN 4 THEN 'integration_time_ms' WHEN 5 THEN 'packing_density' WHEN 6 THEN 'sensor_mode' WHEN 7 THEN 'spec_width'
 WHEN 8 THEN 'spec_not_finite' WHEN 9 THEN 'spec_missing' WHEN 10 THEN 'as7_width' WHEN 11 THEN 'lif_not_finite' ELSE '' END AS violations FROM c""")
def measurement_violations(spark, sf):
    out = rules.check(_derived_measurements(spark, sf), rules.measurement_rules(WIDTHS))
    return out.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("P8", sql=f"""WITH {EVENTS} SELECT event_type, count(*) FILTER (k % 12 = 0) AS n_good, count(*) FILTER (k % 12 <> 0) AS n_bad FROM e GROUP BY 1""")
def good_and_quarantined(spark, sf):
    checked = rules.check(_derived_measurements(spark, sf), rules.measurement_rules(WIDTHS))
    types = I.table(spark, sf, "events").select("event_id", "event_type")
    good = rules.good(checked).select("event_id", F.lit(1).alias("g"))
    bad = rules.quarantined(checked).select("event_id", F.lit(0).alias("g"))
    return good.unionByName(bad).join(types, "event_id").groupBy("event_type").agg(
        F.count_if(F.col("g") == 1).alias("n_good"), F.count_if(F.col("g") == 0).alias("n_bad"))


@query("U3", sql="SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def unknown_event_types(spark, sf):
    return rules.unknown_values(I.table(spark, sf, "events"), "event_type", ("click", "view"))


# ---------------------------------------------------------------- files


@query("S1", "S2", "S3", sql=f"""WITH {I.REFLECTANCE}, x AS (SELECT vec_id, label % 3 AS md, [spec[i % 64 + 1] for i in range(288)] AS v, spec FROM s)
SELECT vec_id::VARCHAR AS measurement_id, ['full', 'multispectral', 'combined'][md + 1] AS sensor_mode,
 CASE WHEN md <> 1 THEN {rd('list_sum(v)', 4)} END AS spec_total,
 {rd('spec[64] * 0.95')} AS swir_940, {rd('list_avg(spec) * 0.4')} AS lif FROM x""")
def wide_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "wide")
    SM.write_measurements_csv(I.measurements(spark, sf), path)
    back = SM.read_measurements(spark, path)
    return back.select("measurement_id", "sensor_mode", I.rounded(V.total(F.col("spec")), 4).alias("spec_total"),
                       I.rounded(F.get("swir", F.lit(0))).alias("swir_940"), I.rounded(schema.LIF).alias("lif"))


@query("S2", sql=f"""WITH {I.REFLECTANCE} SELECT ['full', 'multispectral', 'combined'][label % 3 + 1] AS sensor_mode, count(*) AS n,
{rd('avg(list_avg(spec) * 0.4)')} AS mean_lif FROM s GROUP BY 1""")
def parquet_measurement_table(spark, sf):
    path = scratch_path(spark, "measurements")
    SM.write_measurements(I.measurements(spark, sf), path)
    return SM.read_measurement_table(spark, path).groupBy("sensor_mode").agg(
        F.count(F.lit(1)).alias("n"), I.rounded(F.avg(schema.LIF)).alias("mean_lif"))


@query("S11", sql=f"""WITH {I.REFLECTANCE}, x AS (SELECT vec_id, label, [spec[i % 64 + 1] for i in range(288)] AS v, spec FROM s)
SELECT label = 3 AS rejected, count(*) AS n, {rd("avg(CASE WHEN label <> 3 THEN list_sum(v) END)", 4)} AS spec_total,
{rd('avg(spec[1])')} AS first_led, {rd('avg(spec[2])')} AS last_led FROM x GROUP BY 1""")
def tolerant_upload(spark, sf):
    """Uploads with extra columns, LEDs out of order and one class with a broken value."""
    path = scratch_path(spark, "upload")
    r = I.reflectance(spark, sf)
    channels = [F.get("spec", F.lit(i % I.WIDTH)).cast("string").alias(c) for i, c in enumerate(schema.BLOCK["spec"].columns)]
    channels[5] = F.when(F.col("label") == 3, F.lit("n/a")).otherwise(channels[5]).alias("spec_005")
    r.select(F.get("spec", F.lit(1)).alias("led_940"), F.lit("note").alias("remark"), F.get("spec", F.lit(0)).alias("led_385"),
             F.lit(0.5).alias(schema.LIF), *channels).write.csv(path, header=True)
    up = SM.read_tolerant_csv(spark, path)
    return up.groupBy("rejected").agg(
        F.count(F.lit(1)).alias("n"), I.rounded(F.avg(F.when(~F.col("rejected"), V.total(F.col("spec")))), 4).alias("spec_total"),
        I.rounded(F.avg(F.get("led", F.lit(0)))).alias("first_led"), I.rounded(F.avg(F.get("led", F.lit(1)))).alias("last_led"))


_DOC_GRID = [float(x) for x in range(0, 31, 3)]


@query("S8", "J9", sql=f"""WITH {EVENTS},
p AS (SELECT event_type, k AS x, avg(value) / 500.0 AS y FROM e GROUP BY ALL),
seg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lag(x) OVER w AS x0 FROM p WINDOW w AS (PARTITION BY event_type ORDER BY x)),
g AS (SELECT unnest(range(11)) AS i, unnest({I.doubles(_DOC_GRID)}) AS nm)
SELECT event_type AS spectrum_id, i, {fr('least(greatest(CASE WHEN nm < x OR x2 IS NULL THEN y ELSE y + (y2 - y) * (nm - x) / (x2 - x) END, 0.0), 1.0)')} AS v
FROM seg JOIN g ON (nm >= x OR x0 IS NULL) AND (nm < x2 OR x2 IS NULL)""")
def ascii_library(spark, sf):
    """Curves written as folders of two-column text, with a broken one among them, read back on a grid."""
    path = scratch_path(spark, "library")
    points = I.events(spark, sf).groupBy("event_type", "k").agg((F.avg("value") / 500.0).alias("y"))
    text = points.select("event_type", F.concat_ws(" ", F.col("k").cast("string"), F.col("y").cast("string")).alias("line"))
    broken = text.select(F.lit("broken").alias("event_type"), F.concat("line", F.lit(" oops")).alias("line"))
    text.unionByName(broken).write.partitionBy("event_type").text(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "event_type=([^/]+)/", 1)
    return I.long(SL.read_ascii_library(spark, path, _DOC_GRID, name=folder), ["spectrum_id"], "spec", digits=I.FINE)


@query("S12", sql="SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def stored_report(spark, sf):
    path = scratch_path(spark, "report")
    table = I.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    stores.write_report({"by_type": table}, path)
    return spark.read.schema("event_type string, n bigint, mean double").json(f"{path}/by_type")


# ---------------------------------------------------------------- wire frames


def wire_lines(e: DataFrame, *also: str) -> DataFrame:
    """One JSON line per event; the payload number decides what is wrong with it."""
    case = F.col("k") % 12
    v = F.format_string("%.4f", F.col("value") / 100.0)

    def numbers(n):
        return F.concat(F.lit("["), F.concat_ws(",", *[v] * n), F.lit("]"))

    truth = F.concat(F.lit(',"_truth":{"mineral_class":"'), F.get(F.lit(list(schema.MINERAL_CLASSES)), F.col("k") % 6),
                     F.lit('","ilmenite_fraction":'), F.when(case == 7, F.lit("2")).otherwise(F.lit("0.5")), F.lit("}"))
    good = F.concat(
        F.lit('{"v":'), F.when(case == 3, F.lit("2")).otherwise(F.lit("1")),
        F.lit(',"integration_time_ms":'), F.when(case == 4, F.lit("0")).otherwise(F.lit("100")),
        F.lit(',"ambient_temp_c":22.5,"note":"x","spec":'), F.when(case == 5, numbers(3)).otherwise(numbers(4)),
        F.lit(',"led":'), numbers(2), F.lit(',"lif_450lp":'), F.when(case == 6, F.lit("NaN")).otherwise(v),
        F.when(case == 8, F.concat(F.lit(',"as7":'), numbers(2))).when(case == 9, F.concat(F.lit(',"as7":'), numbers(3))).otherwise(F.lit("")),
        F.when(case == 10, F.concat(F.lit(',"swir":'), numbers(3))).otherwise(F.lit("")),
        F.when(F.col("event_type").isin("click", "view", "error"), truth).otherwise(F.lit("")), F.lit("}"))
    line = F.when(case == 0, F.lit("   ")).when(case == 1, F.lit("{bad")).when(case == 2, F.lit("[1]")).otherwise(good)
    return e.select("event_id", F.col("user_id").cast("string").alias("session"), "event_type", "k", "value", line.alias("value_line"), *also).select(
        "event_id", "session", F.col("value_line").alias("value"), *also)


_REASON = """CASE k % 12 WHEN 1 THEN 'malformed' WHEN 2 THEN 'malformed' WHEN 3 THEN 'version' WHEN 4 THEN 'integration_time_ms'
 WHEN 5 THEN 'spec_width' WHEN 6 THEN 'lif_not_finite' WHEN 7 THEN CASE WHEN event_type IN ('click', 'view', 'error') THEN 'truth_fraction' ELSE '' END
 WHEN 8 THEN 'as7_width' WHEN 10 THEN 'swir_width' ELSE '' END"""
_FRAMES = f"""{EVENTS}, fr AS (SELECT event_id, user_id::VARCHAR AS session, event_type, k,
  round(value / 100.0, 4) AS lif, {_REASON} AS reason FROM e WHERE k % 12 <> 0)"""


def _checked(spark, sf):
    return WF.validate_lines(wire_lines(I.events(spark, sf)), widths=WIDTHS)


@query("S4", "P9", sql=f"WITH {_FRAMES} SELECT event_id, reason FROM fr")
def frame_violations(spark, sf):
    return _checked(spark, sf).select("event_id", F.array_join("violations", ",").alias("reason"))


@query("R2", sql=f"WITH {_FRAMES} SELECT reason, count(*) AS n FROM fr WHERE reason <> '' GROUP BY 1")
def quarantined_lines(spark, sf):
    return WF.quarantine(_checked(spark, sf)).groupBy("reason").agg(F.count("line").alias("n"))


def frame_scorer() -> scoring.ColumnScorer:
    """Six pseudo-logits around the fluorescence value: enough of a model for the ingest path."""
    lif = F.element_at("features", -1)
    logits = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: -F.abs(lif * 3.0 - j.cast("double")) * 2.0)
    return scoring.ColumnScorer(V.softmax(logits), lif / 10.0)


_HIT = "least(greatest(ceil(lif * 3.0 - 0.5), 0), 5)::BIGINT"
_COUNTERS = f"""SELECT session, count(*) AS received, count(*) FILTER (reason = '') AS valid, count(*) FILTER (reason <> '') AS malformed,
 count(*) FILTER (reason = '' AND event_type IN ('click', 'view', 'error') AND {_HIT} = k % 6) AS truth_matches,
 count(*) FILTER (reason = '' AND event_type IN ('click', 'view', 'error')) AS truth_total FROM fr GROUP BY session"""
_COUNTERS = f"""SELECT *, CASE WHEN truth_total > 0 THEN {fr('truth_matches / truth_total')} END AS accuracy FROM ({_COUNTERS})"""


def _predicted(checked: DataFrame) -> DataFrame:
    """All lines with the predicted class; features of invalid lines are not scored."""
    frame = F.when(F.size("violations") == 0, F.array(F.col(schema.LIF)))
    scored = scoring.score(checked.withColumn("features", F.coalesce(frame, F.array(F.lit(0.0)))), frame_scorer())
    return scored.withColumn("predicted", schema.class_name("class_index"))


@query("A20", "J10", sql=f"WITH {_FRAMES} {_COUNTERS}")
def session_counters(spark, sf):
    out = ingest.session_counters(_predicted(_checked(spark, sf)), "session", F.col("predicted"))
    return out.withColumn("accuracy", I.fine("accuracy"))


@query("R3", sql=f"""WITH {_FRAMES} SELECT session, count(*) AS received, count(*) FILTER (reason = '') AS valid,
count(*) FILTER (reason <> '') AS malformed, 0::BIGINT AS truth_matches, 0::BIGINT AS truth_total FROM fr GROUP BY session""")
def dry_run_counters(spark, sf):
    return ingest.session_counters(_checked(spark, sf), "session").drop("accuracy")


@query("P10", "S5", sql=f"""WITH {_FRAMES} SELECT session AS sample_id,
['ilmenite_rich', 'olivine_rich', 'pyroxene_rich', 'anorthositic', 'glass_agglutinate', 'mixed'][{_HIT} + 1] AS mineral_class,
CASE WHEN k % 12 = 9 THEN 'combined' ELSE 'full' END AS sensor_mode, count(*) AS n, {rd('sum(least(lif / 10.0, 1.0))')} AS total
FROM fr WHERE reason = '' GROUP BY ALL""")
def frames_to_measurements(spark, sf):
    scored = ingest.score_frames(WF.valid(_checked(spark, sf)), frame_scorer())
    rows = WF.to_measurement(scored, F.col("session"), F.lit("medium"), ["session", "event_id"])
    return rows.groupBy("sample_id", "mineral_class", "sensor_mode").agg(
        F.count(F.lit(1)).alias("n"), I.rounded(F.sum("ilmenite_fraction")).alias("total"))


# ---------------------------------------------------------------- streams


def event_stream(spark, sf) -> DataFrame:
    """The events table as a stream of files."""
    e = spark.readStream.schema(I.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    return e.withColumn("k", I.payload_number())


@query("R4", "A20", sql=f"WITH {_FRAMES} {_COUNTERS}")
def streaming_session_counters(spark, sf):
    path = scratch_path(spark, "counters")
    checked = WF.validate_lines(wire_lines(event_stream(spark, sf)), widths=WIDTHS)
    counters = ingest.session_counters(_predicted(checked), "session", F.col("predicted"))
    ingest.write_updates(counters, path, f"{path}-checkpoint").awaitTermination()
    return ingest.latest_updates(spark, path, ["session"]).withColumn("accuracy", I.fine("accuracy"))


@query("R5", sql=FUSED_MEAN_SQL)
def streaming_fused_shots(spark, sf):
    path = scratch_path(spark, "fusion")
    shots = I.shots(event_stream(spark, sf))
    ingest.write_updates(ingest.fused_sums(shots, 5, "user_id"), path, f"{path}-checkpoint").awaitTermination()
    out = ingest.finish_fusion(ingest.latest_updates(spark, path, ["user_id"]), 5, "user_id")
    return out.select("user_id", "class_index", *[I.fine(c).alias(c) for c in ("confidence", "entropy", "margin", "ilmenite_fraction")],
                      "status", "fused_n")


@query("R1", "R2", "S5", sql=f"WITH {_FRAMES} {_COUNTERS}")
def streaming_ingest(spark, sf):
    path = scratch_path(spark, "ingest")
    ingest.run_ingest(wire_lines(event_stream(spark, sf)), frame_scorer(), path, f"{path}-checkpoint",
                      identity=["session", "event_id"], widths=WIDTHS).awaitTermination()
    return ingest.total_counters(spark, path).withColumn("accuracy", I.fine("accuracy"))


IDLE = "6 hours"
#: Sessions of the twin: a new one begins where the gap to the line before is longer than the idle time.
_RUNS = """n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY ts)),
fr AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM n)"""


def _until_closed(spark, sf):
    """The event stream under a watermark, and a heartbeat after all of it that ends every session."""
    lines = event_stream(spark, sf)
    path = scratch_path(spark, "heartbeat")
    last = I.table(spark, sf, "events").agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    last.select(*[F.col(c) if c == "ts" else F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in lines.columns]).write.parquet(path)
    beat = spark.readStream.schema(lines.schema).parquet(path)
    return ingest.with_arrival(lines.unionByName(beat), "ts", "1 hour", "user_id")


_CLOSED = f"""{EVENTS}, fl AS (SELECT event_id, user_id::VARCHAR AS session, event_type, k, ts, round(value / 100.0, 4) AS lif, {_REASON} AS reason FROM e WHERE k % 12 <> 0),
{_RUNS.format(table='fl', key='session')}"""


@query("R4", "A20", sql=f"""WITH {_CLOSED} SELECT session, min(ts) AS started, max(ts) AS last_seen, count(*) AS received, count(*) FILTER (reason = '') AS valid,
 count(*) FILTER (reason <> '') AS malformed, count(*) FILTER (reason = '' AND event_type IN ('click', 'view', 'error') AND {_HIT} = k % 6) AS truth_matches,
 count(*) FILTER (reason = '' AND event_type IN ('click', 'view', 'error')) AS truth_total, 0::BIGINT AS state_rows FROM fr GROUP BY session, run""")
def closed_session_counters(spark, sf):
    """Sessions that end after six idle hours: emitted once, with nothing left in the state."""
    path = scratch_path(spark, "closed")
    lines = _until_closed(spark, sf)
    checked = WF.validate_lines(wire_lines(lines, "ts"), widths=WIDTHS)
    run = ingest.write_closed(ingest.closed_counters(_predicted(checked), "session", "ts", IDLE, F.col("predicted")), path, f"{path}-checkpoint")
    run.awaitTermination()
    times = {c: ingest.zoneless(c) for c in ("started", "last_seen")}
    return spark.read.parquet(path).drop("batch_id", "accuracy").withColumns(times).withColumn("state_rows", F.lit(ingest.state_rows(run)).cast("long"))


@query("R5", sql=f"""WITH {SHOTS}, {_RUNS.format(table='sh', key='user_id')}
SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS fused_n, {fr('avg(p[1])')} AS first_class, {fr('least(greatest(avg(ilm), 0.0), 1.0)')} AS ilmenite_fraction,
 0::BIGINT AS state_rows FROM fr GROUP BY user_id, run""")
def closed_fused_shots(spark, sf):
    """Shots of a sample fused until it has been idle for six hours."""
    path = scratch_path(spark, "closed")
    shots = I.shots(_until_closed(spark, sf))
    run = ingest.write_closed(ingest.closed_sums(shots, 5, "ts", IDLE, "user_id"), path, f"{path}-checkpoint")
    run.awaitTermination()
    n = F.col("fused_n")
    return spark.read.parquet(path).select(
        "user_id", *[ingest.zoneless(c).alias(c) for c in ("started", "last_seen")], "fused_n", I.fine(F.col("p0") / n).alias("first_class"),
        I.fine(V.clip(F.col("ilmenite_sum") / n, 0.0, 1.0)).alias("ilmenite_fraction"), F.lit(ingest.state_rows(run)).cast("long").alias("state_rows"))


@query("R3", sql=f"""WITH {_FRAMES} SELECT session, count(*) AS received, count(*) FILTER (reason = '') AS valid,
count(*) FILTER (reason <> '') AS malformed, 0::BIGINT AS truth_matches, 0::BIGINT AS truth_total FROM fr GROUP BY session""")
def dry_run_ingest(spark, sf):
    """A dry run of the ingest itself over the event stream: lines are validated and counted, nothing else is kept."""
    path = scratch_path(spark, "dry-run")
    ingest.run_ingest(wire_lines(event_stream(spark, sf)), None, path, f"{path}-checkpoint", widths=WIDTHS).awaitTermination()
    return ingest.total_counters(spark, path).drop("accuracy")


_REASONS = ["malformed", "version", "integration_time_ms", "ambient_temp_c", "spec_missing", "led_missing", "spec_width", "led_width",
            "swir_width", "as7_width", "spec_not_finite", "led_not_finite", "swir_not_finite", "as7_not_finite", "lif_not_finite",
            "truth_class", "truth_fraction"]


@query("R2", "R3", "A20", sql=f"""WITH {_FRAMES}, l AS (SELECT unnest(['received', 'valid', 'rejected', {', '.join(f"'{r}'" for r in _REASONS)}]) AS counter)
SELECT counter, (SELECT count(*) FILTER (CASE counter WHEN 'received' THEN true WHEN 'valid' THEN reason = '' WHEN 'rejected' THEN reason <> '' ELSE reason = counter END) FROM fr) AS observed,
 CASE WHEN counter NOT IN ('received', 'valid') THEN (SELECT count(*) FILTER (CASE counter WHEN 'rejected' THEN reason <> '' ELSE reason = counter END) FROM fr) END AS stored FROM l""")
def observed_line_counts(spark, sf):
    """Lines counted in the very pass that appends the rejected ones to a table, beside what that table holds."""
    path = scratch_path(spark, "observed")
    checked = WF.validate_lines(wire_lines(event_stream(spark, sf)), widths=WIDTHS)
    with ingest.observing(spark) as totals:
        counts = totals.finish(ingest.append(WF.quarantine(ingest.observed_lines(checked)), path, f"{path}-checkpoint"))
    why = spark.read.parquet(path).select(F.explode(F.split("reason", ",")).alias("counter"))
    stored = why.groupBy("counter").agg(F.count("*").alias("stored")).unionByName(
        spark.read.parquet(path).agg(F.count("*").alias("stored")).withColumn("counter", F.lit("rejected")))
    seen = spark.createDataFrame(sorted(counts.items()), "counter string, observed long").join(stored, "counter", "left")
    return seen.withColumn("stored", F.when(~F.col("counter").isin("received", "valid"), F.coalesce("stored", F.lit(0))))


@query("S4", "P10", "R1", "R2", sql=f"WITH {_FRAMES}, c AS ({_COUNTERS}) SELECT *, valid AS n_ids FROM c")
def ingest_of_line_files(spark, sf):
    """Frames written as text lines and ingested from there as a stream, in ranges of a megabyte. ``n_ids`` counts
    the measurement ids that a batch read of the same files, in other ranges, arrives at too."""
    folder, path = scratch_path(spark, "lines"), scratch_path(spark, "line-ingest")
    wired = wire_lines(I.events(spark, sf))
    wired.select(F.concat_ws("\t", F.col("session"), F.coalesce("value", F.lit("")))).write.text(folder)
    text = F.substring_index("line", "\t", 1)
    stream = read_lines(spark, folder, stream=True, range_bytes=1 << 20).select(
        "source", "offset", text.alias("session"), F.expr("substring(line, instr(line, '\t') + 1)").alias("value"))
    ingest.run_ingest(stream, frame_scorer(), path, f"{path}-checkpoint", widths=WIDTHS).awaitTermination()
    again = read_lines(spark, folder, range_bytes=100_000).select(
        F.sha2(F.concat_ws("|", "source", F.col("offset").cast("string")), 256).alias("measurement_id"))
    ids = (spark.read.parquet(f"{path}/measurements").join(again, "measurement_id", "left_semi")
           .groupBy(F.col("sample_id").alias("session")).agg(F.countDistinct("measurement_id").alias("n_ids")))
    out = ingest.total_counters(spark, path).withColumn("accuracy", I.fine("accuracy"))
    return out.join(ids, "session", "left").fillna(0, ["n_ids"])
