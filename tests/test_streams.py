import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel import schema
from spectrel.operators import fusion
from spectrel.plans.q_ingest import frame_scorer
from spectrel.session import scratch_path
from spectrel.sources import frames as WF
from spectrel.streaming import ingest


def frame(**kw):
    base = {"v": 1, "integration_time_ms": 100, "ambient_temp_c": 22.5, "spec": [.1] * 288, "led": [.5] * 12, "lif_450lp": .42}
    return json.dumps(base | kw)


LINES = {
    frame(): "", frame(as7=[.3] * 18, swir=[.4, .5]): "", frame(swir=[.4, .5]): "", frame(as7=[.3] * 18, extra=1): "",
    frame(_truth={"mineral_class": "olivine_rich", "ilmenite_fraction": .2}): "",
    frame(_truth={}): "", frame(_truth={"mineral_class": "mixed"}): "truth_fraction",
    "{bad": "malformed", "[1]": "malformed", frame(lif_450lp=float("nan")): "lif_not_finite", frame(v=2): "version",
    frame(swir=[.1] * 3): "swir_width", frame(as7=[.1] * 17): "as7_width", frame(integration_time_ms=0): "integration_time_ms",
    frame(_truth={"mineral_class": "mixed", "ilmenite_fraction": 2}): "truth_fraction", frame(spec=[.1] * 3): "spec_width",
    '{"v": 1}': "integration_time_ms,ambient_temp_c,spec_missing,led_missing,lif_not_finite",
}


def test_every_bad_line_is_quarantined_with_its_reason(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES, "", "   "]], "value string").repartition(4)
    checked = WF.validate_lines(df)
    got = {r["value"]: ",".join(r["violations"]) for r in checked.collect()}
    assert got == LINES
    assert WF.valid(checked).count() == 6 and WF.quarantine(checked).count() == len(LINES) - 6


def test_frames_become_measurements_with_stable_ids(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(LINES)], "value string, offset int")
    scored = ingest.score_frames(WF.valid(WF.validate_lines(df)), frame_scorer())
    make = lambda: WF.to_measurement(scored, F.lit("RUN"), F.lit("loose"), ["offset"])
    a, b = ({r["measurement_id"] for r in make().collect()} for _ in range(2))
    assert a == b and len(a) == 6
    assert make().columns == schema.MEASUREMENT.fieldNames()
    assert {r["sensor_mode"] for r in make().collect()} == {"full", "combined"}


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_ingest_restarts_where_it_stopped_and_equals_batch(spark, tmp_path):
    src, out, check = str(tmp_path / "in"), scratch_path(spark, "out"), scratch_path(spark, "check")
    lines = list(LINES) * 3 + [""]
    lines = [f"{i}\t{x}" for i, x in enumerate(lines)]
    write_lines(src, "a.txt", lines[:20])

    def run(scorer):
        s = spark.readStream.text(src).select(F.lit("RUN").alias("session"), F.substring_index("value", "\t", 1).alias("line"),
                                              F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))
        ingest.run_ingest(s, scorer, out, check, identity=["session", "line"], timestamp=F.lit("2024-01-01T00:00:00")).awaitTermination()

    run(frame_scorer())
    write_lines(src, "b.txt", lines[20:])
    run(frame_scorer())
    run(frame_scorer())
    total = ingest.total_counters(spark, out).first()
    assert (total["received"], total["valid"], total["malformed"]) == (51, 18, 33)
    assert total["truth_total"] == 3 and total["accuracy"] in (0.0, 1.0)
    stored = spark.read.parquet(f"{out}/measurements")
    assert stored.count() == stored.select("measurement_id").distinct().count() == 18  # equal frames keep apart
    assert spark.read.parquet(f"{out}/quarantine").count() == 33


def test_dry_run_only_counts(spark, tmp_path):
    src, out = str(tmp_path / "in"), scratch_path(spark, "dry")
    write_lines(src, "a.txt", list(LINES))
    s = spark.readStream.text(src).withColumn("session", F.lit("RUN"))
    ingest.run_ingest(s, None, out, scratch_path(spark, "check")).awaitTermination()
    row = ingest.total_counters(spark, out).first()
    assert row["received"] == 17 and row["truth_total"] == 0 and row["accuracy"] is None
    assert os.listdir(out) == ["counters"]


def test_append_and_running_fusion_over_several_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(3), 40)
    df = spark.createDataFrame([(f"s{i % 3}", a.tolist(), float(i) / 40) for i, a in enumerate(p)],
                               "sample_id string, probabilities array<double>, ilmenite_fraction double")
    src = str(tmp_path / "shots")
    df.repartition(5).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    path = scratch_path(spark, "sums")
    ingest.write_updates(ingest.fused_sums(stream(), 3), path, f"{path}-c").awaitTermination()
    got = {r["sample_id"]: r for r in ingest.finish_fusion(ingest.latest_updates(spark, path, ["sample_id"]), 3).collect()}
    for r in fusion.fuse(df, 3).collect():
        assert np.allclose(got[r["sample_id"]]["probabilities"], r["probabilities"]) and got[r["sample_id"]]["fused_n"] == r["fused_n"]
    before = sorted(map(str, ingest.latest_updates(spark, path, ["sample_id"]).collect()))
    for _ in range(2):
        ingest.compact_updates(spark, path, ["sample_id"])
        assert sorted(map(str, ingest.latest_updates(spark, path, ["sample_id"]).collect())) == before
    sink = scratch_path(spark, "sink")
    for _ in range(2):
        ingest.append(stream(), sink, f"{sink}-c", ["sample_id"]).awaitTermination()
    assert spark.read.parquet(sink).count() == 40


def test_ingest_asks_for_an_identity(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    s = spark.readStream.text(str(tmp_path / "in")).withColumn("session", F.lit("RUN"))
    with pytest.raises(ValueError, match="identity"):
        ingest.run_ingest(s, frame_scorer(), str(tmp_path / "o"), str(tmp_path / "c"))


def test_idle_sessions_end_once_and_leave_no_state(spark):
    src, out, check = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "check")
    kinds = "session string, ts timestamp_ntz, violations array<string>"

    def run(rows):
        rows = [(s, f"2024-01-01 {t}", [] if ok else ["version"]) for s, t, ok in rows]
        spark.createDataFrame(rows, "session string, ts string, violations array<string>").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
        lines = ingest.with_arrival(spark.readStream.schema(kinds).parquet(src), "ts", "5 minutes", "session")
        query = ingest.write_closed(ingest.closed_counters(lines, "session", "ts", "30 minutes"), out, check)
        query.awaitTermination()
        got = spark.read.parquet(out).select("session", ingest.zoneless("started").cast("string"), ingest.zoneless("last_seen").cast("string"), "received", "valid")
        return ingest.state_rows(query), sorted((r[0], r[1][11:], r[2][11:], *r[3:]) for r in got.collect())

    left, got = run([("a", "10:00:00", 1), ("a", "10:20:00", 0), ("b", "10:05:00", 1), ("a", "11:30:00", 1)])
    first = [("a", "10:00:00", "10:20:00", 2, 1), ("b", "10:05:00", "10:05:00", 1, 1)]
    assert (left, got) == (1, first)
    # A line before the watermark is late; one from a name that has ended starts anew.
    left, got = run([("b", "09:00:00", 1), ("b", "11:40:00", 1), (None, "11:41:00", 1)])
    assert (left, got) == (2, first)
    left, got = run([(None, "13:00:00", 1)])
    assert (left, got) == (0, sorted([*first, ("a", "11:30:00", "11:30:00", 1, 1), ("b", "11:40:00", "11:40:00", 1, 1)]))


def test_lines_are_counted_on_their_way_to_the_sink(spark):
    src, out, check = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "check")

    def run(lines, totals):
        spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.mode("append").parquet(src)
        checked = WF.validate_lines(spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(src))
        return totals.finish(ingest.append(WF.quarantine(ingest.observed_lines(checked)), out, check))

    with ingest.observing(spark) as totals:
        got = run([*LINES, ""], totals)
        assert (got["received"], got["valid"], got["rejected"]) == (17, 6, 11)
        for reason in WF.reasons():
            assert got[reason] == sum(reason in why.split(",") for why in LINES.values()), reason
        # The query goes on from its checkpoint: what it has counted before is not counted again.
        assert run(list(LINES)[:1], totals)["received"] == 18
    with ingest.observing(spark) as totals:
        assert run(["{bad"], totals) == dict.fromkeys(got, 0) | {"received": 1, "rejected": 1, "malformed": 1}
    assert spark.read.parquet(out).count() == 12


def test_a_batch_run_again_replaces_its_counts():
    totals = ingest.ObservedTotals()
    for batch, n in ((0, 5), (1, 7), (1, 7), (2, 1)):
        totals.add("q", batch, {"received": n})
    totals.add("other", 0, {"received": 2})
    assert totals.counts() == {"received": 15}
