"""Live ingest of wire frames."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import features as FX
from ..functions import vectors as V
from ..functions.uncertainty import Thresholds, with_uncertainty
from ..operators import scoring
from ..sources import frames as WF


def score_frames(valid: DataFrame, scorer: scoring.Scorer) -> DataFrame:
    """Features, scores and uncertainty of valid frames. Works on streams and tables alike."""
    return scoring.score(valid.withColumn("features", FX.frame_vector()), scorer).drop("features")


def session_counters(checked: DataFrame, session: str, predicted: Column | None = None, also: tuple[Column, ...] = ()) -> DataFrame:
    """Received, valid and malformed frames and truth matches of each session.

    ``checked`` holds all non-blank lines with their violations; ``predicted`` is the predicted
    class name (omit it for a dry run), ``also`` further keys.
    """
    ok = F.size("violations") == 0
    truth = F.col("_truth.mineral_class")
    judged = ok & truth.isNotNull() if predicted is not None else F.lit(False)
    hit = judged & (predicted == truth) if predicted is not None else F.lit(False)
    return checked.groupBy(session, *also).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("malformed"),
        F.count_if(hit).alias("truth_matches"), F.count_if(judged).alias("truth_total"),
    ).withColumn("accuracy", F.when(F.col("truth_total") > 0, F.col("truth_matches") / F.col("truth_total")))


def fused_sums(scored: DataFrame, n_classes: int, sample: str = "sample_id", p: str = "probabilities",
               ilmenite: str = "ilmenite_fraction", also: tuple[Column, ...] = ()) -> DataFrame:
    """Running per-sample sums whose ratio is the fused prediction: state is one row a sample."""
    return scored.groupBy(sample, *also).agg(
        *[F.sum(F.get(p, F.lit(k))).alias(f"p{k}") for k in range(n_classes)],
        F.sum(ilmenite).alias("ilmenite_sum"), F.count(p).alias("fused_n"))


def finish_fusion(sums: DataFrame, n_classes: int, sample: str = "sample_id", t: Thresholds = Thresholds()) -> DataFrame:
    n = F.col("fused_n")
    fused = sums.select(
        sample, F.array(*[F.col(f"p{k}") / n for k in range(n_classes)]).alias("probabilities"),
        V.clip(F.col("ilmenite_sum") / n, 0.0, 1.0).alias("ilmenite_fraction"), "fused_n")
    return with_uncertainty(fused, "probabilities", t)


EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def zoneless(moment: str) -> Column:
    """A moment as the zone-less time it has in UTC, whatever the session's zone."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({moment}), {EPOCH})")


def with_arrival(lines: DataFrame, arrival: str, delay: str, session: str) -> DataFrame:
    """Lines under a watermark on their arrival time; lines without a session only move the watermark.

    Such heartbeats end what is idle although nothing else arrives. The test is one expression that names the
    arrival time: of two, the one on the session would be pushed below the watermark, which heartbeats then never reach. Zone-less times, which a watermark does not take, are read as UTC;
    :func:`zoneless` turns results back.
    """
    if isinstance(lines.schema[arrival].dataType, T.TimestampNTZType):
        lines = lines.withColumn(arrival, F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {arrival})")))
    return lines.withWatermark(arrival, delay).where(F.least(F.col(session).isNotNull(), F.col(arrival).isNotNull()))


def closed_counters(checked: DataFrame, session: str, arrival: str, idle: str, predicted: Column | None = None) -> DataFrame:
    """Counters of each session that ends: a run of lines without a gap of ``idle``.

    A session is emitted once, when the watermark has passed its end, and its state is dropped; a session name that
    comes back later is a session of its own. ``checked`` has a watermark (:func:`with_arrival`).
    """
    found = session_counters(checked, session, predicted, (F.session_window(arrival, idle).alias("_ran"),))
    return found.withColumns(_span(idle)).drop("_ran")


def _span(idle: str) -> dict[str, Column]:
    return {"started": F.col("_ran.start"), "last_seen": F.col("_ran.end") - F.expr(f"INTERVAL {idle}")}


def closed_sums(scored: DataFrame, n_classes: int, arrival: str, idle: str, sample: str = "sample_id") -> DataFrame:
    """Per-sample sums as :func:`fused_sums`, emitted and dropped once a sample has been idle."""
    found = fused_sums(scored, n_classes, sample, also=(F.session_window(arrival, idle).alias("_ran"),))
    return found.withColumns(_span(idle)).drop("_ran")


def state_rows(query: StreamingQuery) -> int:
    """Rows of state that a finished query has left behind."""
    last = query.lastProgress
    return sum(o["numRowsTotal"] for o in last["stateOperators"]) if last else 0


def write_closed(aggregate: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stream rows that are final, one folder per micro-batch; a replayed batch overwrites its own."""
    return write_updates(aggregate, path, checkpoint, trigger, "append")


def write_updates(aggregate: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "update") -> StreamingQuery:
    """Stream an aggregate's changed rows, one folder per micro-batch.

    A replayed batch overwrites its own folder, so restarts add nothing twice. Read the current
    state with :func:`latest_updates`.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (aggregate.writeStream.outputMode(mode).foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest state of every key: the compacted state, if any, and the batches after it."""
    return _newest(spark, path, keys).drop("batch_id")


def _newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    updates = _since_base(spark, path)
    values = [c for c in updates.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "batch_id")
    return updates.groupBy(*keys).agg(newest.alias("_s")).select(*keys, "_s.*")


def _since_base(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the compacted table and of the batch folders it does not cover."""
    updates = spark.read.parquet(path)
    try:
        base = spark.read.parquet(f"{path}-base")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return updates
    upto = base.agg(F.max("upto")).first()[0]
    return updates.where(F.col("batch_id") > upto).unionByName(base.where(F.col("upto") == upto).drop("upto"))


def compact_updates(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Fold the batch folders so far, but for the last one (which a restart may write again), into one
    table, so that reading the state costs the state and the batches since. Folded folders may be removed."""
    last = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    state = _since_base(spark, path).where(F.col("batch_id") < last)
    values = [c for c in state.columns if c not in keys]
    newest = state.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_s")).select(*keys, "_s.*")
    newest.write.mode("overwrite").parquet(f"{path}-base/upto={last - 1}")


def append(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None,
           trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to parquet; the checkpoint and the sink's commit log make it exactly-once."""
    writer = (df.writeStream.format("parquet").outputMode("append").option("path", path)
              .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})))
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def run_ingest(lines: DataFrame, scorer: scoring.Scorer | None, out: str, checkpoint: str, session: str = "session",
               identity: list[str] | None = None, packing_density: Column | None = None,
               timestamp: Column | None = None, trigger: dict | None = None,
               widths: dict[str, int] | None = None) -> StreamingQuery:
    """Ingest a stream of lines into ``measurements``, ``quarantine`` and ``counters`` under ``out``.

    Each micro-batch is parsed and scored once and writes its own folders, which a replay
    overwrites; counters are per-batch sums, added up by :func:`total_counters`. Without a
    scorer this is a dry run: frames are validated and counted, nothing else is kept.

    ``identity`` names the columns that tell a line from every other, equal ones included (source and
    offset); a Kafka stream and :func:`~spectrel.sources.lines.read_lines` have them by themselves, any other must say.
    """
    known = [c for c in (["topic", "partition", "offset"], ["source", "offset"]) if set(c) <= set(lines.columns)]
    ids = identity or (known[0] if known else None)
    if ids is None and scorer is not None:
        raise ValueError("identity: name the columns that hold a line's source and offset")
    packing = F.lit("medium") if packing_density is None else packing_density

    def save(batch: DataFrame, batch_id: int) -> None:
        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")

        checked = WF.validate_lines(batch, widths=widths)
        if scorer is None:
            put(session_counters(checked, session), "counters")
            return
        checked = checked.persist()
        scored = score_frames(WF.valid(checked), scorer)
        rows = WF.to_measurement(scored, F.col(session), packing, ids, timestamp, keep=["_truth"])
        bad = WF.quarantine(checked, keep=[session])
        for df, name in ((rows, "measurements"), (bad, "quarantine")):
            put(df, name)
        checked.unpersist()
        # Counted on a few columns of what was stored: neither the lines nor the model are gone through again.
        stored = {name: batch.sparkSession.read.schema(df.schema).parquet(f"{out}/{name}/batch_id={batch_id}")
                  for df, name in ((rows, "measurements"), (bad, "quarantine"))}
        kind = batch.schema[session].dataType
        put(stored_counters(stored["measurements"].withColumn(session, F.col("sample_id").cast(kind)), stored["quarantine"], session), "counters")

    return (lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stored_counters(measured: DataFrame, rejected: DataFrame, session: str) -> DataFrame:
    """Counters of each session from stored measurements (with their ``_truth``) and stored rejected lines."""
    truth = F.col("_truth.mineral_class")
    lines = measured.select(session, F.lit(True).alias("ok"), truth.isNotNull().alias("judged"), (truth == F.col("mineral_class")).alias("hit")).unionByName(
        rejected.select(session, F.lit(False).alias("ok"), F.lit(False).alias("judged"), F.lit(False).alias("hit")))
    return lines.groupBy(session).agg(
        F.count(F.lit(1)).alias("received"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("malformed"),
        F.count_if("hit").alias("truth_matches"), F.count_if("judged").alias("truth_total"))


def observed_lines(checked: DataFrame, name: str = "lines") -> DataFrame:
    """``checked`` as it is, with its lines counted on the way to whatever sink follows.

    ``received``, ``valid``, ``rejected`` and every reason reach the driver as one row a micro-batch, whatever the
    number of lines and sessions; a line that breaks several rules counts for each. :class:`ObservedTotals` adds them up.
    The counts are those of the sink's own pass, so nothing between here and the sink may read the lines twice.
    """
    ok = F.size("violations") == 0
    return checked.observe(
        name, F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"),
        *[F.count_if(F.array_contains("violations", r)).alias(r) for r in WF.reasons()])


class ObservedTotals(StreamingQueryListener):
    """Adds up what a stream observes under ``name``, micro-batch by micro-batch, while it runs.

    A micro-batch that is run again (after a failure) replaces its own counts, so only the last one of each query is
    kept apart from the sums. A new listener starts at zero, also when its query goes on from a checkpoint.
    """

    def __init__(self, name: str = "lines"):
        self.name = name
        self._before: dict[str, dict[str, int]] = {}
        self._last: dict[str, tuple[int, dict[str, int]]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.add(str(event.progress.id), event.progress.batchId, seen.asDict())

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def _end(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def add(self, query_id: str, batch_id: int, counts: dict[str, int]) -> None:
        with self._lock:
            last, kept = self._last.get(query_id, (batch_id, {}))
            if batch_id > last:
                before = self._before.setdefault(query_id, {})
                for c, n in kept.items():
                    before[c] = before.get(c, 0) + n
            self._last[query_id] = (batch_id, counts)

    def counts(self) -> dict[str, int]:
        """Totals so far, over all queries listened to."""
        with self._lock:
            out: dict[str, int] = {}
            for part in [*self._before.values(), *(kept for _, kept in self._last.values())]:
                for c, n in part.items():
                    out[c] = out.get(c, 0) + n
            return out

    def finish(self, query: StreamingQuery, seconds: float = 60.0) -> dict[str, int]:
        """Wait for the query to end and for its last progress to arrive; the totals then."""
        query.awaitTermination()
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError("the end of the query was not reported")
        return self.counts()


@contextmanager
def observing(spark: SparkSession, name: str = "lines") -> Iterator[ObservedTotals]:
    """Listen to the session's streams for the length of a block."""
    totals = ObservedTotals(name)
    spark.streams.addListener(totals)
    try:
        yield totals
    finally:
        spark.streams.removeListener(totals)


def total_counters(spark: SparkSession, out: str, session: str = "session") -> DataFrame:
    """Session totals over all micro-batches of :func:`run_ingest`."""
    names = ("received", "valid", "malformed", "truth_matches", "truth_total")
    sums = spark.read.parquet(f"{out}/counters").groupBy(session).agg(*[F.sum(c).alias(c) for c in names])
    return sums.withColumn("accuracy", F.when(F.col("truth_total") > 0, F.col("truth_matches") / F.col("truth_total")))
