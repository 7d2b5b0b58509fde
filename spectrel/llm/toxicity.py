"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibrated thresholds.

The dictionaries are trained on bounded samples of labelled texts. Both begin with the pieces that most
ordinary texts share. The toxic one ends in the pieces (beginnings of words, 4 to 13 bytes) that toxic
texts hold significantly more often; the ordinary one ends in the same pieces, each as far as ordinary
texts go along with it, and inert bytes in the rest. So a window that is ordinary compresses alike with
both, and one that is toxic is shorter with the toxic dictionary by a few bytes.

A window is a word (or 64 bytes of a longer run) between a fixed lead-in, without which so short an input
would be stored uncompressed, and a fixed end. A text's features are its numbers of windows by length difference; a
logistic model, fitted on sampled texts that no dictionary was trained on and weighted back to the share
of each class, turns them into a probability.

Rows: a null text is empty; an empty text has no windows and is scored like any other. Null labels and
labels other than 0 and 1 are not learned from. With no toxic or no ordinary text to learn from, also where
copies that count once leave none, every score is the share of label 1 (0.5 without any labels). Other columns are no input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import textbytes as tb

LEVELS = 10
LONGEST = 64
CACHE = 1 << 17
TAIL = bytes(range(1, 13))  # zstandard looks for no match in the last bytes of its input
SHORT, LONG = 2, 13  # bytes of a piece, its leading blank included


@dataclass
class Model:
    """Dictionaries and the calibrated thresholds on window differences."""

    toxic: bytes = b""
    ordinary: bytes = b""
    lead: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(LEVELS + 1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(LEVELS + 1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(LEVELS + 1))
    bias: float = 0.0

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i:i + LONGEST] for w in words for i in range(0, max(1, len(w) - LONG), LONGEST - LONG)]


class Distance:
    """How many bytes shorter a window is with the toxic dictionary; remembered for ``CACHE`` windows."""

    def __init__(self, model: Model):
        make = lambda content: zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            compression_params=zstandard.ZstdCompressionParameters(
                window_log=16, chain_log=13, hash_log=14, search_log=5, min_match=4, target_length=64,
                strategy=zstandard.STRATEGY_LAZY2, write_content_size=False))
        self.toxic, self.ordinary, self.lead = make(model.toxic).compress, make(model.ordinary).compress, model.lead
        self.cache: dict[bytes, int] = {}

    def of(self, window: bytes) -> int:
        d = self.cache.get(window)
        if d is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            s = self.lead + b" " + window + b" " + TAIL
            d = self.cache[window] = min(LEVELS, max(0, len(self.ordinary(s)) - len(self.toxic(s))))
        return d

    def features(self, text: bytes) -> np.ndarray:
        """log(1 + windows that differ by at least 1, 2, ... bytes), log(1 + windows)."""
        found = np.bincount(np.fromiter(map(self.of, w := windows(text)), np.int64, len(w)), minlength=LEVELS + 1)
        return np.log1p(np.append(np.cumsum(found[::-1])[::-1][1:], len(w)))


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled(rows: DataFrame, count: int, sample: int, salt: int) -> DataFrame:
    """About ``sample`` of ``count`` rows, those whose doc_id has a low hash: nothing is sorted or gathered for it."""
    if count <= sample:
        return rows
    low = int(sample / count * (1 << 32))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 32)) < low)


def _pieces(batches):
    """(piece, toxic texts, ordinary texts) of a task's share, flushed when the table is large."""

    def flush(counts):
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array([c[1] for c in counts.values()], pa.int64()),
                                pa.array([c[0] for c in counts.values()], pa.int64())], ["piece", "toxic", "ordinary"])

    counts: dict[bytes, list[int]] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set()
            for w in set(windows((text or "").encode())):
                w = b" " + w
                own.update(w[:n] for n in range(SHORT, min(len(w), LONG) + 1))
            for p in own:
                counts.setdefault(p, [0, 0])[label] += 1
            if len(counts) > 400_000:
                yield flush(counts)
                counts = {}
    if counts:
        yield flush(counts)


def _sketches(text: str | None) -> tuple[int, int]:
    """Two min-hashes of the five-word shingles; near copies share at least one of them almost always."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = tb.words(data, np.array([0, len(data)]))
    if not len(starts):
        return 0, 0
    h = tb.range_hash(tb.prefix_sums(data, lower=True), starts, ends)
    n = max(1, len(h) - 4)
    mix = tb.mixed(sum(tb.mixed(h[i:i + n] + np.uint64(i)) for i in range(min(5, len(h)))))
    return int(mix.view(np.int64).min()), int(tb.mixed(mix).view(np.int64).min())


def _with_sketches(batches):
    for batch in batches:
        found = [_sketches(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                              [*batch.schema.names, "m1", "m2"])


def _measured(model: Model):
    def run(batches):
        distance = Distance(model)
        for batch in batches:
            x = [distance.features((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([r.tolist() for r in x], pa.list_(pa.float64()))], ["label", "x"])

    return run


def dictionaries(pieces: DataFrame, toxic: int, ordinary: int, least: int = 3, z: float = 4.0, most: int = 4_096, common: int = 1_500) -> Model:
    """Dictionaries from counts of sampled texts: at most ``most`` toxic and ``common`` ordinary pieces."""
    a, b = F.col("toxic") / toxic, F.col("ordinary") / ordinary
    share = (F.col("toxic") + F.col("ordinary")) / (toxic + ordinary)
    score = (a - b) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / ordinary) + 1e-12)
    ranked = pieces.where((F.col("toxic") >= least) & (F.octet_length("piece") >= 4)).withColumn("z", score).where(F.col("z") >= z)
    found = {bytes(r["piece"]): r["z"] for r in ranked.orderBy(F.desc("z"), "piece").limit(most).collect()}
    inner = {w[:n] for w in found for n in range(SHORT, len(w))}
    kept = sorted((w for w in found if w not in inner), key=lambda w: (found[w], w))
    starts = sorted({w[:n] for w in kept for n in range(SHORT, len(w) + 1)})
    spark = pieces.sparkSession
    known = spark.createDataFrame([(bytearray(s),) for s in starts], "piece binary")
    usual = {bytes(r["piece"]) for r in pieces.join(known, "piece").where(b >= 0.5 * a).collect()} if starts else set()
    rows = pieces.where(F.octet_length("piece") >= 4).orderBy(F.desc("ordinary"), "piece").limit(common).collect()
    base = b"".join(bytes(r["piece"]) for r in rows[::-1])
    ending, other = b"".join(kept), b""
    for w in kept:
        n = max([1, *(n for n in range(SHORT, len(w) + 1) if w[:n] in usual)])
        at = len(other)
        other += w[:n] + bytes(128 + (i * 37) % 61 for i in range(at + n, at + len(w)))
    end = bytes(range(240, 256))  # the last bytes of a dictionary are never matched either
    return Model(base + ending + end, base + other + end, base[-60:])


def constant(counts: dict[int, int]) -> Model:
    """Every score is the share of label 1."""
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    return Model(b"a" * 64, b"a" * 64, b"a" * 60, bias=float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3_000) -> Model:
    """Learn from about ``sample`` labelled texts of each class (all, if fewer), none of them held out.

    Near copies in the sample count once. Two thirds of the rest (by hash of the id) train the
    dictionaries, one third calibrates.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return constant(counts)
    chosen = sampled(known.where("label = 0"), counts[0], sample, 3).unionByName(sampled(known.where("label = 1"), counts[1], sample, 3))
    # About 2 x sample rows of 12 bytes are broadcast: an id is there once a label, and goes by its hash.
    rows = tb.text_rows(docs, "doc_id").join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(3)))
    rows = materialise(rows.select("doc_id", "label", "part", "text").mapInArrow(
        _with_sketches, "doc_id long, label int, part long, text string, m1 long, m2 long"), "sample")
    # Copies of one text would make its every word look like a mark of its class.
    for m in ("m1", "m2"):
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(m, "label").orderBy("doc_id", "text"))).where("nth = 1").drop("nth")
    rows = materialise(rows.select("label", "part", "text"), "sample")
    train = rows.where("part > 0")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return constant(counts)
    pieces = train.select("label", "text").mapInArrow(_pieces, "piece binary, toxic long, ordinary long").groupBy("piece").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    model = dictionaries(materialise(pieces.where("toxic + ordinary >= 3"), "pieces"), sizes[1], sizes[0])
    measured = rows.where("part = 0").select("label", "text").mapInArrow(_measured(model), "label int, x array<double>").collect()
    x, y = np.array([r["x"] for r in measured]).reshape(-1, LEVELS + 1), np.array([r["label"] for r in measured])
    if len(set(y.tolist())) < 2:
        return constant(counts)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.weights, model.bias = _logistic((x - model.mean) / model.scale, y, weight / weight.sum())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps of a weighted logistic regression; the ridge fades with the number of rows."""
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = 0.2 * np.eye(len(w)) / len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (weight * (p - y)) + penalty @ w
        curve = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + penalty
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), a row per document."""

    def run(batches):
        distance = Distance(model)
        for batch in batches:
            x = np.array([distance.features((t or "").encode()) for t in batch.column(1).to_pylist()]).reshape(-1, LEVELS + 1)
            yield pa.record_batch([batch.column(0), pa.array(model.probability(x))], ["doc_id", "score"])

    return tb.text_rows(docs, "doc_id").mapInArrow(run, "doc_id long, score double")
