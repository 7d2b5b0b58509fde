"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word (a run of letters, of digits or of other characters, letters in lower case) falls into one of
``ROWS`` slots by hash and has a fixed sparse random index vector. Its word vector is the sum of the index
vectors of its neighbours, up to two words to either side, and of its own, over every occurrence in the
whole corpus. A document is the mean of its words' normalised vectors. The network (one hidden layer,
numpy) is fitted on a bounded sample of labelled documents; a part of the sample that it does not see
sets the temperature of its probabilities.

The vectors are summed inside tasks and then over tasks by block of slots; what reaches the driver is
ROWS x (DIM + 1) numbers whatever the corpus.

Rows: a null text is empty; an empty text is the zero vector and is scored like any other. Null labels
and labels other than 0 and 1 are not learned from; without both classes every score is the share of
label 1 (0.5 without any labels). Repeated rows count as often as they stand; other columns are no input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import textbytes as tb
from .textbytes import U64
from .toxicity import held_out, sampled

ROWS, DIM, SPIKES, REACH = 1 << 14, 64, 4, 2
BLOCK_ROWS = 256
RUN_BYTES = 1 << 18

_KIND = np.full(256, 1, np.uint8)  # letters, with every byte beyond ASCII
_KIND[:128] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of every word."""
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    slots = (tb.range_hash(tb.prefix_sums(data, lower=True), starts, ends) & U64(ROWS - 1)).astype(np.int64)
    return slots, np.searchsorted(offsets, starts, "right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(ROWS, SPIKES) columns and signs of the index vectors."""
    h = tb.counter_hash(11, ROWS * SPIKES).reshape(ROWS, SPIKES)
    return (h % U64(DIM)).astype(np.int64), np.where(h >> U64(63), -1.0, 1.0)


def _accumulate(batches):
    """A task's sums, as compressed blocks of slots."""
    columns, signs = index_vectors()
    sums, counts = np.zeros(ROWS * DIM), np.zeros(ROWS)
    for batch in batches:
        for _, data, offsets in tb.text_runs([batch], RUN_BYTES):
            slots, rows = tokens(data, offsets)
            counts += np.bincount(slots, minlength=ROWS)
            for shift in range(REACH + 1):
                a, b = slots[:len(slots) - shift], slots[shift:]
                same = rows[:len(slots) - shift] == rows[shift:]
                pairs = ((a, b), (b, a)) if shift else ((a, b),)
                for word, context in pairs:
                    word, context = word[same], context[same]
                    for k in range(SPIKES):
                        sums += np.bincount(word * DIM + columns[context, k], signs[context, k], ROWS * DIM)
    squeeze = zstandard.ZstdCompressor(level=1)
    table = np.column_stack([sums.reshape(ROWS, DIM), counts]).astype(np.int64)
    if counts.any():
        parts = [squeeze.compress(table[i:i + BLOCK_ROWS].tobytes()) for i in range(0, ROWS, BLOCK_ROWS)]
        yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "sums"])


def _add_up(batches):
    """Blocks added up as they stream by; a task holds one sum for each block it was dealt."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zstandard.decompress(packed), np.int64)
            total[block] = total[block] + part if block in total else part
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([zstandard.compress(t.tobytes()) for t in total.values()], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(ROWS, DIM) normalised word vectors of the whole corpus; slots without words are zero."""
    parts = tb.text_rows(docs).mapInArrow(_accumulate, "block int, sums binary")
    # Tasks' blocks meet in salted groups first, so no task adds up the blocks of all others.
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    parts = parts.repartition("block", "salt").select("block", "sums").mapInArrow(_add_up, "block int, sums binary")
    rows = parts.repartition("block").mapInArrow(_add_up, "block int, sums binary").collect()
    table = np.zeros((ROWS, DIM + 1))
    for r in rows:
        table[r["block"] * BLOCK_ROWS:(r["block"] + 1) * BLOCK_ROWS] = np.frombuffer(zstandard.decompress(r["sums"]), np.int64).reshape(-1, DIM + 1)
    x = table[:, :DIM]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype(np.float32)


def _pooled_run(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    slots, rows = tokens(data, offsets)
    out, n = np.zeros((len(offsets) - 1, DIM)), np.bincount(rows, minlength=len(offsets) - 1)
    if len(slots):
        begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        cuts = np.unique(np.append(begin, np.arange(0, len(slots), 1 << 16)))  # long texts in parts
        at = np.append(cuts[1:], len(slots))
        for a, b in zip(cuts[::4_096], np.append(cuts[4_096::4_096], len(slots))):
            mine = cuts[(cuts >= a) & (cuts < b)]
            np.add.at(out, rows[mine], np.add.reduceat(vectors[slots[a:b]], mine - a, axis=0))
        out /= np.maximum(n, 1)[:, None]
    return out


def pooled(vectors: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """(rows, DIM) mean word vectors of a batch whose last column is the text."""
    parts = [_pooled_run(vectors, data, offsets) for _, data, offsets in tb.text_runs([batch], RUN_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, DIM))


@dataclass
class Network:
    """Standardised inputs, a hidden layer of tanh units, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    """A network that gives every document the same probability."""
    logit = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))
    return Network(np.zeros(DIM), np.ones(DIM), np.zeros((DIM, 1)), np.zeros(1), np.zeros(1), logit)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the log loss over four fifths of the rows; the rest chooses the epoch and the temperature."""
    rng = np.random.default_rng(5)
    order = rng.permutation(len(x))
    x, y = x[order], y[order].astype(float)
    held = max(1, len(x) // 5)
    xv, yv, xt, yt = x[:held], y[:held], x[held:], y[held:]
    net = Network(xt.mean(axis=0), xt.std(axis=0) + 1e-6, rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), np.zeros(hidden), 0.0)
    zt = (xt - net.mean) / net.scale
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (np.inf, None)
    loss = lambda z, t: float(np.mean(np.logaddexp(0, z) - t * z))
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(zt)), max(1, len(zt) // 256)):
            h = np.tanh(zt[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - yt[at]) / len(at)
            dh = np.outer(d, p[2]) * (1 - h * h)
            step += 1
            for i, g in enumerate((zt[at].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * m[i] / (1 - 0.9 ** step) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
        now = loss(net.logits(xv), yv)
        if now < best[0]:
            best = (now, [a.copy() for a in p])
    net.w1, net.b1, net.w2, net.b2 = best[1][0], best[1][1], best[1][2], float(best[1][3][0])
    z = net.logits(xv)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
    net.temperature = float(min(grid, key=lambda t: loss(z / t, yv)))
    return net


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, x): the pooled vector of every document, in single precision."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # ROWS x DIM floats, 4 MB

    def run(batches):
        for batch in batches:
            x = pooled(shared.value, batch).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * DIM, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.record_batch([batch.column(0), flat], ["doc_id", "x"])

    return tb.text_rows(docs, "doc_id").mapInArrow(run, "doc_id long, x array<float>")


def fit(pools: DataFrame, labels: DataFrame, sample: int = 20_000) -> Network:
    """Fit on about ``sample`` labelled documents (all, if fewer) that are not held out, by hash of their id."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    chosen = sampled(known, known.count(), sample, 5)
    rows = sorted(pools.join(chosen, "doc_id").select("doc_id", "y", "x").limit(2 * sample).collect(), key=lambda r: (r["doc_id"], r["y"], r["x"]))
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    return train(np.array([r["x"] for r in rows], float), y)


def score(pools: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score), a row per document."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM).astype(float)
            yield pa.record_batch([batch.column(0), pa.array(network.probability(x))], ["doc_id", "score"])

    return pools.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns."""
    vectors = word_vectors(docs)
    network = fit(materialise(document_vectors(docs, vectors), "vectors"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = pooled(shared.value, batch.select(["text"]))
            yield batch.filter(pa.array(network.probability(x.astype(np.float32).astype(float)) >= threshold))

    tb.text_rows(docs)  # sets the batch size
    return docs.mapInArrow(run, docs.schema)
