"""Mixing sources to target weights by cube-method balanced sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``budget`` times
all words; no target passes ``cap`` times its source's size, the excess is shared again by weight. A
document is taken floor(target / source size) times, and once more with the fraction left as inclusion
probability. The cube method draws these: three documents at a time move along the null space of the
balancing constraints (words and documents of the source) until one probability becomes 0 or 1, so both
totals stay exact. Blocks of a source fly apart, at most two documents of each are left over and fly
again together, level by level. Ten documents of each source stay behind and land with the last two: all
ways to settle these few are compared.

The number of sources is taken to fit one task (their weights depend on their place in the whole
order); everything about documents is distributed, and a large source spreads over its blocks.
Draws depend on the documents alone, so reruns agree. Rows: a null text has no words; a source without
words has target 0, and so has each of its documents; equal rows are exchangeable; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import textbytes as tb
from .merkle import numbered

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 8_192
RESERVE = 10


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of every text."""

    def run(batches):
        for rows, data, offsets in tb.text_runs(batches):
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(tb.word_counts(data, offsets))], ["doc_id", "source", "size"])

    return tb.text_rows(docs, "doc_id", "source").mapInArrow(run, "doc_id long, source string, size long")


def targets(rows: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n, target): water-filling, solved by ordering sources by cap over weight."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    # With the first k sources at their caps, the rest share what remains; the level is right for the
    # first k at which the next source stays under its cap; capping more than that lowers it.
    level = (budget * F.sum("source_size").over(total) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    s = s.withColumn("water", F.max(fits).over(total))
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least("most", F.col("water") * F.col("weight")))
    return s.select("source", "source_size", "n", target.alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities moved to 0 or 1, at most two left between; sums of ``pi`` and ``pi * size`` stay."""
    p, scale = pi.astype(float).copy(), max(1.0, float(size.max(initial=1)))
    s = (size / scale).tolist()
    draws = (tb.counter_hash(seed, len(p)) >> np.uint64(11)).astype(float) / float(1 << 53)
    values, active, tiny = p.tolist(), [], 1e-12
    order = np.flatnonzero((p > tiny) & (p < 1 - tiny)).tolist()
    for k in order:
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if max(map(abs, u)) < 1e-15:
                u = (1.0, -1.0, 0.0)
            up = min(((1 - values[i]) / x if x > 0 else -values[i] / x) for i, x in zip(active, u) if x)
            down = min((values[i] / x if x > 0 else (values[i] - 1) / x) for i, x in zip(active, u) if x)
            step = up if draws[k] * (up + down) < down else -down
            for i, x in zip(active, u):
                v = values[i] + step * x
                values[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            active = [i for i in active if 0 < values[i] < 1]
    return np.array(values)


def landed(size: np.ndarray, pi: np.ndarray, seed: int) -> np.ndarray:
    """A flight that keeps ``RESERVE`` documents back, and the landing: of all ways to settle these and
    the two left over, the one whose words, then documents, stay nearest to their totals."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    held = open_[-RESERVE:]
    out = pi.copy()
    out[held] = 0
    out = flight(size, out, seed)
    left = np.append(np.flatnonzero((out > 0) & (out < 1)), held)
    out[held] = pi[held]
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    words = np.abs(ways @ size[left] - size[left] @ out[left])
    number = np.abs(ways.sum(axis=1) - out[left].sum())
    out[left] = ways[np.lexsort((number, np.round(words)))[0]]
    return out


SCHEMA = "doc_id long, source string, size long, source_size long, target double, n long, unit long, base long, pi double"


def _fly(land: bool):
    def run(group: pa.Table) -> pa.Table:
        unit = group["unit"].to_numpy().view(np.uint64)
        order = np.lexsort((group["size"].to_numpy(), unit))
        group = group.take(pa.array(order)).drop_columns(["block"])
        # The seed comes from the units, so a rerun and a larger cluster draw alike.
        seed = int(tb.mixed(unit).sum(dtype=np.uint64)) % (1 << 63)
        pi = (landed if land else flight)(group["size"].to_numpy(), group["pi"].to_numpy(), seed)
        return group.set_column(group.schema.get_field_index("pi"), "pi", pa.array(pi))

    return run


def mix(docs: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row per document: how often the mix takes it."""
    # Rows of one id and size are told apart by their place in the source's order: no block holds them all.
    named = sizes(docs).withColumn("tree", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    rows = materialise(numbered(named, ["tree"], ["doc_id", "size"], "sizes").drop("tree", "n"), "sizes")
    goals = materialise(targets(rows, budget, cap, weights), "targets")
    most = goals.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    same = rows["source"].eqNullSafe(goals["source"])
    units = rows.join(goals, same).select(
        "doc_id", rows["source"], "size", "source_size", "target", "n", F.xxhash64("doc_id", "size", "slot").alias("unit"),
        F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("pi"))
    settled, flying, left = [], units, most
    while True:
        land = left <= block
        blocks = F.ceil(F.col("n") * (left / max(most, 1)) / block).cast("long")
        salt = F.pmod(F.xxhash64("unit", F.lit(int(left))), F.greatest(blocks, F.lit(1)))
        flying = materialise(flying.withColumn("block", salt).groupBy("source", "block").applyInArrow(_fly(land), SCHEMA), "flown")
        done = F.col("pi").isin(0.0, 1.0)
        settled.append(flying.where(done))
        if land:
            break
        flying = flying.where(~done)
        left = 2 * math.ceil(left / block)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("pi")).cast("long").alias("copies"))


def take(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: every document as often as :func:`mix` says, with the columns of ``docs``.

    Rows that share id, source and size are exchangeable. Where several do, they are numbered by a range sort, as
    their places in the mix are, so that no task holds all of them.
    """
    word = lambda c, kind="string": F.coalesce(F.col(c).cast(kind).cast("string"), F.lit("\0"))
    named = lambda size: [word("doc_id", "long").alias("__id"), word("source").alias("__source"), size.alias("__size")]
    key = ["__id", "__source", "__size"]
    words = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), *named(words.cast("long")))
    counted = materialise(mix(docs, **parameters).select(*named(F.col("size")), "copies"), "mixed")
    alike = counted.groupBy(*key).agg(F.count("*").alias("rows"), F.max("copies").alias("copies"))
    once = rows.join(alike.where("rows = 1 AND copies > 0").drop("rows"), key).select("__doc", "copies")
    crowd = materialise(alike.where("rows > 1").select(*key), "crowds")
    place = lambda t, name: numbered(t.join(crowd, key, "left_semi"), ["__source"], ["__id", "__size"], name).drop("n", "__id", "__size")
    many = place(rows, "crowded").join(place(counted, "places").where("copies > 0"), ["__source", "slot"]).select("__doc", "copies")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return once.unionByName(many).withColumn("__copy", copies).select("__doc.*")
