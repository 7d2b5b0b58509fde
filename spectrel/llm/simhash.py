"""SimHash near-duplicates: fingerprints, candidate buckets, pivot distance tables, components.

Distinct fingerprints are posted under every choice of ``blocks - distance`` equal bit blocks: two
fingerprints within ``distance`` bits agree on at least one choice, so none is missed. Inside a bucket,
pairs are thrown out by their precomputed Hamming distances to fixed reference fingerprints (two
fingerprints within d bits differ by at most d in each of them), and survivors are verified. Buckets
with more than ``cap`` members are cut into tiles, pairs of parts, that cover all their pairs. A bucket
returns a spanning forest of its links, never its pairs.

Rows: a null text has no words, like an empty one; documents without words share the fingerprint zero.
Rows of one doc_id and different texts are each in the component of their own text; a null doc_id is no
candidate for the smallest. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import textbytes as tb
from .components import Forest, components
from .textbytes import U64

SEED = 42
PIVOTS = tb.counter_hash(2_024, 16)
CAP = 2_048


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits; each is set if set in over half the hashes of the word shingles of ``text``."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    set_bits, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 16)].tolist(), ends[at:at + (1 << 16)].tolist())), U64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, *also: str) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; with the long columns ``also`` between them."""

    def run(batches):
        for batch in batches:
            values = [fingerprint((t or "").encode(), shingle) for t in batch.column("text").to_pylist()]
            kept = {c: batch.column(c).cast(pa.int64()) for c in ("doc_id", *also)}
            yield pa.record_batch(kept | {"fp": pa.array(np.array(values, U64).view(np.int64))})

    return tb.text_rows(docs, "doc_id", *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *also, "fp")))


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """(n, references) Hamming distances."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)


def _linked(bucket: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints of one bucket; ``bucket`` is ordered."""
    table, forest = pivot_distances(fps), Forest(len(fps))
    left, step = np.arange(len(fps)), 0
    while True:
        step += 1
        left = left[:np.searchsorted(left, len(fps) - step)]
        left = left[bucket[left] == bucket[left + step]]
        if not len(left):
            break
        a = left[forest.root[left] != forest.root[left + step]]
        for p in range(table.shape[1]):
            a = a[np.abs(table[a, p] - table[a + step, p]) <= distance]
        a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= distance]
        forest.join(a, a + step)
    return forest.links()


def _pair_up(distance: int):
    """Rows (bucket, fp) ordered by bucket, in batches that may cut a bucket; holds one batch and one bucket."""

    def links(bucket, fps):
        if len(bucket) < 2:
            return
        a, b = _linked(bucket, fps, distance)
        if len(a):
            yield pa.record_batch({"a": pa.array(fps[a].view(np.int64)), "b": pa.array(fps[b].view(np.int64))})

    def run(batches):
        bucket, fps = np.zeros(0, np.int64), np.zeros(0, U64)
        for batch in batches:
            bucket = np.append(bucket, batch.column(0).to_numpy())
            fps = np.append(fps, batch.column(1).to_numpy().view(U64))
            done = np.searchsorted(bucket, bucket[-1]) if len(bucket) else 0
            yield from links(bucket[:done], fps[:done])
            bucket, fps = bucket[done:], fps[done:]
        yield from links(bucket, fps)

    return run


def _masks(blocks: int, distance: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def fingerprint_links(fps: DataFrame, distance: int = 4, blocks: int = 6, cap: int = CAP) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``distance`` bits."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(_masks(blocks, distance))])
    posted = fps.select("fp", F.explode(keys).alias("bucket"))
    crowded = posted.groupBy("bucket").count().where(F.col("count") > cap)
    parts = F.ceil(F.col("count") / cap).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), parts).cast("int")
    # A part meets each part, itself included, in one tile.
    tiles = F.when(F.col("count").isNull(), F.array("bucket")).otherwise(F.transform(
        F.sequence(F.lit(0), parts - 1), lambda q: F.xxhash64("bucket", F.least(own, q), F.greatest(own, q))))
    placed = posted.join(crowded, "bucket", "left").select(F.explode(tiles).alias("bucket"), "fp")
    return (placed.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_pair_up(distance), "a long, b long"))


def _components(rows: DataFrame, distance: int = 4, blocks: int = 6, cap: int = CAP) -> DataFrame:
    """(fp, root, component_id) of the fingerprints of ``rows``: the component by a fingerprint and by its smallest doc_id."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = materialise(classes, "classes")
    nodes = components(fingerprint_links(classes.select("fp"), distance, blocks, cap))
    rooted = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 6, cap: int = CAP) -> DataFrame:
    """(doc_id, fp, component_id), a row per document; the component is its smallest doc_id.

    ``blocks`` sets the size of a bucket key: 6 suits up to about 1e8 distinct fingerprints, 7 up to
    1e10, 8 beyond; it never changes the result, nor does ``cap``.
    """
    rows = materialise(fingerprints(docs, shingle), "fingerprints")
    return rows.join(_components(rows, distance, blocks, cap), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, **parameters) -> DataFrame:
    """Of each component the row of the smallest doc_id, of several such rows that of the least text hash; rows
    without an id stay. Ids may repeat: rows are told apart by id and text, and every component keeps one of its own."""
    told = docs.withColumn("__text", F.xxhash64("text"))
    rows = materialise(fingerprints(told, shingle, "__text"), "fingerprints")
    least = rows.join(_components(rows, **parameters), "fp").where("doc_id = component_id")
    kept = _first(least, ["root"], "__text").select("doc_id", "__text")
    alike = told.where("doc_id IS NOT NULL").join(kept, ["doc_id", "__text"], "left_semi")
    return _first(alike, ["doc_id", "__text"], "__text").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def _first(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    return df.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("__first = 1")
