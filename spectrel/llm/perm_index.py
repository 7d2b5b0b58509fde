"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its ``prefix`` nearest pivots, in order. The pivots are a bounded sample of
the vectors (of 8 x ``pivots`` by least hash, those not near each other); every vector is indexed. Vectors are dealt into blocks;
inside a block each pivot has an inverted file of the vectors that rank it and at which place. A query
walks the files of its own pivots and adds up, for every vector met, the part of the footrule distance
that shared pivots save (for prefixes of equal length the footrule is a constant minus twice the sum of
the lesser of both weights, a weight being prefix + 1 - place). The ``candidates`` share of a block
with the least distance is reranked by the exact inner product in double precision.

Query blocks meet vector blocks as tiles, so a task holds one block of each. Equal vectors are one index
entry with the ids that can still be among the results (``k + 1`` smallest), so a vector with many copies
costs as much as one. Recall is measured in the tests and the README.

Rows: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do
null ids; vectors of different length are never compared; other columns are ignored. Ties go to the smaller id.
Repeated rows count once. An id with several vectors, indexed or asked for, stands for all of them: it is
found, and finds, at most once, with the best score of its vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .embed_dedup import _matrix, unit_rows, usable

BLOCK = 8_192
SAMPLE = 8  # vectors looked at for each pivot
INDEX_SCHEMA = "dim int, block long, vector array<double>, ids array<bigint>, places binary"


def places(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(n, prefix) pivot numbers, nearest first; equal products in pivot order."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def spread(sample: np.ndarray, pivots: int, most: float = 0.8) -> np.ndarray:
    """``pivots`` vectors of a sample, passing over those near (cosine over ``most``) to one already
    chosen as long as others remain: a crowd of near copies would fill every prefix with one place."""
    unit, chosen, passed = unit_rows(sample), [], []
    for i in range(len(sample)):
        near = chosen and (unit[chosen] @ unit[i]).max() > most
        (passed if near else chosen).append(i)
        if len(chosen) == pivots:
            break
    return sample[(chosen + passed)[:pivots]]


def _indexed(pivots: dict[int, np.ndarray], prefix: int):
    def run(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                found = places(_matrix(part.column(2)), pivots[int(dim)], prefix)
                yield pa.record_batch([*part.columns, pa.array([r.tobytes() for r in found], pa.binary())], ["dim", "block", "vector", "ids", "places"])

    return run


def shared_weight(query_places: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], n: int, prefix: int) -> np.ndarray:
    """(queries, n): what shared pivots save of the footrule distance."""
    saved = np.zeros((len(query_places), n), np.uint16)
    weight = np.zeros((len(query_places), len(files)), np.uint16)
    np.put_along_axis(weight, query_places, np.arange(prefix, prefix - query_places.shape[1], -1, dtype=np.uint16)[None, :].repeat(len(query_places), 0), 1)
    for p, (members, weights) in enumerate(files):
        asking = np.flatnonzero(weight[:, p])
        if len(asking) and len(members):
            saved[np.ix_(asking, members)] += np.minimum(weight[asking, p][:, None], weights)
    return saved


def _files(block_places: np.ndarray, pivots: int, prefix: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the vectors that rank it, and their weights."""
    order = np.argsort(block_places.reshape(-1), kind="stable")
    width = block_places.shape[1]
    cuts = np.searchsorted(block_places.reshape(-1)[order], np.arange(pivots + 1))
    return [(order[a:b] // width, (prefix - order[a:b] % width).astype(np.uint16)) for a, b in zip(cuts, cuts[1:])]


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(pivots: dict[int, np.ndarray], prefix: int, share: float, least: int, k: int):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        if not block.num_rows or not queries.num_rows:
            return RESULT.empty_table()
        x, q = _matrix(block["vector"].combine_chunks()), _matrix(queries["vector"].combine_chunks())
        ids = block["ids"].to_pylist()
        low = np.array([i[0] for i in ids])
        query_ids = queries["query_id"].to_pylist()
        pv = pivots[x.shape[1]]
        width = min(prefix, len(pv))
        files = _files(np.frombuffer(b"".join(block["places"].to_pylist()), np.int32).reshape(len(x), width), len(pv), width)
        take = min(len(x), max(least, int(np.ceil(share * len(x)))))
        out: list[tuple] = []
        for lo in range(0, len(q), 256):
            part = q[lo:lo + 256]
            saved = shared_weight(places(part, pv, width), files, len(x), width)
            near = np.argpartition(saved, len(x) - take, axis=1)[:, len(x) - take:]
            for i, row in enumerate(near):
                score = np.einsum("ij,j->i", x[row], part[i])
                # Entries of one id more than asked for: the query's own may be among them.
                best, lows = [], set()
                for b in np.lexsort((low[row], -score)):
                    best.append(b)
                    lows.add(low[row[b]])
                    if len(lows) > k:
                        break
                mine: dict[int, float] = {}
                for b in best:
                    for v in ids[row[b]]:
                        if v != query_ids[lo + i]:
                            mine.setdefault(v, -score[b])
                out += [(query_ids[lo + i], v, -s) for s, v in sorted((s, v) for v, s in mine.items())[:k]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, RESULT)], schema=RESULT)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, prefix: int = 64, candidates: float = 0.2,
           least: int = 640, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of ``queries`` its nearest ids of ``vectors`` by inner product.

    Both have ``vec_id`` and ``embedding``; an id never finds itself. ``candidates`` is the share of
    each block that is reranked, ``least`` its least number; recall grows with them, ``prefix`` and ``pivots``.
    """
    clean = lambda t: t.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = clean(vectors)
    hashes = [F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2")]
    # The smallest ids of equal vectors: first inside salted parts, then over the parts.
    once = rows.select("vec_id", "vector", *hashes).dropDuplicates(["vec_id", "h1", "h2"])
    salted = once.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    entries = ranked.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    entries = materialise(entries.withColumn("dim", F.size("vector")), "entries")
    first = lambda t, *by: t.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("h1", "h2"))).where(F.col("nth") <= SAMPLE * pivots)
    salted = entries.select("dim", "vector", "h1", "h2", F.pmod("h2", F.lit(256)).alias("salt"))
    sample = first(first(salted, "dim", "salt"), "dim").select("dim", "vector").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    points = {dim: spread(np.array(v), pivots) for dim, v in by_dim.items()}
    blocks = entries.groupBy("dim").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("long").alias("blocks"))
    index = (entries.join(blocks, "dim").select("dim", F.pmod(F.xxhash64("h1", "h2", F.lit(1)), F.col("blocks")).alias("block"), "vector", "ids")
             .mapInArrow(_indexed(points, prefix), INDEX_SCHEMA))
    index = materialise(index, "index")
    asked = clean(queries).select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim")).distinct()
    groups = asked.groupBy("dim").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("long").alias("groups"))
    shape = blocks.join(groups, "dim")
    tiles = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = index.join(shape.select("dim", "groups"), "dim").select("dim", "block", tiles("groups").alias("part"), "vector", "ids", "places")
    right = asked.join(shape, "dim").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("groups"))).select(
        "dim", tiles("blocks").alias("block"), "part", "query_id", "vector")
    key = ["dim", "block", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(points, prefix, candidates, least, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
