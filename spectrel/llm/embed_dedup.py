"""Embedding near-duplicates: p-stable hashing of normalised vectors, then exact cosine checks.

A vector is hashed ``tables`` times; a table's bucket is the label and ``width`` quantised random
projections floor((a.x + b) / w). Two vectors of one label that share a bucket are compared by cosine
in double precision. Equal vectors are one class before anything is posted, so copies cost nothing, and
a pair that meets in several tables counts in the first of them only: each posting carries the
signatures of all tables. Buckets over ``cap`` are cut into tiles that cover all pairs of their parts.

At cosine 0.93 a projection agrees with probability 0.90 (w = 3), so 14 of them do with 0.22 and one of
40 tables catches the pair with 0.99996; closer pairs are missed more rarely still.

Rows: vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label, link with nothing and are returned with 0 links. Vectors of different length never link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import Forest, components

CAP = 1_024


def usable(column: str = "embedding"):
    """True for vectors that take part: not null or empty, all components finite, not all zero."""
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _signatures(x: np.ndarray, tables: int, width: int, w: float) -> np.ndarray:
    """(n, tables) cells, as 32 bits of a hash; equal cells are equal, others rarely."""
    rng = np.random.Generator(np.random.PCG64(x.shape[1]))
    a, b = rng.standard_normal((x.shape[1], tables * width)), rng.uniform(0, w, tables * width)
    cells = np.floor((unit_rows(x) @ a + b) / w).astype(np.int64).reshape(len(x), tables, width)
    odd = rng.integers(1, 1 << 62, width, np.int64) * 2 + 1
    return ((cells * odd).sum(axis=2) >> 32).astype(np.int32)


def _post(tables: int, width: int, w: float, kind: pa.DataType):
    schema = pa.schema([("class_id", pa.int64()), ("embedding", pa.list_(kind)), ("copies", pa.int64()),
                        ("label", pa.string()), ("sig", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            by_length = {}
            for i, n in enumerate(batch.column(1).value_lengths().to_pylist()):
                by_length.setdefault(n, []).append(i)
            for rows in by_length.values():
                part = batch.take(pa.array(rows))
                sig = _signatures(_matrix(part.column(1)), tables, width, w)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], schema=schema)

    return run


def _links(g: pa.Table, cosine: float, schema: pa.Schema) -> pa.RecordBatch:
    """Links (b is the tree's root, n = 0) and link counts (a = b) of rows ordered by bucket."""
    ids, copies, table, part, bucket = (g[c].to_numpy() for c in ("class_id", "copies", "table", "part", "bucket"))
    cross = g["cross"].to_numpy()
    x = unit_rows(_matrix(g["embedding"].combine_chunks()))
    sig = g["sig"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    earlier = np.arange(sig.shape[1])
    links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    left, step = np.arange(len(ids)), 0
    while True:
        step += 1
        left = left[:np.searchsorted(left, len(ids) - step)]
        left = left[bucket[left] == bucket[left + step]]
        if not len(left):
            break
        a = left[~cross[left] | (part[left] != part[left + step])]
        for lo in range(0, len(a), 1 << 15):
            p = a[lo:lo + (1 << 15)]
            q = p + step
            p = p[np.einsum("ij,ij->i", x[p], x[q]) >= cosine]
            q = p + step
            # A pair counts in the first table in which it shares a bucket.
            p = p[~((sig[p] == sig[q]) & (earlier < table[p][:, None])).any(axis=1)]
            q = p + step
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            forest.join(p, q)
    member, root = forest.links()
    some = np.flatnonzero(links)
    return pa.record_batch({"a": np.concatenate([ids[some], ids[member]]), "b": np.concatenate([ids[some], ids[root]]),
                            "n": np.concatenate([links[some], np.zeros(len(member), np.int64)])}, schema=schema)


def _compare(cosine: float):
    """Rows ordered by bucket, in batches that may cut a bucket; holds one batch and one bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def whole(t: pa.Table):
        # Vectors of different length cannot share a matrix, nor a link.
        lengths = pc.list_value_length(t["embedding"]).to_numpy()
        for n in np.unique(lengths):
            yield _links(t if (lengths == n).all() else t.filter(pa.array(lengths == n)), cosine, schema)

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            buckets = held["bucket"].to_numpy()
            done = int(np.searchsorted(buckets, buckets[-1])) if len(buckets) else 0
            if done:
                yield from whole(held.slice(0, done))
            held = held.slice(done)
        if held is not None and held.num_rows > 1:
            yield from whole(held)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = 40, width: int = 14, w: float = 3.0, cap: int = CAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector; links need equal labels and ``cosine`` or more."""
    # Single-precision vectors are shuffled as such and widened in the tasks.
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"),
                          F.col("label").cast("string").alias("label"))
    sound = rows.where(usable() & F.col("label").isNotNull())
    # The same numbers in the same order: 128 bits of hash stand for the vector.
    key = [F.xxhash64("embedding", "label").alias("k1"), F.xxhash64("label", "embedding", F.lit(1)).alias("k2")]
    classes = sound.groupBy(*key).agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"),
                                      F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = materialise(classes.withColumn("class_id", F.xxhash64("k1", "k2")), "classes")
    posted = materialise(classes.select("class_id", "embedding", "copies", "label").mapInArrow(
        _post(tables, width, w, pa.float32() if kind == "float" else pa.float64()), f"class_id long, embedding array<{kind}>, copies long, label string, sig array<int>"), "signatures")
    slots = posted.select("class_id", "label", F.posexplode("sig").alias("table", "cell")).select(
        "class_id", "table", F.xxhash64("label", "table", "cell").alias("bucket"))
    sizes = slots.groupBy("bucket").count().where("count > 1")
    slots = slots.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("count") / cap).cast("int"))
    slots = slots.withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("parts")).cast("int"))
    tile = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")
    placed = slots.select("class_id", "table", "part", tile, "bucket").select(
        "class_id", "table", "part", (F.col("part") != F.col("q")).alias("cross"),
        F.xxhash64("bucket", F.least("part", "q"), F.greatest("part", "q")).alias("bucket"))
    full = placed.join(posted.select("class_id", "embedding", "copies", "sig"), "class_id")
    found = materialise(full.select("bucket", "table", "part", "cross", "class_id", "embedding", "copies", "sig")
                        .repartition("bucket").sortWithinPartitions("bucket", "class_id").mapInArrow(_compare(cosine), "a long, b long, n long"), "links")
    nodes = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n"))
    flat = (classes.select("k1", "k2", "class_id", "low", "copies").join(nodes.withColumnRenamed("node", "class_id"), "class_id", "left")
            .join(counts, "class_id", "left").withColumn("root", F.coalesce("root", "class_id")))
    lows = flat.groupBy("root").agg(F.min("low").alias("component"))
    flat = flat.join(lows, "root").select("k1", "k2", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    linked = sound.select("vec_id", *key).join(flat, ["k1", "k2"]).select(
        "vec_id", F.col("n").cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    alone = rows.where(~(usable() & F.col("label").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
