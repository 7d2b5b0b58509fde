"""Exact bootstrap of a column: as many draws as there are rows, split down a tree instead of shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .evaluate import _interval

#: Distinct values a leaf of the tree holds on average.
LEAF_VALUES = 65_536


def leaf_draws(sizes: np.ndarray, leaf: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For every replicate: draws that fall to a leaf, and draws that fall to the leaves before it.

    ``sizes`` are the rows of each leaf (a power of two of them). At every node the draws split by a
    binomial whose generator is seeded by (seed, node), so all leaves agree on the nodes they share.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    draws, before = np.full(n, ends[-1]), np.zeros(n, dtype=np.int64)
    lo, hi, node = 0, len(sizes), 1
    while hi - lo > 1:
        mid, rows = (lo + hi) // 2, ends[hi] - ends[lo]
        left_share = (ends[mid] - ends[lo]) / rows if rows else 0.0
        left = np.random.default_rng([seed, node]).binomial(draws, left_share)
        if leaf < mid:
            draws, hi, node = left, mid, 2 * node
        else:
            draws, before, lo, node = draws - left, before + left, mid, 2 * node + 1
    return draws, before


def drawn(counts: np.ndarray, draws: int, replicate: int, leaf: int, seed: int) -> np.ndarray:
    """How often each of a leaf's distinct values, of which there are ``counts`` rows, is drawn in a replicate."""
    return np.random.default_rng([seed, 0, leaf, replicate]).multinomial(draws, counts / counts.sum())


def bootstrap_exact(df: DataFrame, value: str, percentiles: dict[str, float] | None = None, n: int = 500, seed: int = 0,
                    leaf_values: int = LEAF_VALUES) -> DataFrame:
    """95 % intervals of the mean, the (population) spread and any percentiles of a column, in one row.

    Every replicate draws exactly as many rows as there are, with replacement. Rows are folded to
    distinct values with their counts, and values are cut into leaves of a tree in ascending order. Draws go
    down the tree by binomials and are spent inside a leaf by a multinomial, so what is shuffled is the
    distinct values once and a row of sums per leaf and replicate, never ``n`` times the table. As leaves
    are in order, the leaf that holds a replicate's k-th smallest draw is known from the draws before
    it: percentiles (linear between ranks) are exact too.

    The cuts are the values of least hash, so draws depend on the values and the seed alone, not on
    partitions. A value that many rows share is one entry. The driver holds one cut and one count a leaf.
    Null and NaN values take no part; without any others all bounds are NaN.
    """
    percentiles = percentiles or {}
    v = F.col(value).cast("double") + F.lit(0.0)
    clean = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    values = materialise(clean.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "values")
    whole = values.agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("rows"), F.avg("v").alias("centre")).first()
    rows, centre = int(whole["rows"] or 0), float(whole["centre"] or 0.0)
    leaves = 1
    while leaves * leaf_values < whole["d"]:
        leaves *= 2
    least = values.select("v").orderBy(F.xxhash64("v"), "v").limit(leaves - 1).collect() if leaves > 1 else []
    cuts = np.sort([r["v"] for r in least])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.searchsorted(cuts, batch.column("v").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), batch.column("v"), batch.column("c")], ["leaf", "v", "c"])

    placed = values.mapInArrow(place, "leaf int, v double, c bigint")
    sizes = np.zeros(leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").agg(F.sum("c").alias("c")).collect():
        sizes[r["leaf"]] = r["c"]
    # Ranks (from 0) on both sides of each percentile.
    at = {k: q * (rows - 1) for k, q in percentiles.items()}
    ranks = [int(np.floor(p)) + up for p in at.values() for up in (0, 1)]
    named = [f"{side}_{k}" for k in at for side in ("lo", "hi")]

    def spend(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        order = np.argsort(table.column("v").to_numpy())
        v, c = table.column("v").to_numpy()[order], table.column("c").to_numpy()[order]
        draws, before = leaf_draws(sizes, leaf, n, seed)
        sums, found = np.zeros((n, 3)), np.full((n, len(ranks)), np.nan)
        x = v - centre
        for b in range(n):
            w = drawn(c, int(draws[b]), b, leaf, seed)
            sums[b] = w.sum(), w @ x, w @ (x * x)
            inside = [(i, r - before[b]) for i, r in enumerate(ranks) if before[b] <= r < before[b] + draws[b]]
            if inside:
                ends = np.cumsum(w)
                for i, r in inside:
                    found[b, i] = v[np.searchsorted(ends, r, side="right")]
        columns = {"_b": pa.array(np.arange(n, dtype=np.int32)), **{k: pa.array(sums[:, i]) for i, k in enumerate(("n", "s", "ss"))}}
        return pa.table(columns | {k: pa.array(found[:, i], from_pandas=True) for i, k in enumerate(named)})

    schema = ", ".join(["_b int", "n double", "s double", "ss double", *[f"{k} double" for k in named]])
    totals = placed.groupBy("leaf").applyInArrow(spend, schema).groupBy("_b").agg(
        *[F.sum(k).alias(k) for k in ("n", "s", "ss")], *[F.max(k).alias(k) for k in named])

    def percentile(k: str) -> Column:
        lo, share = F.col(f"lo_{k}"), float(at[k] - np.floor(at[k]))
        return lo if share == 0 else lo + (F.col(f"hi_{k}") - lo) * share

    mean = F.col("s") / F.col("n")
    stats = {"mean": mean + centre, "spread": F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))),
             **{k: percentile(k) for k in at}}
    return _interval(totals.select("_b", *[s.alias(k) for k, s in stats.items()]), list(stats))
