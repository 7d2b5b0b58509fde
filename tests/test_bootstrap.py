import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.operators import bootstrap as B


def plain(values, percentiles, n, seed, leaf_values, cuts):
    """All draws of all replicates spelled out, from the same tree."""
    cuts = np.sort(cuts)
    distinct, counts = np.unique(values, return_counts=True)
    leaf_of = np.searchsorted(cuts, distinct, side="right")
    sizes = np.bincount(leaf_of, weights=counts, minlength=len(cuts) + 1).astype(np.int64)
    shares = [B.leaf_draws(sizes, leaf, n, seed) for leaf in range(len(sizes))]
    stats = []
    for b in range(n):
        sample = []
        for leaf, (draws, before) in enumerate(shares):
            mine = leaf_of == leaf
            assert before[b] == len(sample)
            if mine.any():
                sample += np.repeat(distinct[mine], B.drawn(counts[mine], int(draws[b]), b, leaf, seed)).tolist()
        assert len(sample) == len(values)
        stats.append([np.mean(sample), np.std(sample), *np.percentile(sample, [100 * q for q in percentiles])])
    return np.percentile(np.array(stats), [2.5, 97.5], axis=0).T.ravel()


@pytest.mark.parametrize("leaf_values", [40, 10**6])
def test_exact_draws_against_all_draws_spelled_out(spark, leaf_values):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(500, 3, 700).round(2), np.full(400, 501.5), [1e4]])  # a third is one value
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    q = {"median": .5, "p90": .9, "top": 1.0}
    got = [B.bootstrap_exact(d, "x", q, n=60, seed=4, leaf_values=leaf_values).first() for d in (df.repartition(1), df.repartition(7))]
    # The draws are the same on any partitioning; sums differ by the order of adding up.
    assert np.allclose(list(got[0]), list(got[1]), rtol=1e-11) and got[0]["median_lo"] == got[1]["median_lo"]
    leaves = 1
    while leaves * leaf_values < len(np.unique(values)):
        leaves *= 2
    cuts = [r[0] for r in df.distinct().orderBy(F.xxhash64("x"), "x").limit(leaves - 1).collect()] if leaves > 1 else []
    want = plain(values, q.values(), 60, 4, leaf_values, cuts)
    assert np.allclose(list(got[0]), want, rtol=1e-9)


def test_intervals_cover_the_theory_and_odd_inputs_are_defined(spark):
    values = np.random.default_rng(3).normal(10, 2, 5000)
    df = spark.createDataFrame([(float(v), None) for v in values] + [(None, None), (float("nan"), None)], "x double, y double")
    r = B.bootstrap_exact(df, "x", {"median": .5}, n=300, leaf_values=500).first()
    half = 1.96 * 2 / np.sqrt(5000)
    assert abs(r["mean_hi"] - r["mean_lo"] - 2 * half) < .3 * half and r["mean_lo"] < values.mean() < r["mean_hi"]
    assert r["median_lo"] < np.median(values) < r["median_hi"] and r["spread_lo"] < values.std() < r["spread_hi"]
    empty = B.bootstrap_exact(df, "y", {"median": .5}, n=10).first()
    assert all(np.isnan(v) for v in empty)
    one = B.bootstrap_exact(df.limit(1), "x", {"median": .5}, n=10).first()
    assert one["mean_lo"] == one["median_hi"] and one["spread_hi"] == 0
