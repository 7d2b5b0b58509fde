"""The locally finished forest against a plain recursion, other partitionings, and MLlib."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spectrel.operators import forest as fo


def rows_of(n, width=9, classes=3, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(2)
    x[:, -1] = 1.0  # never splits
    y = (np.digitize(x[:, 0] + x[:, 1] * x[:, 2], [-0.5, 0.6]) + (rng.random(n) < noise / 3)) % classes
    return x, y


def frame(spark, x, y, partitions=4):
    return spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, features array<double>, label int").repartition(partitions)


def scores(forest, df, **kw):
    return {r["id"]: r["probabilities"] for r in forest.score(df, **kw).select("id", "probabilities").collect()}


def plain_tree(x, y, w, classes, seed, tree, place, tries):
    """Nested (feature, bin, left, right) or class shares, one node after the other."""
    counts = np.bincount(y, w, classes)
    if np.count_nonzero(counts) < 2:
        return (counts / counts.sum()).tolist()
    order = fo.feature_orders(seed, tree, np.array([place], np.uint64), x.shape[1])[0].tolist()
    for lo in range(0, len(order), tries):
        found = None
        for f in sorted(order[lo:lo + tries]):
            for b in np.unique(x[:, f])[:-1].tolist():
                left, right = (np.bincount(y[s], w[s], classes) for s in (x[:, f] <= b, x[:, f] > b))
                p = (left ** 2).sum() / left.sum() + (right ** 2).sum() / right.sum()
                if found is None or p > found[0]:
                    found = (p, f, b)
        if found:
            _, f, b = found
            s = x[:, f] <= b
            return (f, b, *(plain_tree(x[k], y[k], w[k], classes, seed, tree, int(fo.child_places(np.array([place], np.uint64), i)[0]), tries) for i, k in enumerate((s, ~s))))
    return (counts / counts.sum()).tolist()


def nested(g, classes, node=0):
    if g.feature[node] < 0:
        v = np.array(g.value[node], float)
        return (v / v.sum()).tolist()
    return (g.feature[node], g.bin[node], nested(g, classes, g.left[node]), nested(g, classes, g.right[node]))


@pytest.mark.parametrize("n,bins,tries,cells", [(120, 40, 3, 1 << 21), (200, 3, 2, 30), (60, 2, 9, 1 << 21), (40, 64, 1, 9)])
def test_growth_against_a_plain_recursion(monkeypatch, n, bins, tries, cells):
    monkeypatch.setattr(fo, "NODE_CELLS", cells)
    x, y = rows_of(n, seed=n)
    b = fo.binned(x, fo.quantile_edges(x, bins))
    w = np.random.default_rng(1).integers(1, 4, n)
    for tree in range(3):
        got = fo.grow(b, y, w, 3, 5, tree, 77 + tree, tries)
        assert nested(got, 3) == plain_tree(b, y, w, 3, 5, tree, 77 + tree, tries)


def test_bootstrap_weights_are_poisson():
    w = np.concatenate([fo.weights(np.arange(20_000), t, 3) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(fo.weights(np.arange(20_000), 0, 3), fo.weights(np.arange(20_000), 1, 3))[0, 1]) < 0.03


def test_bins_hold_their_values():
    x = np.array([[0.0, 5], [1, 5], [1, 5], [2, 5], [3, 5]])
    assert fo.binned(x, fo.quantile_edges(x, 64))[:, 0].tolist() == [0, 1, 1, 2, 3] and not fo.binned(x, fo.quantile_edges(x, 64))[:, 1].any()
    many = np.random.default_rng(2).normal(size=(5_000, 1))
    counts = np.bincount(fo.binned(many, fo.quantile_edges(many, 16))[:, 0])
    assert len(counts) == 16 and counts.min() > 250


def test_same_trees_on_any_partitions_and_by_passes(spark):
    x, y = rows_of(600)
    y[:3] = [0, 1, 2]
    fit = lambda parts, **kw: fo.fit_forest(frame(spark, x, y, parts), 9, n_trees=6, seed=2, key="id", **kw)
    df, one = frame(spark, x, y), fit(1)
    want = scores(one, df)
    assert scores(fit(8), df) == want == scores(fit(3, ship_rows=500), df)
    by_passes = fit(5, local_rows=60)
    assert by_passes.pieces.where("root = -1").count() == 6 and by_passes.pieces.where("root >= 0").count() > 12
    got = scores(by_passes, df)
    assert all(np.allclose(got[i], want[i]) for i in want)
    rounds = scores(by_passes, df, ship_bytes=4_000)
    assert all(np.allclose(rounds[i], want[i]) for i in want)
    only_passes = scores(fit(2, local_rows=0), df)
    assert all(np.allclose(only_passes[i], want[i]) for i in want)


def _sent_to_driver(monkeypatch, forest, df, **kw):
    """Scores, and how many subtrees the driver was handed on the way."""
    seen, of = [], fo.Piece.of.__func__
    monkeypatch.setattr(fo.Piece, "of", classmethod(lambda cls, row, classes: seen.append(row["root"]) or of(cls, row, classes)))
    got = scores(forest, df, **kw)
    monkeypatch.undo()
    return got, sum(r >= 0 for r in seen)


@pytest.mark.parametrize("local_rows,ship,meet", [(10_000, 4_000, 1 << 20), (60, 4_000, 1 << 20), (60, 4_000, 3_000), (10_000, 60_000, 4_000)])
def test_subtrees_of_a_large_forest_stay_off_the_driver(spark, monkeypatch, local_rows, ship, meet):
    """Groups of trees, single trees and parts of a tree, with rows of a group in one task and in several."""
    x, y = rows_of(500, seed=5)
    x[250:], y[250:] = x[:250], y[::-1][250:]  # equal rows of other classes: mixed leaves
    df = frame(spark, x, y)
    forest = fo.fit_forest(df, 9, n_trees=7, seed=1, key="id", local_rows=local_rows)
    want = scores(forest, df, ship_bytes=1 << 40)
    odd = df.unionByName(spark.createDataFrame([(-1, None, 0), (-2, [1.0], 0)], df.schema))
    monkeypatch.setattr(fo, "MEET_BYTES", meet)
    got, subtrees = _sent_to_driver(monkeypatch, forest, odd, ship_bytes=ship)
    assert subtrees == 0 and got.pop(-1) is None and got.pop(-2) is None and len(got) == 500
    assert all(np.allclose(got[i], want[i], atol=1e-12) for i in want)


def test_accuracy_as_mllib(spark):
    x, y = rows_of(3_000, seed=4, noise=0.2)
    df = frame(spark, x, y)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    mine = fo.fit_forest(train, 9, n_trees=60, key="id").score(test).select("label", "probabilities").collect()
    mine = np.mean([np.argmax(r["probabilities"]) == r["label"] for r in mine])
    vector = lambda d: d.withColumn("_x", array_to_vector("features")).withColumn("_y", F.col("label").cast("double"))
    model = RandomForestClassifier(numTrees=60, featureSubsetStrategy="sqrt", seed=1, featuresCol="_x", labelCol="_y", maxDepth=20, maxBins=64).fit(vector(train))
    theirs = np.mean([r["prediction"] == r["label"] for r in model.transform(vector(test)).collect()])
    assert mine > 0.75 and mine >= theirs - 0.01


def test_leaves_are_pure_and_odd_tables_hold(spark):
    x, y = rows_of(300, seed=9)
    df = frame(spark, x, y)
    forest = fo.fit_forest(df, 9, n_trees=12, max_bins=256)
    values = [np.frombuffer(r["value"], "<f8").reshape(-1, 3)[np.frombuffer(r["feature"], "<i4") < 0] for r in forest.pieces.collect()]
    assert all((v.max(1) == 1).all() for v in values)
    one = fo.fit_forest(df.withColumn("label", F.lit(1)), 9, n_trees=2, classes=3)
    assert {tuple(v) for v in scores(one, df).values()} == {(0.0, 1.0, 0.0)}
    same = spark.createDataFrame([(i, [1.0, 2.0], i % 2) for i in range(40)], df.schema)
    for rows in (10, 1_000):
        got = scores(fo.fit_forest(same, 2, n_trees=8, key="id", local_rows=rows), same)
        assert len({tuple(v) for v in got.values()}) == 1 and abs(sum(got[0]) - 1) < 1e-9
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, x[0].tolist())], "id long, features array<double>")
    got = scores(forest, odd)
    assert got[1] is None and got[2] is None and got[3] is not None
    for bad in (df.withColumn("label", F.lit(None).cast("int")), df.withColumn("features", F.array(F.lit(1.0))), df.withColumn("label", F.lit(-1))):
        with pytest.raises(Exception):
            fo.fit_forest(bad, 9, n_trees=1, classes=3)
    with pytest.raises(ValueError):
        fo.fit_forest(df.limit(0), 9)
