"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges`` (a, b).

    Alternating star rounds: each node hands its larger neighbours, then all its smaller ones, to its
    smallest neighbour, until the edge table stays as it is. A round is two aggregates and two joins;
    the table of a round is written to the shared folder. Rounds grow with the logarithm of the
    longest path. Loops and null ends are left out, repeated edges count once.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(state) == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(state)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")


class Forest:
    """Union-find over positions of an array, for links found inside one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Take the links in; afterwards ``root`` is the smallest position of every tree."""
        root = self.root
        while len(left):
            a, b = root[left], root[right]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while True:
                further = root[root]
                if (further == root).all():
                    break
                root = further
            apart = root[left] != root[right]
            left, right = left[apart], right[apart]
        self.root = root

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """One link from every other member of a tree to its root."""
        member = np.flatnonzero(self.root != np.arange(len(self.root)))
        return member, self.root[member]
