"""Random forests that finish their nodes locally.

Features are cut into bins by quantiles of a bounded sample, so a row is one byte a feature. A row's
bootstrap weight in a tree is a Poisson draw from a hash of the row's key and the tree, and the features a node
looks at follow from a hash of the tree and the node's place: a tree is the same on any partitioning and
after a retry.

Nodes of more than ``local_rows`` rows are split by passes over the table that add up class counts per bin for
a group of nodes. As soon as a node holds fewer, its rows are shipped, with their weights, to one task that
grows the whole subtree down to leaves that are pure or cannot be split. A table of at most ``local_rows`` rows needs
no passes. What is shipped is bounded a task by ``local_rows``, and in all by rows x trees; trees go in
groups, so that at most ``ship_rows`` rows are under way at once.

A forest is a table of pieces: the upper part of a tree, and its subtrees. A forest of up to ``SHIP_BYTES`` is
sent to every task. Of a larger one only the upper parts pass through the driver: rows and packed pieces meet by
groups of trees (or parts of a large tree) in tasks that hold ``MEET_BYTES`` of either, and the shares are added up by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, factorial, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..session import materialise

LOCAL_ROWS = 65_536
SHIP_ROWS = 50_000_000
SAMPLE_ROWS = 10_000
HIST_BYTES = 128 << 20
SHIP_BYTES = 16 << 20
MEET_BYTES = 32 << 20  # of packed pieces, and half of that of binned rows, in one task
NODE_BYTES = 16  # a packed node, with its share of the mixed leaves
FOLD_SALTS = 64
NODE_CELLS = 1 << 21  # nodes x features whose orders are made at once
U64 = np.uint64

PIECE = "tree int, root long, feature binary, bin binary, left binary, right binary, value binary, nodes long"
#: Weight k where the uniform draw reaches the k-th bound; weights over 12 have a chance under 1e-10.
_POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(13)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ALL = (1 << 64) - 1


def _word(*parts: int) -> int:
    """One 64-bit hash of some whole numbers."""
    h = 0x9E3779B97F4A7C15
    for p in parts:
        h = ((h ^ p) + 0x9E3779B97F4A7C15) & _ALL
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _ALL
        h ^= h >> 31
    return h


def weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Bootstrap weights of rows in a tree."""
    h = _mixed(_mixed(keys.view(U64) ^ U64(_word(seed, tree))) + U64(tree))
    return np.searchsorted(_POISSON, (h >> U64(11)) / float(1 << 53), "right").astype(np.int64)


_STEP = U64(0x9E3779B97F4A7C15)


def _words(first: np.ndarray, last) -> np.ndarray:
    """``_word(*parts, last)`` of many, from the hash ``first`` of the other parts."""
    return _mixed((first ^ last) + _STEP)


def feature_orders(seed: int, tree: int, places: np.ndarray, width: int) -> np.ndarray:
    """The order in which each node looks at features, a row per node."""
    node = _words(U64(_word(seed, tree)), places)
    return np.argsort(_mixed(np.arange(1, width + 1, dtype=U64) * U64(0xD1342543DE82EF95) ^ node[:, None]), axis=1, kind="stable")


def child_places(places: np.ndarray, side: int) -> np.ndarray:
    return _words(_words(U64(0x9E3779B97F4A7C15), places), U64(side + 1))


def best_split(hist: np.ndarray) -> tuple[int, int] | None:
    """(feature slot, last bin of the left child) of least Gini impurity from counts (slot, bin, class); first of equals."""
    if hist.shape[1] < 2:
        return None
    left = hist.cumsum(1)[:, :-1]
    total = hist.sum(1)[:, None]
    right = total - left
    nl, nr = left.sum(2), right.sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (left.astype(float) ** 2).sum(2) / nl + (right.astype(float) ** 2).sum(2) / nr
    purity[(nl == 0) | (nr == 0)] = -1.0
    at = int(purity.argmax())
    slot, bin_ = divmod(at, purity.shape[1])
    return (slot, bin_) if purity[slot, bin_] > 0 else None


class Growth:
    """Nodes of a piece as lists; a node without a feature is a leaf."""

    def __init__(self, classes: int):
        self.classes = classes
        self.feature, self.bin, self.left, self.right, self.value = [], [], [], [], []

    def add(self, counts: np.ndarray) -> int:
        self.feature.append(-1)
        self.bin.append(0)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(counts)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, bin_: int, left: int, right: int) -> None:
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin_, left, right

    def add_many(self, counts: np.ndarray) -> np.ndarray:
        return np.array([self.add(c) for c in counts], np.int64)

    def split_many(self, nodes, features, bins, children) -> None:
        for node, feature, bin_, (left, right) in zip(nodes.tolist(), features.tolist(), bins.tolist(), children.tolist()):
            self.split(node, feature, bin_, left, right)

    def row(self, tree: int, root: int) -> dict:
        value = np.array(self.value, float).reshape(-1, self.classes)
        value /= np.maximum(value.sum(1, keepdims=True), 1e-300)
        kind = {"feature": "<i4", "bin": "<i4", "left": "<i4", "right": "<i4"}
        return {"tree": tree, "root": root, **{k: np.array(getattr(self, k), t).tobytes() for k, t in kind.items()},
                "value": value.astype("<f8").tobytes(), "nodes": len(self.feature)}


def _hist(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int, classes: int) -> np.ndarray:
    """Weighted class counts (feature, bin, class) of binned rows."""
    m = x.shape[1]
    code = (np.arange(m) * bins + x) * classes + y[:, None]
    return np.rint(np.bincount(code.ravel(), np.repeat(w, m), m * bins * classes)).astype(np.int64).reshape(m, bins, classes)


def _best_of_nodes(x, y, w, rows, node, chosen, total) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The split of least Gini impurity of many nodes at once: (feature or -1, largest bin of the left child, its counts).

    ``rows`` stand node by node, ``node`` is the node of each, ``chosen`` the features of each node.
    """
    nodes, classes = total.shape
    feature, bin_, left_counts = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((nodes, classes), np.int64)
    best = np.zeros(nodes)
    starts = np.searchsorted(node, np.arange(nodes))
    each = np.zeros((len(rows), classes), np.int64)
    each[np.arange(len(rows)), y[rows]] = w[rows]
    everything = total[node]
    for j in range(chosen.shape[1]):
        value = x[rows, chosen[node, j]].astype(np.int64)
        key = node * 256 + value
        order = key.argsort(kind="stable")
        key = key[order]
        left = each[order].cumsum(0)
        left -= (left[starts] - each[order[starts]])[node]
        cut = np.append(key[:-1] < key[1:], False) & np.append(node[:-1] == node[1:], False)
        at = np.flatnonzero(cut)
        if not len(at):
            continue
        lo = left[at].astype(float)
        hi = everything[at] - lo
        purity = (lo ** 2).sum(1) / lo.sum(1) + (hi ** 2).sum(1) / hi.sum(1)
        mine = node[at]
        first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        top = np.maximum.reduceat(purity, first)
        owner = mine[first]
        hit = np.flatnonzero(purity == np.repeat(top, np.diff(np.append(first, len(mine)))))
        hit = hit[np.append(True, mine[hit][1:] != mine[hit][:-1])]  # the first of equals in each node
        better = top > best[owner]
        owner, hit = owner[better], at[hit[better]]
        best[owner], feature[owner], bin_[owner], left_counts[owner] = top[better], chosen[owner, j], key[hit] & 255, left[hit]
    return feature, bin_, left_counts


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, seed: int, tree: int, place: int, tries: int) -> Growth:
    """A subtree of all its rows, down to leaves that are pure or alike in every feature; level by level.

    A node takes the best of its first ``tries`` features; where none of these splits it, of the next ones.
    """
    out, width = Growth(classes), x.shape[1]
    total = np.rint(np.bincount(y, w, classes)).astype(np.int64)[None]
    rows, node, place_of, tried = np.arange(len(y)), np.zeros(len(y), np.int64), np.array([place], U64), np.zeros(1, np.int64)
    name = np.array([out.add(total[0])])
    if np.count_nonzero(total) < 2:
        return out
    while len(name):
        feature, bin_, left = np.full(len(name), -1), np.zeros(len(name), np.int64), np.zeros_like(total)
        step = max(1, NODE_CELLS // width)
        for lo in range(0, len(name), step):  # nodes of a level in groups, for their orders of features
            hi = min(len(name), lo + step)
            a, b = np.searchsorted(node, [lo, hi])
            order = feature_orders(seed, tree, place_of[lo:hi], width)
            spot = np.minimum(tried[lo:hi, None] + np.arange(tries), width - 1)
            chosen = np.sort(np.take_along_axis(order, spot, 1), axis=1)
            feature[lo:hi], bin_[lo:hi], left[lo:hi] = _best_of_nodes(x, y, w, rows[a:b], node[a:b] - lo, chosen, total[lo:hi])
        done = feature >= 0
        split = np.flatnonzero(done)
        counts = np.stack([left[split], total[split] - left[split]], 1)  # (node, side, class)
        child = out.add_many(counts.reshape(-1, classes)).reshape(-1, 2)
        out.split_many(name[split], feature[split], bin_[split], child)
        retry = np.flatnonzero(~done & (tried + tries < width))
        # The next level: children of two classes or more, and nodes with features left to try.
        open_ = np.count_nonzero(counts, axis=2) > 1
        number = np.full((len(name), 2), -1)
        number[split] = np.where(open_, np.cumsum(open_.ravel()).reshape(-1, 2) - 1, -1)
        number[retry] = (int(open_.sum()) + np.arange(len(retry)))[:, None]
        goes_right = np.zeros(len(rows), np.int64)
        inner = done[node]
        goes_right[inner] = x[rows[inner], feature[node[inner]]] > bin_[node[inner]]
        to = number[node, goes_right]
        keep = np.flatnonzero(to >= 0)
        keep = keep[to[keep].argsort(kind="stable")]
        rows, node = rows[keep], to[keep]
        places = np.stack([child_places(place_of[split], 0), child_places(place_of[split], 1)], 1)
        name, place_of = np.append(child[open_], name[retry]), np.append(places[open_], place_of[retry])
        total, tried = np.concatenate([counts[open_], total[retry]]), np.append(np.zeros(int(open_.sum()), np.int64), tried[retry] + tries)
    return out


@dataclass
class Piece:
    """One piece as arrays; ``route`` walks rows to their leaves."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, row, classes: int) -> Piece:
        part = lambda c, kind: np.frombuffer(row[c], kind)
        return cls(*[part(c, "<i4") for c in ("feature", "bin", "left", "right")], part("value", "<f8").reshape(-1, classes))

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            node = at[going]
            at[going] = np.where(x[going, self.feature[node]] <= self.bin[node], self.left[node], self.right[node])
            going = going[self.feature[at[going]] >= 0]
        return at

    def shares(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.route(x)]


PACKED = "tree int, root long, feature binary, bin binary, left binary, right binary, mixed binary"


def _pack(classes: int):
    """Pieces with small numbers, and instead of a value for every node the class of a pure leaf or the place of a mixed one."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                p = Piece.of(r, classes)
                leaf = p.feature < 0
                pure = leaf & (p.value.max(1, initial=0.0) == 1.0)
                mixed = leaf & ~pure
                right = np.where(pure, p.value.argmax(1), p.right)
                right[mixed] = classes + np.arange(np.count_nonzero(mixed))
                small = {"feature": p.feature.astype("<i4" if p.feature.max() >= 1 << 15 else "<i2"), "bin": p.bin.astype(np.uint8),
                         "left": p.left.astype("<i4"), "right": right.astype("<i4"), "mixed": p.value[mixed].astype("<f8")}
                yield pa.RecordBatch.from_pydict({"tree": pa.array([r["tree"]], pa.int32()), "root": pa.array([r["root"]], pa.int64()),
                                                  **{c: pa.array([v.tobytes()], pa.binary()) for c, v in small.items()}})

    return run


@dataclass
class Packed(Piece):
    """A packed piece: ``right`` of a leaf is the row of ``value`` that holds its shares."""

    @classmethod
    def of(cls, row, classes: int) -> Packed:
        left = np.frombuffer(row["left"], "<i4")
        feature = np.frombuffer(row["feature"], "<i2" if len(row["feature"]) == 2 * len(left) else "<i4")
        value = np.concatenate([np.eye(classes), np.frombuffer(row["mixed"], "<f8").reshape(-1, classes)])
        return cls(feature, np.frombuffer(row["bin"], np.uint8), left, np.frombuffer(row["right"], "<i4"), value)

    def shares(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.right[self.route(x)]]


def _add_shares(total: np.ndarray, x: np.ndarray, top: Piece | None, subtrees: dict[int, Piece]) -> None:
    """Add the shares that a tree gives to binned rows: those of leaves of its upper part, and of the subtrees at hand."""
    if top is None:
        for piece in subtrees.values():
            total += piece.shares(x)
        return
    at = top.route(x)
    leaf = np.flatnonzero(top.left[at] == -1)
    total[leaf] += top.value[at[leaf]]
    rows = np.flatnonzero(top.left[at] != -1)
    rows = rows[np.argsort(at[rows], kind="stable")]
    found, first = np.unique(at[rows], return_index=True)
    for root, mine in zip(found.tolist(), np.split(rows, first[1:])):
        if root in subtrees:
            total[mine] += subtrees[root].shares(x[mine])


# ---------------------------------------------------------------- bins


def quantile_edges(sample: np.ndarray, max_bins: int) -> list[np.ndarray]:
    """Upper bounds of all bins but the last, per feature: midpoints between values at the quantiles."""
    out = []
    for column in np.sort(sample, axis=0).T:
        distinct = np.unique(column)
        if len(distinct) > max_bins:
            distinct = np.unique(column[np.linspace(0, len(column) - 1, max_bins + 1).astype(int)[1:-1]])
            out.append(distinct)
        else:
            out.append((distinct[1:] + distinct[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of every value; a value equal to a bound goes below it."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], "left")
    return out


# ---------------------------------------------------------------- fitting


def _binning(edges, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in kernels.batches_as_matrix(batches, "x", width):
            b = binned(x, edges.value)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "y": batch.column("y"), "bins": pa.array([r.tobytes() for r in b], pa.binary())})

    return run


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _numpy(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def _histograms(tops, chosen, seed: int, width: int, bins: int, classes: int):
    """Class counts of the nodes in ``chosen`` ({tree: {node: features}}), one row per node a task."""

    def run(batches):
        sums, salt = {}, None
        for batch in batches:
            x, y, keys = _matrix(batch.column("bins"), width), _numpy(batch, "y"), _numpy(batch, "key")
            if salt is None and len(keys):
                salt = int(keys[0]) % FOLD_SALTS
            for tree, nodes in chosen.value.items():
                w = weights(keys, tree, seed)
                at = tops.value[tree].route(x)
                mine = np.flatnonzero((w > 0) & np.isin(at, list(nodes)))
                mine = mine[np.argsort(at[mine], kind="stable")]
                found, first = np.unique(at[mine], return_index=True)
                for node, rows in zip(found.tolist(), np.split(mine, first[1:])):
                    h = _hist(x[rows[:, None], nodes[node]], y[rows], w[rows], bins, classes)
                    sums[tree, node] = sums[tree, node] + h if (tree, node) in sums else h
        for (tree, node), h in sums.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()),
                                              "salt": pa.array([salt], pa.int64()), "hist": pa.array([h.astype("<i8").tobytes()], pa.binary())})

    return run


def _added(table: pa.Table) -> np.ndarray:
    total = 0
    for h in table.column("hist"):
        total = total + np.frombuffer(h.as_py(), "<i8")
    return total


def _fold(table: pa.Table) -> pa.Table:
    return table.slice(0, 1).set_column(3, "hist", pa.array([_added(table).tobytes()], pa.binary()))


def _decide(bins: int, classes: int):
    def run(table: pa.Table) -> pa.Table:
        hist = _added(table).reshape(-1, bins, classes)
        found = best_split(hist) or (-1, 0)
        left = hist[found[0], :found[1] + 1].sum(0) if found[0] >= 0 else np.zeros(classes, np.int64)
        return pa.table({"tree": table.column("tree")[:1], "node": table.column("node")[:1], "slot": pa.array([found[0]], pa.int32()),
                         "bin": pa.array([found[1]], pa.int32()), "left": pa.array([left.tolist()], pa.list_(pa.int64())),
                         "total": pa.array([hist[0].sum(0).tolist()], pa.list_(pa.int64()))})

    return run


def _shipped(tops, open_nodes, trees: list[int], seed: int, width: int):
    """A row for each tree and row of positive weight, at the node that is left to grow."""

    def run(batches):
        for batch in batches:
            x, keys = _matrix(batch.column("bins"), width), _numpy(batch, "key")
            for tree in trees:
                w = weights(keys, tree, seed)
                at = tops.value[tree].route(x)
                rows = np.flatnonzero((w > 0) & np.isin(at, open_nodes.value[tree]))
                if len(rows):
                    picked = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(rows), tree), pa.int32()), "root": pa.array(at[rows], pa.int64()),
                                                      "w": pa.array(w[rows], pa.int64()), "y": picked.column("y"), "bins": picked.column("bins")})

    return run


def _grow_piece(places, width: int, classes: int, seed: int, tries: int):
    def run(table: pa.Table) -> pa.Table:
        tree, root = table.column("tree")[0].as_py(), table.column("root")[0].as_py()
        x, y, w = _matrix(table.column("bins"), width), _numpy(table, "y"), _numpy(table, "w")
        got = grow(x, y.astype(np.int64), w, classes, seed, tree, places.value[tree][root], tries)
        return pa.Table.from_pylist([got.row(tree, root)], schema=_PIECE_ARROW)

    return run


_PIECE_ARROW = pa.schema([("tree", pa.int32()), ("root", pa.int64()), *[(c, pa.binary()) for c in ("feature", "bin", "left", "right", "value")], ("nodes", pa.int64())])


@dataclass
class Forest:
    """Bounds of the bins, and the table of pieces (``root`` -1: the upper part of a tree)."""

    edges: list[np.ndarray]
    classes: int
    pieces: DataFrame

    def score(self, df: DataFrame, features: str = "features", out: str = "probabilities", ship_bytes: int = SHIP_BYTES) -> DataFrame:
        """Rows with the mean class shares over all trees; null where the features are null or of another width."""
        size = self.pieces.agg(F.sum(F.col("nodes") * (16 + 8 * self.classes))).first()[0] or 0
        trees = self.pieces.select(F.count_distinct("tree")).first()[0]
        tops = {r["tree"]: Piece.of(r, self.classes) for r in self.pieces.where("root = -1").collect()}
        if size > ship_bytes:
            return self._score_by_groups(df, features, out, trees, tops, ship_bytes)
        held: dict[int, dict[int, Piece]] = {}
        for r in self.pieces.where("root >= 0").collect():
            held.setdefault(r["tree"], {})[r["root"]] = Piece.of(r, self.classes)
        width, classes = len(self.edges), self.classes
        shared = df.sparkSession.sparkContext.broadcast((self.edges, tops, held))

        def run(batches):
            edges, tops_, held_ = shared.value
            for batch in batches:
                x, good = kernels.to_matrix(batch.column(batch.schema.get_field_index(features)), width)
                b = binned(x, edges)
                total = np.zeros((len(b), classes))
                for tree in sorted({*tops_, *held_}):
                    _add_shares(total, b, tops_.get(tree), held_.get(tree, {}))
                yield pa.RecordBatch.from_arrays([*batch.columns, kernels.from_matrix(total / trees, good)], names=[*batch.schema.names, out])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))

    def _score_by_groups(self, df: DataFrame, features: str, out: str, trees: int, tops: dict[int, Piece], ship_bytes: int) -> DataFrame:
        spark, width, classes = df.sparkSession, len(self.edges), self.classes
        rows = materialise(df.withColumn("_forest_row", F.monotonically_increasing_id()), "forest-rows")
        n = rows.count()
        most = self.pieces.groupBy("tree").agg(F.sum("nodes").alias("nodes")).agg(F.max("nodes")).first()[0]
        room = max(1, min(MEET_BYTES, ship_bytes) // NODE_BYTES)
        per, parts = max(1, room // most), ceil(most / room)  # trees in a group, parts of a tree
        last = self.pieces.agg(F.max("tree")).first()[0]
        runs = max(1, ceil(n / parts * width / (MEET_BYTES // 2)))  # the rows of a group are dealt out
        shared = spark.sparkContext.broadcast((self.edges, tops))

        def send(batches):
            """A row for each group of trees, or for each tree and the part that holds its subtree."""
            edges, tops_ = shared.value
            for batch in batches:
                x, good = kernels.to_matrix(batch.column("x"), width)
                b, ids = binned(x, edges), _numpy(batch, "_forest_row")[good]
                bins = pa.array([r.tobytes() for r in b], pa.binary())
                for group in range(last // per + 1):
                    part = np.zeros(len(b), np.int64)
                    if parts > 1 and group in tops_:
                        at = tops_[group].route(b)
                        part = np.where(tops_[group].left[at] == -1, 0, at % parts)
                    yield pa.RecordBatch.from_pydict({
                        "_group": pa.array(np.full(len(b), group), pa.int32()), "_part": pa.array(part), "_run": pa.array(ids % runs),
                        "_forest_row": pa.array(ids), "bins": bins})

        def add(a: pa.Table, b: pa.Table) -> pa.Table:
            total, ids = np.zeros((a.num_rows, classes)), _numpy(a, "_forest_row")
            if a.num_rows:
                x, group, part = _matrix(a.column("bins"), width), a.column("_group")[0].as_py(), a.column("_part")[0].as_py()
                held: dict[int, dict[int, Piece]] = {}
                for i in range(b.num_rows):
                    r = {c: b.column(c)[i].as_py() for c in b.column_names}
                    held.setdefault(r["tree"], {})[r["root"]] = Packed.of(r, classes)
                for tree in range(group * per, (group + 1) * per):
                    _add_shares(total, x, shared.value[1].get(tree), held.pop(tree, {}))
            return pa.table({"_forest_row": ids, **{f"s{k}": total[:, k] for k in range(classes)}})

        schema = "_forest_row long, " + ", ".join(f"s{k} double" for k in range(classes))
        keys = ["_group", "_part", "_run"]
        sent = rows.select("_forest_row", F.col(features).alias("x")).mapInArrow(send, "_group int, _part long, _run long, _forest_row long, bins binary")
        packed = self.pieces.where("root >= 0").mapInArrow(_pack(classes), PACKED).select(
            "*", F.floor(F.col("tree") / per).cast("int").alias("_group"), F.pmod("root", F.lit(parts)).alias("_part"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))).alias("_run"))
        count = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        shares = sent.repartition(count, *keys).groupBy(*keys).cogroup(packed.repartition(count, *keys).groupBy(*keys)).applyInArrow(add, schema)
        whole = materialise(shares.groupBy("_forest_row").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(classes)]), "forest-shares")
        mean = F.when(F.col("s0").isNotNull(), F.array(*[F.col(f"s{k}") / F.lit(float(trees)) for k in range(classes)]))
        return rows.join(whole, "_forest_row", "left").select(*[F.col(f"`{c}`") for c in df.columns], mean.alias(out))

    def save(self, path: str) -> None:
        spark = self.pieces.sparkSession
        self.pieces.write.mode("overwrite").parquet(f"{path}/pieces")
        spark.createDataFrame([(j, e.tolist(), self.classes) for j, e in enumerate(self.edges)], "feature int, edges array<double>, classes int").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        rows = sorted(spark.read.parquet(f"{path}/edges").collect(), key=lambda r: r["feature"])
        return cls([np.array(r["edges"], float) for r in rows], rows[0]["classes"], spark.read.parquet(f"{path}/pieces"))


def fit_forest(df: DataFrame, width: int, classes: int | None = None, n_trees: int = 200, seed: int = 0, features: str = "features",
               label: str = "label", key: str | None = None, max_bins: int = 64, tries: int | None = None, local_rows: int = LOCAL_ROWS,
               ship_rows: int = SHIP_ROWS, sample: int = SAMPLE_ROWS) -> Forest:
    """Grow ``n_trees`` on the rows of ``df``; nulls, features of another width and labels outside the classes fail the job.

    ``key`` is a column that tells rows apart (else a hash of the row, and equal rows share their
    draws). A node looks at ``tries`` features (square root of their number). About ``sample`` rows, by hash,
    place the bounds of the bins (at most 256).
    """
    spark = df.sparkSession
    tries = tries or isqrt(width)
    hashed = F.xxhash64(F.col(features), F.col(label)) if key is None else F.xxhash64(F.col(key))
    y = F.coalesce(F.col(label).cast("int"), F.raise_error(F.lit("null label")).cast("int"))
    rows = df.select(hashed.alias("key"), F.col(features).alias("x"), y.alias("y"))
    n, top = rows.agg(F.count("*"), F.max("y")).first()
    if not n:
        raise ValueError("no rows to fit on")
    classes = classes or top + 1
    rows = rows.withColumn("y", F.when(F.col("y").between(0, classes - 1), F.col("y")).otherwise(F.raise_error(F.lit("label outside the classes")).cast("int")))
    drawn = rows if n <= sample else rows.where(F.pmod(F.xxhash64("key", F.lit(seed), F.lit(9)), F.lit(1 << 32)) < int(sample / n * (1 << 32)))
    matrix, good = kernels.to_matrix(drawn.select("x").toArrow().column("x").combine_chunks(), width)
    if not good.all():
        raise ValueError(f"features must be {width} numbers")
    edges = quantile_edges(matrix, min(256, max_bins))
    bins = max(len(e) for e in edges) + 1
    table = materialise(rows.mapInArrow(_binning(spark.sparkContext.broadcast(edges), width), "key long, y int, bins binary"), "binned")

    share = lambda value: spark.sparkContext.broadcast(value)
    tops = {t: Growth(classes) for t in range(n_trees)}
    places: dict[int, dict[int, int]] = {}
    for t, g in tops.items():
        g.add(np.zeros(classes, np.int64))
        places[t] = {0: _word(seed, t)}
    open_nodes = {t: [0] for t in tops}
    large = [(t, 0, 0) for t in tops] if n > local_rows else []  # (tree, node, features tried)
    per_pass = max(1, HIST_BYTES // (tries * bins * classes * 8))
    while large:
        now, large = large[:per_pass], large[per_pass:]
        chosen: dict[int, dict[int, np.ndarray]] = {}
        for t, node, tried in now:
            chosen.setdefault(t, {})[node] = np.sort(feature_orders(seed, t, np.array([places[t][node]], U64), width)[0, tried:tried + tries])
        arrays = share({t: Piece.of(tops[t].row(t, -1), classes) for t in chosen})
        parts = table.mapInArrow(_histograms(arrays, share(chosen), seed, width, bins, classes), "tree int, node long, salt long, hist binary")
        folded = parts.groupBy("tree", "node", "salt").applyInArrow(_fold, "tree int, node long, salt long, hist binary")
        splits = folded.groupBy("tree", "node").applyInArrow(_decide(bins, classes), "tree int, node long, slot int, bin int, left array<long>, total array<long>")
        found = {(r["tree"], r["node"]): r for r in splits.collect()}
        for t, node, tried in now:
            g, r = tops[t], found.get((t, node))
            open_nodes[t].remove(node)
            if r is None:
                continue
            total = np.array(r["total"])
            g.value[node] = total
            if np.count_nonzero(total) < 2:
                continue
            if total.sum() <= local_rows:
                open_nodes[t].append(node)  # fewer rows of this tree than thought
            elif r["slot"] < 0:
                if tried + tries < width:
                    open_nodes[t].append(node)
                    large.append((t, node, tried + tries))
            else:
                left = np.array(r["left"])
                sides = [g.add(left), g.add(total - left)]
                g.split(node, int(chosen[t][node][r["slot"]]), r["bin"], *sides)
                for i, (side, counts) in enumerate(zip(sides, (left, total - left))):
                    if np.count_nonzero(counts) < 2:
                        continue
                    places[t][side] = int(child_places(np.array([places[t][node]], U64), i)[0])
                    open_nodes[t].append(side)
                    if counts.sum() > local_rows:
                        large.append((t, side, 0))
    # A node that is left to grow hands its rows on: its upper part marks it, so that no leaf of its own counts.
    upper = [t for t in tops if len(tops[t].feature) > 1 or not open_nodes[t]]
    arrays, roots, starts = share({t: Piece.of(g.row(t, -1), classes) for t, g in tops.items()}), share(open_nodes), share(places)
    step = max(1, int(ship_rows // max(1, 0.64 * n)))
    pieces = None
    for lo in range(0, n_trees, step):
        trees = [t for t in range(lo, min(n_trees, lo + step)) if open_nodes[t]]
        if not trees:
            continue
        sent = table.mapInArrow(_shipped(arrays, roots, trees, seed, width), "tree int, root long, w long, y int, bins binary")
        part = materialise(sent.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "tree", "root").groupBy("tree", "root").applyInArrow(
            _grow_piece(starts, width, classes, seed, tries), PIECE), "pieces")
        pieces = part if pieces is None else pieces.unionByName(part)
    if upper:
        rows_ = []
        for t in upper:
            row = tops[t].row(t, -1)
            mark = np.frombuffer(row["left"], "<i4").copy()
            mark[open_nodes[t]] = -2
            rows_.append(row | {"left": mark.tobytes()})
        more = spark.createDataFrame(pa.Table.from_pylist(rows_, schema=_PIECE_ARROW))
        pieces = more if pieces is None else pieces.unionByName(more)
    return Forest(edges, classes, pieces)
