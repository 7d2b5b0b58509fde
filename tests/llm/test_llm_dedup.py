"""Suffix, SimHash and embedding dedup against brute force, and their edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from spectrel.llm import embed_dedup, simhash, suffix_dedup
from spectrel.llm.components import components

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# ---- suffix arrays

def removed(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[i:i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for doc, t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1:
                mark[i:i + 200] = b"\1" * 200
        spans = [m.span() for m in re.finditer(b"\1+", bytes(mark))]
        out.append((doc, len(t), bytes(b for b, x in zip(t, mark) if not x), spans))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in df.collect()), key=repr)


def suffix_rows():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdé fgh"), n))
    shared, line = word(450), word(205)
    rows = [(1, word(900)), (2, word(100) + shared + word(70)), (3, word(33) + shared + word(500) + shared[:230]), (4, None), (5, ""),
            (6, "x" * 5_000), (7, word(199)), (8, word(199)), (9, shared), (9, shared), (None, word(50) + line), (10, line + word(80) + line)]
    return rows + [(20 + i, word(rng.integers(0, 90)) + line + word(rng.integers(0, 90))) for i in range(30)]


@pytest.mark.parametrize("kw", [{}, {"hot": 3, "batch": 5}, {"chunk_bytes": 600}, {"hot": 1, "chunk_bytes": 700, "batch": 1}])
def test_suffixes_match_brute_force(spark, kw):
    rows = suffix_rows()
    assert found(suffix_dedup.remove_repeats(docs_of(spark, rows).repartition(3), **kw)) == removed(rows)


def test_suffixes_of_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(suffix_dedup.remove_repeats(d)) == removed([(r.doc_id, r.text) for r in d.collect()])


def test_suffixes_edge_tables(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    d = docs_of(spark, [(1, "a" * 300, 5, "k")], ", chunk_id long, bucket string")
    assert found(suffix_dedup.remove_repeats(d)) == removed([(1, "a" * 300)])


def test_cover_and_suffix_order():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.tile(rng.integers(97, 99, 70), 20), rng.integers(97, 99, 500)]).astype(np.uint8)
    n = len(text)
    padded = np.concatenate([text, np.zeros(600, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    starts = np.arange(n)
    order = suffix_dedup.suffix_order(words, starts, n)
    keys = [padded[i:i + 256].tobytes() for i in order]
    assert sorted(order.tolist()) == starts.tolist() and keys == sorted(keys)


# ---- SimHash

def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def closure(n, linked, ids):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"cap": 2}, {"blocks": 7}])
def test_simhash_matches_brute_force(spark, kw):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9_001, None), (9_002, ""), (9_003, " \t\n"), (9_004, "one two"), (9_004, "ONE  two"), (None, rows[0][1]), (9_005, "w " * 50_000)]
    f = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    linked = [(i, i + 1 + j) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= 4)]
    want = sorted(zip([i for i, _ in rows], f.tolist(), closure(len(rows), linked, [i for i, _ in rows])), key=repr)
    d = docs_of(spark, [(*r, 1, 2) for r in rows], ", fp int, component_id int")
    got = sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.near_duplicates(d, **kw).collect()), key=repr)
    assert got == want


def test_close_fingerprints_all_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False)) for b in base for _ in range(12)]
    f = np.unique(np.array(near, np.uint64))
    want = [(i, i + 1 + j) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= 4)]
    ids = f.view(np.int64).tolist()
    for cap in (2_048, 3):
        edges = simhash.fingerprint_links(spark.createDataFrame([(i,) for i in ids], "fp long"), cap=cap)
        got = {r.node: r.root for r in components(edges).collect()}
        # The same partition: two ids share a root exactly if the closure joins them.
        root = closure(len(f), want, ids)
        mine = [got.get(i, i) for i in ids]
        assert len(set(zip(root, mine))) == len(set(root)) == len(set(mine))


def test_one_of_each(spark):
    rows = [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 3), (2, "something else entirely", 4), (None, "a b c d e f", 5)]
    kept = simhash.one_of_each(docs_of(spark, rows, ", n int"))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, None] and kept.columns == ["doc_id", "text", "n"]
    assert simhash.one_of_each(docs_of(spark, [])).count() == 0


def test_every_component_keeps_a_row_of_its_own(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [r for i in range(10) for r in ((2 * i + 1, text(2 * i + 1)), (2 * i, text(2 * i)), (2 * i + 1, text(2 * i)))]
    rows += [(100, text(k)) for k in range(50, 55)] * 2 + [(101, text(50)), (102, None), (102, "")]
    got = sorted((r.doc_id, r.text or "") for r in simhash.one_of_each(docs_of(spark, rows).repartition(4)).collect())
    assert got == sorted([(i, text(i)) for i in range(20)] + [(100, text(k)) for k in range(50, 55)] + [(102, "")])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 3), (7, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- embeddings

@pytest.mark.parametrize("cap", [1_024, 4])
def test_embedding_links(spark, cap):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((20, 24))
    x = [c + rng.standard_normal(24) * s for c in centre for s in (0, 0, 0.1, 0.2, 0.3, 0.3)]
    rows = [(i, v.tolist(), int(i % 3 > 0)) for i, v in enumerate(x)]
    n = len(rows)
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] + [1.0] * 23, 1), (903, [None] + [1.0] * 23, 1), (904, [], 1),
           (905, rows[0][1], None), (906, rows[1][1], None), (907, [float("inf")] * 24, 1), (908, rows[0][1][:10], 1)]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = closure(n, list(zip(*np.nonzero(near))), list(range(n)))
    want = [(i, int(near[i].sum()), root[i], root[i] == i) for i in range(n)] + [(r[0], 0, r[0], True) for r in odd]
    d = spark.createDataFrame([(*r, 0, 0) for r in rows + odd], "vec_id long, embedding array<double>, label int, n long, k1 int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(d, cap=cap).collect())
    assert got == want
    assert embed_dedup.near_vectors(d.limit(0)).count() == 0
