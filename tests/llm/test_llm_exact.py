"""Lexical search, Merkle manifest and URL filter against plain versions, whole results."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from spectrel.llm import lexical, merkle, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_merkle_manifest", "op13_url_filter"])
def test_query_and_sql(spark, name):
    result = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert result["ok"], result["why"]


def test_contract_columns(spark):
    kinds = lambda n: dict(queries.QUERIES[n](spark, SF).dtypes)
    assert kinds("op11_lexical_search") == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert kinds("op13_url_filter") == {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_rank(docs, items, k):
    docs = [(i, Counter(plain_terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, df = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    query = defaultdict(Counter)
    for i, t in items:
        query[i] += Counter(plain_terms(t))
    out = []
    for q, times in query.items():
        found = []
        for i, c, n in docs:
            m = 100 - 25 + 25 * n * len(docs) // total
            s = sum(x * floor(1000 * log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, x in times.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def search_docs():
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(60)] + ["Ünïcode", "x86", "日本", "B"]
    weights = 1 / np.arange(1, len(word) + 1)
    docs = [(i, " ".join(rng.choice(word, int(rng.integers(0, 80)), p=weights / weights.sum()))) for i in range(400)]
    docs += [(1_000 + i, "w5 w6 rare, copy-of Many") for i in range(300)]
    docs += [(7, "again w1"), (7, "again w1"), (None, "w5 rare"), (None, None), (8, ""), (9, "-- !!"), (10, "long " * 40_000 + "w9")]
    items = [(1, "W5 w6 RARE many w5"), (2, "日本 ünïcode Ünïcode b"), (3, "nothing-here"), (4, None), (5, "again again AGAIN"), (6, "w0"), (None, "rare w9 long"),
             (7, "w1"), (7, "w2 w2"), (8, " ".join(word))]
    return docs, items


@pytest.mark.parametrize("k,bucket,focus,seed,block_items,block_terms", [
    (20, 1_024, 8, 8_192, 1_024, 1 << 15), (5, 7, 1, 10, 3, 1 << 15), (20, 16, 2, 40, 100, 4), (400, 64, 3, 1, 1, 1)])
def test_search_against_all_scores(spark, k, bucket, focus, seed, block_items, block_terms):
    docs, items = search_docs()
    d = spark.createDataFrame([(*r, 0, 1) for r in docs], "doc_id long, text string, rank int, norm int").repartition(5)
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")
    got = lexical.rank(d, i, k, bucket, focus, seed, block_items, block_terms).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_rank(docs, items, k)


def test_search_of_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank(d, i).count() == lexical.rank(d.limit(0), i).count() == lexical.rank(i.select(F.col("item_id").alias("doc_id"), "text"), i.limit(0)).count() == 0
    same = lexical.rank(i.select(F.col("item_id").alias("doc_id"), "text"), i).collect()
    assert same == [] or [tuple(r) for r in same] == plain_rank([(1, "a b")], [(1, "a b")], 20)


def test_buckets_and_coordinates_prune():
    rng = np.random.default_rng(5)
    size, docs = 40, 600
    weights = rng.integers(1, 9_000, size)
    block = lexical.Block([{0: 1, 1: 2, 2: 1}, {5: 1}], weights, docs, docs * 30)
    chosen = [np.sort(rng.choice(size, int(rng.integers(1, 12)), replace=False)) for _ in range(docs)]
    terms, bounds = np.concatenate(chosen), np.append(0, np.cumsum(list(map(len, chosen))))
    tfs, n = rng.integers(1, 9, len(terms)), rng.integers(5, 60, docs)
    row, exact, value = block.vectors(terms, tfs, bounds, n)
    norm = np.sqrt(np.bincount(row, value ** 2, minlength=docs))
    search = lexical.Search(block, np.zeros(2, np.int64), 10, 2)
    order = np.argsort(-norm)
    for lo in range(0, docs, 50):
        o = order[lo:lo + 50]
        pick = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in o])
        search.bucket(o, np.zeros(len(o), bool), norm[o], n[o], terms[pick], tfs[pick], np.append(0, np.cumsum(bounds[o + 1] - bounds[o])))
    for q, times in enumerate(({0: 1, 1: 2, 2: 1}, {5: 1})):
        full = np.bincount(row, np.array([times.get(t, 0) for t in terms]) * exact, minlength=docs).astype(int)
        want = [i for i in np.lexsort((np.arange(docs), -full)) if full[i] > 0][:10]
        assert search.best[q][0].tolist() == want
    assert search.seen["focus"] < search.seen["bucket"] <= search.seen["pairs"] and search.seen["focus"] < 0.5 * search.seen["pairs"]


def test_a_term_that_shares_a_hash_is_told_apart(spark, monkeypatch):
    docs, items = [(1, "alpha beta"), (2, "alphx beta"), (3, "alpha alphx alpha"), (4, "gamma")], [(1, "alpha")]
    real = lexical.tb.range_hash
    # Terms alike but for the last byte get one hash.
    monkeypatch.setattr(lexical.tb, "range_hash", lambda sums, a, b: real(sums, a, np.maximum(a, b - 1)))
    assert len(lexical._hashes([b"alpha"])) == 1
    class Known:
        value = [b"alpha"]
    import pyarrow as pa
    batch = pa.record_batch({"row": pa.array(range(4), pa.int64()), "doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs]})
    out = pa.Table.from_batches(lexical._counts(Known)(iter([batch])))
    tfs = [np.frombuffer(x, "<i8").tolist() for x in out["tfs"].to_pylist()]
    assert tfs[0] == [1] and tfs[3] == [] and out["n"].to_pylist() == [2, 2, 3, 1]


# ---- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fan):
    """Levels of a tree, and of every node its siblings from below upwards as (left, right)."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a // fan * fan
            steps[i].append(("".join(nodes[lo:a]), "".join(nodes[a + 1:lo + fan])))
        nodes = [sha(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
        at = [a // fan for a in at]
    return nodes[0], steps


def plain_manifest(rows, fan):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]], fan)
    root, upper = plain_tree([trees[s][0] for s in order], fan)
    out = []
    for s, above in zip(order, upper):
        for r, steps in zip(by[s], trees[s][1]):
            path = steps + above
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = plain_leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for left, right in path:
                h = sha(left, h, right)
            out.append((r[0], plain_leaf(r), trees[s][0], root, sha(*(a + b for a, b in path)), h, h == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fan,partitions", [(3, 8), (2, 3), (5, 1)])
def test_manifest_against_plain_trees(spark, fan, partitions):
    rows = [(i, "big", "en", i, f"line {i}\nnext\n") for i in range(250)] + [(i, f"s{i % 7}é", None, None, "x" * i) for i in range(60)]
    rows += [(None, "big", None, None, None)] * 4 + [(5, "big", "en", 5, "line 5\nnext\n")] * 30 + [(5, "big", "en", 5, "other\n")]
    rows += [(1, None, "de", 3, "a\nb"), (900, "", "de", 0, ""), (901, "lone", "", -1, "\n" * 50_000), (-4, None, "fr", 2**40, "日本\n語")]
    d = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", tree string, slot int").repartition(partitions)
    got = merkle.manifest(d, F.expr(merkle.TAMPERED), F.replace(F.col("text"), F.lit("\n"), F.lit("")), fanout=fan)
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), "folded_root", "verified").collect()
    want = plain_manifest(rows, fan)
    assert sorted([tuple(r) for r in got], key=repr) == want and {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "a", "x", 1, "t")], [(1, None, None, None, None), (2, "b", "x", 1, "u\n")], [(i, None, "x", 1, "t") for i in range(28)]])
def test_manifest_of_few_rows(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [r[:4] for r in plain_manifest(rows, 3)] if rows else []
    assert sorted([tuple(r)[:4] for r in got], key=repr) == want and all(r.verified for r in got)


def test_rows_of_one_id_are_dealt_out(spark):
    d = spark.range(0, 40_000, 1, 8).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one' AS source", "'x' AS lang", "CAST(1 AS LONG) AS n_chars", "'same' AS text")
    rows = merkle.numbered(d.select(F.col("source").alias("tree"), "doc_id"), ["tree"], ["doc_id"], "t")
    assert rows.agg(F.count_distinct("slot"), F.min("slot"), F.max("slot"), F.min("n")).first() == (40_000, 0, 39_999, 40_000)


# ---- URL filter

def plain_judge(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


URLS = [None, "", "no scheme", "http://", "://x.org/a", "HTTP://Example.ORG/es/1?x=/y#z", "http://a.b.example.org/en/17#f", "http://example.org/en/2", "http://notexample.org/es/",
        "http://example.org?q=1", "http://org/", "http://.org/", "http://x.com/fr/1://y", "http://x.com/de/", "http://x.com/de", "ftp://é.com/fr/ü", "http://h/a\nb/c", "http://x..org//",
        "http://X.Com:80/fr/", "http://x.org/" + "p/" * 50_000]


@pytest.mark.parametrize("bits", [url_filter.MAX_BITS, 3_000])
def test_judge_against_every_rule(spark, bits):
    rng = np.random.default_rng(2)
    urls = [*URLS, *URLS] + [f"http://{rng.choice(['www.', 'm.', ''])}h{rng.integers(300)}.{rng.choice(['com', 'org'])}/{rng.choice(['a', 'bb', ''])}{rng.integers(40)}" for _ in range(3_000)]
    rules = [*queries.URL_RULES, ("", "/", "block"), (None, "/", "block"), ("x.org", None, "block"), ("example.org", "/en/1", "block"), ("h7.org", "/a", "allow"), ("h7.org", "/a", "block")]
    rules += [(f"h{i}.{t}", p, str(rng.choice(["allow", "block"]))) for i in range(0, 300, 2) for t in ("com", "org") for p in ("", "/", "/a", "/bb1")]
    conflicts = {(h, p) for h, p, v in rules if v == "block"}
    d = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, keys string").repartition(4)
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(d, r, max_bits=bits).collect()}
    sound = [(h, p, v) for h, p, v in rules if v == "block" or (h, p) not in conflicts]
    assert got == {i: plain_judge(u, sound) for i, u in enumerate(urls)}


def test_judge_of_nothing(spark):
    d = spark.createDataFrame([(1, "http://a.org/"), (None, None)], "page_id long, url string")
    r = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(x.rule, x.verdict) for x in url_filter.judge(d, r, default="block").collect()} == {(None, "block")}
    assert url_filter.judge(d.limit(0), r).count() == 0


def test_cascade_is_exact_and_small(spark):
    keys = spark.range(0, 200_000, 1, 4).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), (F.col("id") % 97 == 0).alias("listed"))
    cascade = url_filter.build(keys)
    rows = keys.toPandas()
    h1, h2 = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    assert (url_filter.member(h1, h2, cascade) == rows.listed.to_numpy()).all() and len(cascade) > 2
    n, m = int(rows.listed.sum()), len(rows)
    assert sum(b for b, *_ in cascade) < n * (1.45 * np.log2(m / n) + 16)
    with pytest.raises(ValueError):
        url_filter.build(spark.createDataFrame([(1, 1, True), (1, 1, False)], "h1 long, h2 long, listed boolean"))
