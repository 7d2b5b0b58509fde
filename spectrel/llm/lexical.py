"""Ranked lexical search with norm buckets (LEMP): the best documents for every query text, exactly.

A document's impact vector has, for each term it holds, weight x saturated frequency; a query's vector has
the repeats of its terms, and the score is their inner product, in integers. Queries are taken in blocks
of at most ``block_terms`` distinct terms, and vectors are kept over the terms of a block only, so they are
bounded, and shorter, which makes the bounds below closer.

1. Texts are cut into terms as bytes, in numpy; what is written is each document's length and term counts.
2. Document frequencies and totals over all documents give weights and lengths (norms) of the vectors.
3. Vectors are sorted by norm over the cluster and cut in buckets of ``bucket`` rows.
4. The longest ``seed`` vectors are searched first: the k-th best score of each query is its threshold, and
   vectors too short for all queries are not read again.
5. Every task walks its buckets in order. By Cauchy-Schwarz a query leaves out a bucket whose longest
   vector cannot reach the threshold. Inside, the ``focus`` heaviest coordinates of the query bound each
   vector (their products plus the product of what is left of both norms). Survivors are scored
   exactly in 64-bit integers and raise the threshold of the task.
6. The best of all tasks are ranked in two steps, first inside salts.

Bounds are taken in doubles with a slack of 1e-9, far above their error, and never decide a score. Terms are looked
up by a 64-bit hash; one occurrence in each run of a megabyte is compared byte by byte. A weight is split evenly (square roots) between both
vectors for the norms; any split gives the same products.

Rows: a null or empty text has no terms and is not counted. Repeated rows, and rows of one id, are documents
of their own; equal scores rank by id, null ids last. Query rows of one id are one query with all their terms; a null id is
an id. Queries without terms found, and an empty table, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import textbytes as tb

BUCKET = 1_024
FOCUS = 8
SEED_ROWS = 8_192
BLOCK_TERMS = 1 << 15
BLOCK_ITEMS = 1_024
SALTS = 64
SLACK = 1 + 1e-9

#: Bytes between terms: all of ASCII but digits and letters.
GAPS = np.zeros(256, bool)
GAPS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNT_SCHEMA = "row long, doc_id long, n long, terms binary, tfs binary"
VECTOR_SCHEMA = "row long, doc_id long, n long, terms binary, tfs binary, norm double"
FOUND_SCHEMA = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = tb.words(data, np.array([0, len(data)]), GAPS)
    low = _LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _hashes(terms: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(terms), np.uint8)
    ends = np.cumsum([len(t) for t in terms])
    return tb.range_hash(tb.prefix_sums(data), np.append(0, ends[:-1]), ends) if terms else np.zeros(0, np.uint64)


def _counts(vocabulary):
    """Length, and counts of the vocabulary's terms, of every document with a term."""
    def run(batches):
        terms = vocabulary.value
        hashes = _hashes(terms)
        order = np.argsort(hashes)
        hashes = hashes[order]
        for batch, data, offsets in tb.text_runs(batches):
            starts, ends, rows = tb.words(data, offsets, GAPS)
            length = np.bincount(rows, minlength=batch.num_rows)
            h = tb.range_hash(tb.prefix_sums(data, lower=True), starts, ends)
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            hit = np.flatnonzero(hashes[at] == h) if len(hashes) else np.zeros(0, np.int64)
            term = order[at[hit]] if len(hit) else hit
            word = lambda i: _LOWER[data[starts[i]:ends[i]]].tobytes()
            for t, first in [(t, hit[i]) for t, i in zip(*np.unique(term, return_index=True))]:
                if word(first) != terms[t]:
                    same = np.array([u != t or word(i) == terms[t] for i, u in zip(hit, term)])
                    hit, term = hit[same], term[same]
            code, tf = np.unique(rows[hit].astype(np.int64) * len(terms) + term, return_counts=True)
            row, term = code // max(1, len(terms)), code % max(1, len(terms))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            t, f = term.astype("<i4").tobytes(), tf.astype("<i8").tobytes()
            keep = np.flatnonzero(length)
            yield pa.record_batch({
                "row": batch.column(0).take(pa.array(keep)), "doc_id": batch.column(1).take(pa.array(keep)), "n": pa.array(length[keep], pa.int64()),
                "terms": pa.array([t[4 * cut[i]:4 * cut[i + 1]] for i in keep], pa.binary()),
                "tfs": pa.array([f[8 * cut[i]:8 * cut[i + 1]] for i in keep], pa.binary())})

    return run


def _ragged(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and the bounds of its rows."""
    data, offsets = tb.buffers(column)
    kind = np.dtype(kind)
    return np.frombuffer(data.tobytes(), kind), offsets // kind.itemsize


def _frequencies(size: int):
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            terms, _ = _ragged(batch.column("terms"), "<i4")
            df += np.bincount(terms, minlength=size)
        at = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(at, pa.int64()), "df": pa.array(df[at], pa.int64())})

    return run


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer share of a term in a document's score, for each repeat in the query."""
    return w * ((1_000_000_000 * tf) // (1_000 * tf + 12 * m))


def scale(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 100 - 25 + (25 * n * documents) // total


class Block:
    """Queries of one block: terms, weights and vectors; shipped to every task."""

    def __init__(self, items: list[dict[int, int]], weights: np.ndarray, documents: int, total: int):
        self.weights, self.documents, self.total = weights, documents, total
        self.root = np.sqrt(weights.astype(float))
        self.items = []
        for counts in items:
            term = np.fromiter(counts.keys(), np.int64, len(counts))
            times = np.fromiter(counts.values(), np.int64, len(counts))
            term, times = term[weights[term] > 0], times[weights[term] > 0]
            heavy = np.argsort(-times * self.root[term], kind="stable")
            self.items.append((term[heavy], times[heavy], times[heavy] * self.root[term[heavy]]))
        self.norms = np.array([np.sqrt((q ** 2).sum()) for _, _, q in self.items])

    def vectors(self, terms: np.ndarray, tfs: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, exact impacts and coordinates of ragged term counts."""
        row = np.repeat(np.arange(len(n)), np.diff(bounds))
        exact = impacts(self.weights[terms], tfs, scale(n, self.documents, self.total)[row])
        root = self.root[terms]
        return row, exact, np.divide(exact, root, out=np.zeros(len(root)), where=root > 0)


def _norms(block):
    def run(batches):
        b = block.value
        for batch in batches:
            terms, bounds = _ragged(batch.column("terms"), "<i4")
            tfs, _ = _ragged(batch.column("tfs"), "<i8")
            row, _, value = b.vectors(terms, tfs, bounds, batch.column("n").to_numpy())
            norm = np.sqrt(np.bincount(row, value ** 2, minlength=batch.num_rows))
            yield pa.record_batch([*batch.columns, pa.array(norm)], names=[*batch.schema.names, "norm"])

    return run


def best_of(ids: np.ndarray, missing: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best by score, then id, null ids last."""
    return np.lexsort((ids, missing, -score))[:k]


class Search:
    """A task's walk through norm buckets, with the best of each query so far."""

    def __init__(self, block: Block, thresholds: np.ndarray, k: int, focus: int):
        self.block, self.k, self.focus = block, k, focus
        self.least = thresholds.copy()  # a score that k documents reach; equal ones may still rank by id
        none = np.zeros(0, np.int64)
        self.best = [(none, none.astype(bool), none) for _ in block.items]
        self.seen = {"pairs": 0, "bucket": 0, "focus": 0}

    def bucket(self, ids, missing, norm, n, terms, tfs, bounds) -> None:
        b, rows = self.block, len(n)
        near = np.flatnonzero((b.norms * norm.max() * SLACK >= self.least) & (b.norms > 0))
        self.seen["pairs"] += rows * len(b.items)
        self.seen["bucket"] += rows * len(near)
        if not len(near):
            return
        row, exact, value = b.vectors(terms, tfs, bounds, n)
        order = np.argsort(terms, kind="stable")
        row, exact, value = row[order], exact[order], value[order]
        cut = np.searchsorted(terms[order], np.arange(len(b.weights) + 1))
        square = norm ** 2
        for q in near:
            term, times, weight_ = b.items[q]
            product, taken = np.zeros(rows), np.zeros(rows)
            for t, x in zip(term[:self.focus], weight_[:self.focus]):
                at = slice(cut[t], cut[t + 1])
                product[row[at]] += x * value[at]
                taken[row[at]] += value[at] ** 2
            rest = np.sqrt((weight_[self.focus:] ** 2).sum())
            bound = product + rest * np.sqrt(np.maximum(square - taken, 0) + 1e-9 * square)
            keep = bound * SLACK + 1e-6 >= max(self.least[q], 1)
            alive = np.flatnonzero(keep)
            self.seen["focus"] += len(alive)
            if not len(alive):
                continue
            score = np.zeros(rows, np.int64)
            for t, times_ in zip(term, times):
                at = slice(cut[t], cut[t + 1])
                r = row[at]
                mine = keep[r]
                score[r[mine]] += times_ * exact[at][mine]
            alive = alive[score[alive] >= max(self.least[q], 1)]
            if len(alive):
                old = self.best[q]
                i, none, s = np.append(old[0], ids[alive]), np.append(old[1], missing[alive]), np.append(old[2], score[alive])
                top = best_of(i, none, s, self.k)
                self.best[q] = i[top], none[top], s[top]
                if len(top) == self.k:
                    self.least[q] = max(self.least[q], s[top[-1]])

    def found(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.best)), [len(i) for i, _, _ in self.best])
        ids, missing, score = (np.concatenate([x[j] for x in self.best]) for j in range(3))
        return pa.record_batch({"item": pa.array(item, pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=missing), "score": pa.array(score, pa.int64())})


def _walk(block, thresholds: np.ndarray, k: int, bucket: int, focus: int):
    def run(batches):
        search = Search(block.value, thresholds, k, focus)
        for batch in batches:
            for lo in range(0, batch.num_rows, bucket):
                part = batch.slice(lo, bucket)
                terms, bounds = _ragged(part.column("terms"), "<i4")
                tfs, _ = _ragged(part.column("tfs"), "<i8")
                doc = part.column("doc_id")
                search.bucket(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), part.column("norm").to_numpy(),
                              part.column("n").to_numpy(), terms, tfs, bounds)
        yield search.found()

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """Rank 1 to ``k`` of every item; salts first, so that no task sorts the finds of all tasks."""
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score", F.spark_partition_id()), F.lit(SALTS)))
    near = salted.withColumn("nth", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*by))).where(F.col("nth") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _blocks(items: DataFrame, max_items: int, max_terms: int):
    """Runs of (item_id, {term: repeats}) with at most so many items and distinct terms (one item may hold more)."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select("item_id", F.explode(F.split(text, gap)).alias("term")).where("term <> ''").groupBy("item_id", "term").agg(F.count("*").alias("times"))
    block, vocabulary, last = {}, set(), object()
    for r in terms.orderBy("item_id", "term").toLocalIterator():
        if r.item_id != last and block and (len(block) >= max_items or len(vocabulary) >= max_terms):
            yield block
            block, vocabulary = {}, set()
        last = r.item_id
        block.setdefault(last, {})[r.term.encode()] = r.times
        vocabulary.add(r.term.encode())
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = 20, bucket: int = BUCKET, focus: int = FOCUS, seed: int = SEED_ROWS,
         block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs`` for every item of ``items`` (item_id, text)."""
    spark, out = docs.sparkSession, None
    for queries in _blocks(items, block_items, block_terms):
        part = _rank_block(docs, list(queries.values()), k, bucket, focus, seed)
        if part is None:
            continue
        named = part.withColumn("item_id", F.element_at(F.array(*[F.lit(i).cast("long") for i in queries]), F.col("item") + 1))
        out = named if out is None else out.unionByName(named)
    if out is None:
        out = spark.createDataFrame([], "item int, rank int, doc_id long, score long, item_id long")
    return out.select(F.col("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _rank_block(docs: DataFrame, queries: list[dict[bytes, int]], k: int, bucket: int, focus: int, seed: int) -> DataFrame | None:
    sc = docs.sparkSession.sparkContext
    vocabulary = sorted({t for q in queries for t in q})
    place = {t: i for i, t in enumerate(vocabulary)}
    rows = tb.text_rows(docs.withColumn("row", F.monotonically_increasing_id()), "row", "doc_id")
    rows = rows.withColumn("row", F.col("row").cast("long"))
    counts = materialise(rows.mapInArrow(_counts(sc.broadcast(vocabulary)), COUNT_SCHEMA), "terms")
    documents, total = counts.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.where("octet_length(terms) > 0").mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df
    weights = np.array([weight(documents, d) for d in df.tolist()], np.int64)
    block = sc.broadcast(Block([{place[t]: n for t, n in q.items()} for q in queries], weights, documents, total))
    by = [F.col("norm").desc(), F.col("row")]
    vectors = counts.where("octet_length(terms) > 0").mapInArrow(_norms(block), VECTOR_SCHEMA).where("norm > 0")
    vectors = materialise(vectors.repartitionByRange(*by).sortWithinPartitions(*by), "vectors")
    walk = lambda rows, least: _top(rows.mapInArrow(_walk(block, least, k, bucket, focus), FOUND_SCHEMA), k)
    least = np.zeros(len(queries), np.int64)
    cut = vectors.agg(F.percentile_approx("norm", max(0.0, 1 - seed / documents), 10_000)).first()[0]
    if cut is None:
        return None
    for r in walk(vectors.where(F.col("norm") >= cut), least).where(F.col("rank") == k).collect():
        least[r.item] = r.score
    norms = block.value.norms
    reach = min((x / (q * SLACK) for x, q in zip(least.tolist(), norms.tolist()) if q > 0), default=0.0)
    return walk(vectors.where(F.col("norm") >= reach * (1 - 1e-9)), least)


#: Rows of the query on DuckDB.
RANK_SQL = r"""
WITH terms AS (SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS row FROM documents)),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
tf AS (SELECT doc_id, row, term, count(*) AS tf FROM terms GROUP BY ALL),
docs AS (SELECT doc_id, row, count(*) AS n FROM terms GROUP BY ALL),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
scores AS (SELECT item_id, row, d.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN docs d USING (row), total GROUP BY item_id, row, d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
