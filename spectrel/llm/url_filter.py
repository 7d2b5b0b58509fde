"""URL rules by a Bloom filter cascade: exact membership of every key that the corpus holds, without joins.

A rule is (host, path, verdict); it fits its host and all subdomains where the path of the URL starts with
the rule's, and the longest one wins. Its key is host and path concatenated. The keys that a URL could be
listed under are few: for each shape of a rule (labels of the host, characters of the path) one. The
distinct ones of all URLs are the key universe.

The cascade over a universe: level 0 is a Bloom filter of the listed keys, level 1 one of the unlisted keys
that level 0 lets through, level 2 one of the listed keys that level 1 lets through, and so on until no key
is left. The first level that stops a key tells whether it is listed, and that is exact for the universe.
Level 0 has log2(unlisted / listed) hashes, so that the levels together take a number of bits in proportion
to the listed keys and not to the corpus.

Size: filters are shipped to every task only up to ``max_bits``. Larger lists are cut in segments by the
key's hash; rows pass the segments one after the other, each with filters of at most that size.

Rows: a null URL, or one without ``://``, has an empty host and path, and only the default verdict. Rules with a
null or empty host or a null path fit nothing; a key listed under both verdicts blocks. Repeated rows and
rules, and other columns, do not matter.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import textbytes as tb

U64 = np.uint64
MAX_BITS = 1 << 27
VERDICTS = ("allow", "block")
MAX_LEVELS = 64

#: A level: its number of bits, its hashes and the bits as 64-bit words.
Level = tuple[int, int, np.ndarray]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path, before any ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys that a URL could be listed under, longest first (ties: longer host), as structs (key, h1, h2)."""
    labels = F.split(host, r"\.")
    each = []
    for n, chars in shapes:
        key = F.concat(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n, F.lit(0)) + 1, n), "."), F.substring(path, 1, chars))
        fits = (F.size(labels) >= n) & (F.char_length(path) >= chars) & (F.char_length(host) > 0)
        each.append(F.when(fits, F.struct((-F.char_length(key)).alias("order"), (F.lit(chars)).alias("tail"), key.alias("key"))))
    some = F.array_sort(F.filter(F.array(*each), lambda c: c.isNotNull())) if each else F.expr("array()").cast("array<struct<order:int,tail:int,key:string>>")
    return F.transform(some, lambda c: F.struct(c["key"].alias("key"), *_hashes(c["key"])))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, j: int, bits: int) -> np.ndarray:
    """The place of every key under hash ``j`` of a level."""
    salt = U64((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
    a, b = tb.mixed(h1 ^ salt), tb.mixed(h2 + salt) | U64(1)
    return (a + U64(j) * b) % U64(bits)


def passes(h1: np.ndarray, h2: np.ndarray, no: int, level: Level) -> np.ndarray:
    bits, hashes, words = level
    out = np.ones(len(h1), bool)
    for j in range(hashes):
        at = positions(h1, h2, no, j, bits)
        out &= (words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)
    return out


def member(h1: np.ndarray, h2: np.ndarray, cascade: list[Level]) -> np.ndarray:
    """Whether each key of the universe is listed."""
    listed = np.zeros(len(h1), bool)
    alive = np.arange(len(h1))
    for no, level in enumerate(cascade):
        through = passes(h1[alive], h2[alive], no, level)
        listed[alive[~through]] = no % 2 == 1
        alive = alive[through]
    listed[alive] = len(cascade) % 2 == 1
    return listed


def _keys(batch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).view(U64) for c in ("h1", "h2"))


def _set_bits(no: int, bits: int, hashes: int):
    def run(batches):
        for batch in batches:
            h1, h2 = _keys(batch)
            at = np.unique(np.concatenate([positions(h1, h2, no, j, bits) for j in range(hashes)]))
            word, first = np.unique(at >> U64(6), return_index=True)
            value = np.bitwise_or.reduceat(U64(1) << (at & U64(63)), first) if len(at) else at
            yield pa.record_batch({"word": word.astype(np.int64), "bits": value.view(np.int64)})

    return run


def _survivors(no: int, level):
    def run(batches):
        for batch in batches:
            h1, h2 = _keys(batch)
            yield batch.filter(pa.array(passes(h1, h2, no, level.value)))

    return run


def build(universe: DataFrame) -> list[Level]:
    """The cascade of a table (h1, h2, listed); two keys of one 128-bit hash, one listed, are refused."""
    spark = universe.sparkSession
    left, cascade, width = universe.select("h1", "h2", "listed"), [], 0
    while len(cascade) < MAX_LEVELS:
        no = len(cascade)
        count = {r.listed: r.n for r in left.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        mine, other = (count.get(x, 0) for x in (no % 2 == 0, no % 2 == 1))
        if not mine:
            return cascade
        hashes = max(1, ceil(log2(max(2.0, other / mine))))
        bits = 64 * ceil(max(64.0, 1.45 * hashes * mine) / 64)
        rows = left.where(F.col("listed") == (no % 2 == 0)).select("h1", "h2")
        found = rows.mapInArrow(_set_bits(no, bits, hashes), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        cascade.append((bits, hashes, words.view(U64)))
        # The level's own keys all pass; of the others those that are let through remain.
        left = materialise(left.mapInArrow(_survivors(no, spark.sparkContext.broadcast(cascade[-1])), left.schema), "cascade")
        width += bits
    raise ValueError("a listed and an unlisted key share their 128-bit hash")


def _judge(segment: int, segments: int, cascades, names):
    def run(batches):
        known = cascades.value
        for batch in batches:
            keys = batch.column("keys")
            size = np.diff(keys.offsets.to_numpy())
            flat = keys.flatten()
            h1, h2 = (flat.field(c).to_numpy(zero_copy_only=False).view(U64) for c in ("h1", "h2"))
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            here = h1 % U64(segments) == U64(segment)
            best = batch.column("place").to_numpy(zero_copy_only=False).copy()
            verdict = batch.column("listed").to_numpy(zero_copy_only=False).copy()
            for v, cascade in enumerate(known):
                hit = np.flatnonzero(here)[member(h1[here], h2[here], cascade)]
                r, first = np.unique(row[hit], return_index=True)  # a row's keys stand longest first
                closer = place[hit[first]] <= best[r]
                best[r[closer]], verdict[r[closer]] = place[hit[first]][closer], v
            columns = {n: batch.column(n) for n in names} | {"place": pa.array(best, pa.int32()), "listed": pa.array(verdict, pa.int32())}
            yield pa.record_batch([columns[n] for n in batch.schema.names], names=batch.schema.names)

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row per page; ``rules`` is (host, path, verdict).

    The shapes of the rules are a few hundred at most in any list of host names and path beginnings: their
    number is bounded by labels x path lengths, whatever the number of rules.
    """
    sound = rules.where("host <> '' AND path IS NOT NULL").where(F.col("verdict").isin(*VERDICTS))
    named = sound.select(F.concat("host", "path").alias("key"), (F.col("verdict") == "block").alias("block"),
                         F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("chars"))
    shapes = sorted((r.labels, r.chars) for r in named.select("labels", "chars").distinct().collect())
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = materialise(rows.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
                       .select("*", F.lit(2**31 - 1).alias("place"), F.lit(-1).alias("listed")), "urls")
    met = rows.select(F.explode("keys").alias("k")).select("k.key", F.lit(True).alias("met"), F.lit(False).alias("allow"), F.lit(False).alias("block"))
    universe = met.unionByName(named.select("key", F.lit(False).alias("met"), (~F.col("block")).alias("allow"), "block"))
    universe = universe.groupBy("key").agg(*[F.max(c).alias(c) for c in ("met", "allow", "block")]).where("met")
    universe = materialise(universe.select(*_hashes(F.col("key")), "allow", "block"), "universe")
    total = universe.agg(F.count("*").alias("n"), *[F.count_if(F.col(v)).alias(v) for v in VERDICTS]).first()
    need = sum(total[v] * (1.45 * log2(max(2.0, total["n"] / total[v])) + 16) for v in VERDICTS if total[v])
    segments = max(1, ceil(need / max_bits))
    spark, names = pages.sparkSession, ["page_id", "host", "path", "keys"]
    for s in range(segments):
        part = universe.where(F.expr(f"CAST(CAST(h1 AS DECIMAL(20,0)) + CASE WHEN h1 < 0 THEN 18446744073709551616 ELSE 0 END AS DECIMAL(20,0)) % {segments} = {s}")) if segments > 1 else universe
        cascades = [build(part.select("h1", "h2", F.col(v).alias("listed"))) for v in VERDICTS]
        rows = rows.mapInArrow(_judge(s, segments, spark.sparkContext.broadcast(cascades), names), rows.schema)
        if s + 1 < segments:
            rows = materialise(rows, "judged")
    return rows.select(
        "page_id", "host", "path", F.when(F.col("listed") >= 0, F.col("keys")[F.col("place")]["key"]).alias("rule"),
        F.coalesce(*[F.when(F.col("listed") == v, name) for v, name in enumerate(VERDICTS)], F.lit(default)).alias("verdict"))


def judge_sql(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    """The rows of :func:`judge` on DuckDB, rule by rule, the longest first."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), len(r[1])))
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    case = lambda pick, rest: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {pick(h, p, v)}" for h, p, v in order) + f" ELSE {rest} END"
    rule, verdict = case(lambda h, p, v: f"'{h}{p}'", "NULL"), case(lambda h, p, v: f"'{v}'", f"'{default}'")
    return f"""
    WITH rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest)
    SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM parts"""
