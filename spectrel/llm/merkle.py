"""Merkle manifest of a table: a tree of digests per source, a tree over the sources, and a proof per row.

A row's leaf is the digest of its fields; every run of ``fanout`` consecutive nodes becomes the digest of
their hexadecimal texts, level by level, until one is left. A level is one aggregate: conditional
aggregates (slot pivot) spread the children of a parent into ``fanout`` columns, the concatenated columns
are hashed, and the columns without a child's own one are its siblings. Proofs go down the same tables:
a parent hands its own path and the siblings to each child, so no leaf is joined with its ancestors.

Leaves are numbered by a range sort over (source, id, leaf) and the sizes of the partitions before, so a
source holding a third of the rows, or many rows of one id, spread over many tasks. Levels are written to
the shared folder; their number grows with the logarithm of the largest source.

Rows: a null field is ``-``; a null or repeated id is an ordinary one (nulls first, rows of one id by
their leaves, equal rows in any order); a null source is a source of its own, first in order. Other
columns are ignored. No rows have no root and no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = "pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 2) = 0"

_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for a null, else UTF-8 length, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each group of ``keys``, and ``n``, the group's size.

    Rows are sorted by ranges of (keys, order); rows alike in all of these take any of their slots. What
    is joined back is one count per group and range.
    """
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order, "tie")]
    ranged = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
                         .withColumn("at", F.monotonically_increasing_id()).drop("tie"), f"{name}-sorted")
    counts = ranged.groupBy(*keys, "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("size").over(group).alias("n"))
    return ranged.join(counts, [*keys, "part"]).withColumn("slot", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def levels(nodes: DataFrame, key: str, payload: list[str], fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the levels above ``nodes`` (key, slot, n, h, payload), and (key, depth, h, payload) of groups of one node.

    A level's row is a parent: (key, slot, n, h, c0, c1, ...), each column a child as (h, payload) or null.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    found, below, extra = [], nodes, payload
    while most > 1:
        child = F.struct("h", *extra)
        spread = [F.max(F.when(F.pmod("slot", F.lit(fanout)) == j, child)).alias(f"c{j}") for j in range(fanout)]
        parents = (below.where("n > 1").groupBy(key, F.expr(f"slot div {fanout}").alias("slot"))
                   .agg(F.max(F.expr(f"(n + {fanout - 1}) div {fanout}")).alias("n"), *spread))
        text = F.concat(*[F.coalesce(F.col(f"c{j}.h"), F.lit("")) for j in range(fanout)])
        below = materialise(parents.withColumn("h", F.sha2(text.cast("binary"), 256)), f"{name}-level")
        found.append(below)
        extra, most = [], -(-most // fanout)
    return found, nodes.where("n = 1").select(key, F.lit(0).alias("depth"), "h", *payload)


def paths(found: list[DataFrame], lone: DataFrame, tops: DataFrame, key: str, payload: list[str], fanout: int) -> DataFrame:
    """(key, path, carried columns of ``tops``, h, payload) of every node below; the path goes from the node upwards.

    ``tops`` holds (key, depth, path, carried): the path of each group's top, handed down level by level.
    """
    carried = [c for c in tops.columns if c not in (key, "depth", "path")]
    here = None
    for depth in range(len(found), 0, -1):
        start = tops.where(F.col("depth") == depth).select(key, F.lit(0).cast("long").alias("slot"), "path", *carried)
        here = start if here is None else here.unionByName(start)
        own = payload if depth == 1 else []
        column = lambda j: F.coalesce(F.col(f"c{j}.h"), F.lit(""))
        joined = lambda js: F.concat(F.lit(""), *map(column, js))
        child = [F.struct(
            (F.col("slot") * fanout + j).alias("slot"), F.col(f"c{j}").alias("node"),
            F.struct(joined(range(j)).alias("left"), joined(range(j + 1, fanout)).alias("right")).alias("step")) for j in range(fanout)]
        table = found[depth - 1].select(key, "slot", *[f"c{j}" for j in range(fanout)])
        here = table.join(here, [key, "slot"]).select(key, "path", *carried, F.explode(F.array(*child)).alias("c")).where("c.node IS NOT NULL").select(
            key, F.col("c.slot").alias("slot"), F.concat(F.array("c.step"), "path").alias("path"), *carried,
            *([F.col("c.node.h").alias("h"), *[F.col(f"c.node.{p}").alias(p) for p in own]] if depth == 1 else []))
    single = lone.join(tops.where("depth = 0").drop("depth"), key).select(key, "path", *carried, "h", *payload)
    return single if here is None else here.drop("slot").unionByName(single)


def tops_of(found: list[DataFrame], lone: DataFrame, key: str) -> DataFrame:
    """(key, depth, h): the top of every group."""
    each = [t.where("n = 1").select(key, F.lit(d).alias("depth"), "h") for d, t in enumerate(found, 1)]
    return reduce(DataFrame.unionByName, each, lone.select(key, "depth", "h"))


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, fields=FIELDS,
             fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified), a row per document.

    ``path`` lists the siblings (left and right of the own node, concatenated) from the leaf to the root.
    ``folded_root`` is recomputed along it from the leaf, or, where ``tampered`` holds, from the leaf of
    the row with ``changed`` as its last field.
    """
    columns = [F.col(c) for c in fields]
    own = leaf(columns)
    other = own if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf([*columns[:-1], changed])).otherwise(own)
    # '-' sorts before '=', so a null source comes first.
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("tree"),
                       F.col("doc_id").cast("long").alias("doc_id"), own.alias("h"), other.alias("presented"))
    leaves = numbered(rows, ["tree"], ["doc_id", "h"], "leaves")
    payload = ["doc_id", "presented"]
    found, lone = levels(leaves, "tree", payload, fanout, "tree")
    subroots = materialise(tops_of(found, lone, "tree"), "subroots")
    upper = numbered(subroots.select(F.lit(0).alias("all"), "tree", F.col("depth").alias("height"), "h"), ["all"], ["tree"], "sources")
    above, alone = levels(upper, "all", ["tree", "height"], fanout, "root")
    top = tops_of(above, alone, "all").withColumn("path", F.array().cast(_PATH)).withColumnRenamed("h", "root")
    below = paths(above, alone, top, "all", ["tree", "height"], fanout)
    tops = materialise(below.select("tree", F.col("height").alias("depth"), "path", F.col("h").alias("subroot"), "root"), "tops")
    leaves = paths(found, lone, tops, "tree", payload, fanout)
    step = lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]).cast("binary"), 256)
    return leaves.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", "path",
        F.aggregate("path", F.col("presented"), step).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, in order."""
    text = F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")
    return F.sha2(text.cast("binary"), 256)


#: Rows of the query on DuckDB: the same trees by recursion over (source, slot).
MANIFEST_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
       FROM range(256) AS r(n)),
fields AS (SELECT doc_id, source, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    xor(4294967295, list_reduce([4294967295] || list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 2 = 0 AS even
  FROM documents, crc),
leaves AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN even THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') ELSE strlen(text) || ':' || text END) AS shown
  FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY source) AS n,
    coalesce('=' || source, '-') AS tree FROM leaves),
nodes AS (
  SELECT 0 AS lvl, tree, slot, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, tree, slot // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY slot)) FROM nodes WHERE n > 1 GROUP BY lvl, tree, slot // 3, n),
sources AS (SELECT tree, h AS subroot, lvl AS top, row_number() OVER (ORDER BY tree) - 1 AS slot, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, slot, n, subroot AS h FROM sources
  UNION ALL
  SELECT lvl + 1, slot // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY slot)) FROM upper WHERE n > 1 GROUP BY lvl, slot // 3, n),
steps AS (SELECT a.lvl, a.tree, a.slot, coalesce(string_agg(b.h, '' ORDER BY b.slot) FILTER (b.slot < a.slot), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.slot) FILTER (b.slot > a.slot), '') AS r
  FROM (SELECT lvl, tree, slot, n, h FROM nodes UNION ALL SELECT lvl, NULL, slot, n, h FROM upper) a
  JOIN (SELECT lvl, tree, slot, n, h FROM nodes UNION ALL SELECT lvl, NULL, slot, n, h FROM upper) b
    ON a.lvl = b.lvl AND a.tree IS NOT DISTINCT FROM b.tree AND a.slot // 3 = b.slot // 3 WHERE a.n > 1 GROUP BY ALL),
up AS (
  SELECT 0 AS lvl, p.doc_id, p.tree, p.slot AS leaf_slot, p.tree AS spot, p.slot, p.leaf, p.shown AS h, '' AS seen, s.top, s.subroot, s.slot AS source_slot
  FROM placed p JOIN sources s USING (tree)
  UNION ALL
  SELECT CASE WHEN spot IS NOT NULL AND u.lvl = top THEN 0 ELSE u.lvl + 1 END, doc_id, u.tree, leaf_slot, CASE WHEN u.lvl = top THEN NULL ELSE spot END,
    CASE WHEN spot IS NOT NULL AND u.lvl = top THEN source_slot ELSE u.slot // 3 END, leaf,
    CASE WHEN spot IS NOT NULL AND u.lvl = top THEN u.h ELSE sha256(s.l || u.h || s.r) END,
    CASE WHEN spot IS NOT NULL AND u.lvl = top THEN seen ELSE seen || s.l || s.r END, CASE WHEN u.lvl = top THEN -1 ELSE top END, subroot, source_slot
  FROM up u LEFT JOIN steps s ON s.lvl = u.lvl AND s.tree IS NOT DISTINCT FROM u.spot AND s.slot = u.slot
  WHERE spot IS NOT NULL AND u.lvl = top OR s.slot IS NOT NULL),
ends AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_slot ORDER BY top, lvl DESC) AS nth FROM up WHERE spot IS NULL)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(seen) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM ends e, (SELECT h FROM upper WHERE n = 1) r WHERE nth = 1"""
