"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

Every shard has a draw for every document: an exponential variable of its weight's rate, from a hash of
the document's id and the shard's number. A rack's draw is the least of its shards' draws, a region's
the least of its racks', so a node's draw has the rate of its subtree's total weight and a document that
descends to the least draw at each level lands in each shard with probability by weight. A changed
weight changes draws in its own subtree only: a heavier or new shard takes documents into itself, a
lighter one gives its own away, and nothing else moves. (Draws of each node's own would not do: a grown region's
documents would be dealt anew inside it.) For even weights the descent ends where one flat minimum over all shards
would; it costs a digest for each shard and row.

The law is ``key``: the id and the tree decide. A null id is a key of its own; equal ids share a shard.
Slots number the documents of a shard from 0 without gaps, by the key's hash, id, checksum and size;
rows equal in all of these take neighbouring slots. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merkle import numbered

#: region -> rack -> {shard: weight}
Tree = list[list[dict[int, float]]]
SPARE_BYTES = 8  # added to the size of every text


def even_tree(shards: int, racks: int = 3, regions: int = 2) -> Tree:
    """``shards`` of weight 1 in ``regions`` of ``racks`` racks; more shards go to the last rack."""
    each = max(1, shards // (racks * regions))
    tree: Tree = [[{} for _ in range(racks)] for _ in range(regions)]
    for s in range(shards):
        at = min(s // each, racks * regions - 1)
        tree[at // racks][at % racks][s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in its last rack."""
    out = [[dict(rack) for rack in region] for region in tree]
    out[-1][-1][shard] = weight
    return out


def _draw(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{shard}/"), key)), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 1) / float(1 << 48)
    return -F.log(uniform) / weight


def descend(key: Column, tree: Tree) -> Column:
    """The shard at the end of the descent; empty racks and regions have no draw."""
    least = lambda nodes: nodes[0] if len(nodes) == 1 else F.array_min(F.array(*nodes))
    regions = []
    for region in tree:
        racks = [least([F.struct(_draw(key, s, w).alias("draw"), F.lit(s).alias("shard")) for s, w in rack.items()])
                 for rack in region if rack]
        if racks:
            regions.append(least(racks))
    return least(regions)["shard"]


def place(docs: DataFrame, tree: Tree, more: Tree | None = None, sub_buckets: int = 4_096) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard), a row per document.

    Slots follow a range sort over (shard, sub-bucket, id, checksum, size), so no task holds a shard, or all
    rows of one id; a sub-bucket is a hash of the id that keeps slots from following the ids.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + SPARE_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), descend(key, tree).alias("shard"),
        (descend(key, more) if more else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(sub_buckets)).alias("sub"))
    found = numbered(rows, ["shard"], ["sub", "doc_id", "text_crc32", "size"], "placed")
    return found.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def place_sql(shards: int, sub_buckets: int = 4_096) -> str:
    """The rows of :func:`place` for trees of equal weights, where the least draw wins at every level alike."""
    return f"""
    WITH bytes AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
             hex(encode(coalesce(text, ''))) AS h FROM documents),
    crc AS (SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
            FROM range(256) AS r(n)),
    placed AS (
      SELECT doc_id, strlen(text) + {SPARE_BYTES} AS size, k,
        xor(4294967295, list_reduce([4294967295] || list_transform(range(strlen(text)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
          lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS text_crc32,
        list_reduce(list_transform(range({shards}), lambda s: {{'d': -CAST('0x' || substr(md5(s || '/' || k), 1, 12) AS BIGINT), 's': s}}), lambda a, b: least(a, b)).s AS shard,
        list_reduce(list_transform(range({shards + 1}), lambda s: {{'d': -CAST('0x' || substr(md5(s || '/' || k), 1, 12) AS BIGINT), 's': s}}), lambda a, b: least(a, b)).s AS grown_shard,
        CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % {sub_buckets} AS sub
      FROM bytes, crc)
    SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY sub, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
    FROM placed"""
