"""Removal of repeated 200-byte strings by blockwise suffix sorting with a difference cover.

Texts are packed into chunks (a table in the shared folder), so that each later pass finds the same
text under the same chunk id after a retry. Then:

1. Every start of a 200-byte window is filed under the smallest 32-byte hash of its window and its
   distance to it in steps of 64. All starts filed together share 137 bytes (the key). Keys that occur
   once in the corpus cannot hold a repeat; only 9 bytes a key are shuffled to find that out.
2. For the other keys the text around (263 bytes at most) goes to the key's bucket, once per chunk and
   distinct content. There the suffixes are sorted one batch of keys at a time: by 64 bytes of their
   own, then by precomputed ranks of difference-cover samples, so memory is bounded by the batch and
   ties cost no more bytes. Neighbours in that order are compared byte by byte.
3. Keys that occur very often would bring all their surroundings to one bucket. Their windows are
   counted by hash instead, spread over all buckets, one row per chunk and distinct window.

Rows: a null text is empty; texts under 200 bytes lose nothing; repeated rows (also with one doc_id)
are rows of their own, so their windows repeat; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import textbytes as tb
from .textbytes import U64

LENGTH = 200  # bytes of a repeated string
GRAM = 32  # bytes hashed to place a window
STEP = 64  # starts filed under one key
COMMON = LENGTH - STEP + 1  # bytes shared by all windows of a key
ROW = 264  # bytes kept around a key: 63 before, 200 after, 1 of padding
CHUNK = 2 << 20  # bytes of text in a chunk; longer documents are cut into pieces
HOT = 4_096  # occurrences of a key from which its windows are counted by hash
BATCH = 4_096  # distinct surroundings sorted at once

#: A difference cover of the residues modulo 64.
COVER = (1, 2, 3, 6, 15, 17, 35, 43, 60)
PERIOD = 64


def _shift_table() -> np.ndarray:
    """[a, b]: the least shift that takes both residues into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    r = np.arange(PERIOD)
    both = inside[(r[:, None, None] + r) % PERIOD] & inside[(r[None, :, None] + r) % PERIOD]
    assert both.any(axis=2).all()
    return both.argmax(axis=2)


SHIFT = _shift_table()
CHUNK_SCHEMA = ("chunk_id long, tag long, n_bytes long, doc_ids array<bigint>, starts array<bigint>, "
                "totals array<bigint>, sizes array<bigint>, body binary")


# ---- packing -------------------------------------------------------------------------------------

def pack(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Chunk rows of (doc_id, text); a document over ``chunk_bytes`` becomes overlapping pieces with one tag."""

    def run(batches):
        base, n = TaskContext.get().partitionId() << 33, 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def row(ids, starts, totals, parts, tag):
            nonlocal n
            body = b"".join(parts)
            n += 1
            return pa.record_batch({
                "chunk_id": pa.array([base + n], pa.int64()), "tag": pa.array([tag], pa.int64()),
                "n_bytes": pa.array([len(body)], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "starts": pa.array([starts], pa.list_(pa.int64())),
                "totals": pa.array([totals], pa.list_(pa.int64())),
                "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                "body": pa.array([squeeze.compress(body)], pa.binary())})

        ids, parts, held = [], [], 0
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                if len(text) > chunk_bytes:
                    tag = base + n + 1
                    for at in range(0, len(text), chunk_bytes):
                        yield row([doc], [at], [len(text)], [text[at:at + chunk_bytes + LENGTH - 1]], tag)
                    continue
                ids.append(doc)
                parts.append(text)
                held += len(text)
                if held >= chunk_bytes or len(ids) >= 50_000:
                    yield row(ids, [0] * len(ids), [len(p) for p in parts], parts, None)
                    ids, parts, held = [], [], 0
        if ids:
            yield row(ids, [0] * len(ids), [len(p) for p in parts], parts, None)

    return tb.text_rows(docs, "doc_id").mapInArrow(run, CHUNK_SCHEMA)


def _opened(body: bytes, sizes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.decompress(body), np.uint8)
    return data, np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])


# ---- keys ----------------------------------------------------------------------------------------

class Blocks:
    """Runs of window starts of one chunk, each under the key its windows share.

    ``first`` to ``last`` (exclusive) are the starts, ``at`` the position of the key; a start is
    ``at - t`` with t from 0 to 63. Equal windows get equal keys and equal t.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.sums = tb.prefix_sums(data)
        n, width = len(data), LENGTH - GRAM + 1
        valid = np.zeros(n + 1, np.int8)
        long = np.flatnonzero(np.diff(offsets) >= LENGTH)
        np.add.at(valid, offsets[:-1][long], 1)
        np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
        if not len(starts):
            self.first = self.last = self.at = np.zeros(0, np.int64)
            self.key = np.zeros(0, U64)
            return
        # The position in the low bits makes the leftmost of equal hashes the smallest.
        low = U64((1 << max(1, n.bit_length())) - 1)
        grams = tb.window_hash(self.sums, GRAM) & ~low
        grams |= np.arange(len(grams), dtype=U64)
        rows = -(-len(grams) // width)
        padded = np.full((rows + 1, width), np.iinfo(U64).max, U64)
        padded.reshape(-1)[:len(grams)] = grams
        ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(behind[starts], ahead[starts + width - 1]) & low).astype(np.int64)
        step = (anchor - starts) // STEP
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (step[1:] != step[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(starts)) - 1
        self.first, self.last = starts[begin], starts[end] + 1
        self.at = anchor[begin] - step[begin] * STEP
        self.key = tb.range_hash(self.sums, self.at, self.at + COMMON)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the place of each block's key among them, and their counts."""
        return np.unique(self.key, return_inverse=True, return_counts=True)[0:3]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits, so ordered hashes make contiguous slices."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _cuts(hashes: np.ndarray, buckets: int):
    """(bucket, from, to) of every bucket that ordered ``hashes`` meet."""
    if not len(hashes):
        return []
    b = _bucket(hashes, buckets)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return [(int(b[i]), int(i), int(j)) for i, j in zip(at, np.append(at[1:], len(b)))]


PIECE_SCHEMA = "bucket long, chunk_id long, kind int, n long, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["bucket", "chunk_id", "kind", "n", "payload"])


def _key_pieces(buckets: int):
    """kind 0: a chunk's distinct keys (8 bytes) and counts (1 byte, saturating) for a bucket."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, _, counts = Blocks(*_opened(r["body"], r["sizes"])).distinct()
                counts = np.minimum(counts, 255).astype(np.uint8)
                yield _rows([(b, r["chunk_id"], 0, j - i, keys[i:j].tobytes() + counts[i:j].tobytes())
                             for b, i, j in _cuts(keys, buckets)])

    return run


def _totals(payloads: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For hashes with counts of several chunks: all hashes, one after the other, and the corpus count of each."""
    keys = np.concatenate([np.frombuffer(p, U64, n) for p, n in zip(payloads, sizes)])
    counts = np.concatenate([np.frombuffer(p, np.uint8, n, 8 * n) for p, n in zip(payloads, sizes)])
    _, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, counts)[place]


def _count_keys(hot: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        _, total = _totals(table["payload"].to_pylist(), sizes)
        flags = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)
        ends = np.cumsum(sizes)
        parts = [flags[e - n:e].tobytes() for n, e in zip(sizes, ends)]
        return table.set_column(4, "payload", pa.array(parts, pa.binary()))

    return run


# ---- candidates ----------------------------------------------------------------------------------

class Candidates:
    """The blocks of a chunk whose key occurs again, split into ordinary and hot ones."""

    def __init__(self, data, offsets, replies: list[dict]):
        b = self.blocks = Blocks(data, offsets)
        keys, place, _ = b.distinct()
        flags = np.frombuffer(b"".join(r["payload"] for r in sorted(replies, key=lambda r: r["bucket"])), np.uint8)
        mine = flags[place] if len(keys) else np.zeros(0, np.uint8)
        # Ordinary: distinct surroundings, ordered by key.
        plain = np.flatnonzero(mine == 1)
        content = tb.range_hash(b.sums, b.first[plain], b.last[plain] + LENGTH - 1)
        content ^= tb.mixed((b.at[plain] - b.first[plain]).astype(U64) * U64(64) + (b.last[plain] - b.first[plain]).astype(U64))
        order = np.lexsort((content, b.key[plain]))
        k, c = b.key[plain][order], content[order]
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(order) else np.zeros(0, bool)
        self.plain, self.row_of = plain[order], np.cumsum(new) - 1
        self.lead = plain[order][new]  # one block for each distinct surrounding
        self.count = np.minimum(np.bincount(self.row_of, minlength=len(self.lead)), 255).astype(np.uint8) if len(order) else np.zeros(0, np.uint8)
        # Hot: every window, by a hash of its 200 bytes.
        hot = np.flatnonzero(mine == 2)
        span = b.last[hot] - b.first[hot]
        self.windows = np.repeat(b.first[hot] - np.append(0, np.cumsum(span)[:-1]), span) + np.arange(span.sum())
        hashes = tb.range_hash(b.sums, self.windows, self.windows + LENGTH)
        self.hot, self.hot_place, self.hot_count = np.unique(hashes, return_inverse=True, return_counts=True)


def _surroundings(data: np.ndarray, c: Candidates) -> np.ndarray:
    """(distinct, 264) bytes from 63 before the key on; zero where no window of the block reaches."""
    b, lead = c.blocks, c.lead
    where = (b.at[lead] - (STEP - 1))[:, None] + np.arange(ROW)
    inside = (where >= b.first[lead][:, None]) & (where < (b.last[lead] + LENGTH - 1)[:, None])
    return np.where(inside, data[np.clip(where, 0, len(data) - 1)], 0).astype(np.uint8)


def _candidate_pieces(buckets: int):
    """kind 1: surroundings of keys; kind 2: hashes and counts of hot windows."""

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        r = chunk.to_pylist()[0]
        data, offsets = _opened(r["body"], r["sizes"])
        c = Candidates(data, offsets, replies.to_pylist())
        b, squeeze, out = c.blocks, zstandard.ZstdCompressor(level=1), []
        keys = b.key[c.lead]
        for bucket, i, j in _cuts(keys, buckets):
            part = Candidates.__new__(Candidates)
            part.blocks, part.lead = b, c.lead[i:j]
            head = keys[i:j].tobytes() + (b.at - b.first)[part.lead].astype(np.uint8).tobytes() + (b.at - b.last + 1)[part.lead].astype(np.uint8).tobytes() + c.count[i:j].tobytes()
            out.append((bucket, r["chunk_id"], 1, j - i, squeeze.compress(head + _surroundings(data, part).tobytes())))
        counts = np.minimum(c.hot_count, 255).astype(np.uint8)
        out += [(bucket, r["chunk_id"], 2, j - i, c.hot[i:j].tobytes() + counts[i:j].tobytes()) for bucket, i, j in _cuts(c.hot, buckets)]
        return pa.Table.from_batches([_rows(out)])

    return run


# ---- suffix sorting ------------------------------------------------------------------------------

def _split(idx, head, sel, group, key) -> None:
    """Order the members of each group by ``key`` and start new groups where it changes."""
    order = np.lexsort((key, group))
    idx[sel] = idx[sel][order]
    key = key[order]
    head[sel[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])


def _open_groups(head: np.ndarray, done: np.ndarray | None = None):
    group = np.cumsum(head) - 1
    some = np.bincount(group)[group] > 1
    if done is not None:
        some &= ~done
    sel = np.flatnonzero(some)
    return sel, group[sel]


def _by_words(words: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by 64 bytes, and flags where a new 64-byte string begins."""
    idx = idx[np.argsort(words[idx], kind="stable")]
    head = np.append(True, words[idx[1:]] != words[idx[:-1]])
    for depth in range(8, PERIOD, 8):
        sel, group = _open_groups(head)
        if not len(sel):
            break
        _split(idx, head, sel, group, words[idx[sel] + depth])
    return idx, head


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks by 256 bytes of the cover's positions below ``n`` (others: 0). Ranks double: a cover position plus 64 is one too."""
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + 2 * PERIOD + LENGTH, np.int64)
    order, head = _by_words(words, sample)
    rank[order] = np.cumsum(head)
    for reach in (PERIOD, 2 * PERIOD):
        far = rank[sample + reach]
        order = np.lexsort((far, rank[sample]))
        a, b = rank[sample][order], far[order]
        fresh = np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        rank = np.zeros_like(rank)
        rank[sample[order]] = fresh
    return rank


def suffix_order(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``starts`` ordered by at least 256 bytes of the suffixes there."""
    idx, head = _by_words(words, starts)
    sel, group = _open_groups(head)
    if not len(sel):
        return idx
    rank, done = cover_ranks(words, n), np.zeros(len(idx), bool)
    while len(sel):
        # Three-way partition of every open group around one of its members.
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(begin, len(group)))
        pivot = np.repeat(idx[sel[begin + size // 2]], size)
        own = idx[sel]
        shift = SHIFT[own % PERIOD, pivot % PERIOD]
        side = np.sign(rank[own + shift] - rank[pivot + shift])
        order = np.lexsort((side, group))
        idx[sel] = own[order]
        side = side[order]
        head[sel[1:]] |= (group[1:] == group[:-1]) & (side[1:] != side[:-1])
        done[sel] = side == 0
        sel, group = _open_groups(head, done)
    return idx


def repeated_starts(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For surroundings of 264 bytes and their window starts ``first`` to ``last``: those whose 200 bytes occur again."""
    n = rows.size
    text = np.zeros(n + 4 * PERIOD + LENGTH, np.uint8)
    text[:n] = rows.reshape(-1)
    words = np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,)).astype(U64)
    span = last - first
    base = np.arange(len(rows)) * ROW + first
    starts = np.repeat(base - np.append(0, np.cumsum(span)[:-1]), span) + np.arange(span.sum())
    idx = suffix_order(words, starts, n)
    left = np.arange(len(idx) - 1)
    for depth in range(0, LENGTH, 8):
        left = left[words[idx[left] + depth] == words[idx[left + 1] + depth]]
    again = np.zeros(n, bool)
    again[idx[left]] = True
    again[idx[left + 1]] = True
    return again.reshape(rows.shape)


def _resolve(batch: int):
    """Answer each piece of a bucket: 64 flags a surrounding (kind 1) or a byte a window (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        kinds, sizes, payloads = (table[c].to_pylist() for c in ("kind", "n", "payload"))
        answer: list[bytes] = [b""] * len(kinds)
        hot = [i for i, k in enumerate(kinds) if k == 2]
        if hot:
            _, total = _totals([payloads[i] for i in hot], [sizes[i] for i in hot])
            flags, ends = (total > 1).astype(np.uint8), np.cumsum([sizes[i] for i in hot])
            for i, e in zip(hot, ends):
                answer[i] = flags[e - sizes[i]:e].tobytes()
        plain = [i for i, k in enumerate(kinds) if k == 1]
        if plain:
            raw = [zstandard.decompress(payloads[i]) for i in plain]
            ns = [sizes[i] for i in plain]
            part = lambda kind, at, width: np.concatenate([np.frombuffer(x, kind, n * width // np.dtype(kind).itemsize, at * n) for x, n in zip(raw, ns)])
            keys, before, least, count = part(U64, 0, 8), part(np.uint8, 8, 1), part(np.uint8, 9, 1), part(np.uint8, 10, 1)
            rows = part(np.uint8, 11, ROW).reshape(-1, ROW)
            del raw
            first, last = STEP - 1 - before.astype(np.int64), STEP - least.astype(np.int64)
            flags = _flags(keys, first, last, count, rows, batch)
            ends = np.cumsum(ns)
            for i, n, e in zip(plain, ns, ends):
                answer[i] = flags[e - n:e].tobytes()
        return table.set_column(4, "payload", pa.array(answer, pa.binary()))

    return run


def _flags(keys, first, last, count, rows, batch) -> np.ndarray:
    factor = tb.counter_hash(7, ROW // 8)
    content = tb.mixed((rows.view(U64) * factor).sum(axis=1, dtype=U64) + (first * 64 + last).astype(U64))
    order = np.lexsort((content, keys))
    k, c = keys[order], content[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, c[1:] != c[:-1])
    place = np.cumsum(new) - 1  # of each row among the distinct ones
    lead = order[new]
    times = np.bincount(place, count[order])
    again = np.zeros((len(lead), STEP), bool)
    t = np.arange(STEP)
    again |= (times > 1)[:, None] & (t >= first[lead][:, None]) & (t < last[lead][:, None])
    # Keys with one surrounding are settled; the rest are sorted, whole keys at a time.
    key_of = (np.cumsum(new_key) - 1)[new]
    some = np.flatnonzero(np.bincount(key_of)[key_of] > 1)
    lo = 0
    while lo < len(some):
        hi = min(lo + batch, len(some))
        while hi < len(some) and key_of[some[hi]] == key_of[some[hi - 1]]:
            hi += 1
        s = some[lo:hi]
        again[s] |= repeated_starts(rows[lead[s]], first[lead[s]], last[lead[s]])[:, :STEP]
        lo = hi
    out = np.zeros(len(keys), U64)
    out[order] = np.packbits(again, axis=1).view(U64).reshape(-1)[place]
    return out


# ---- results -------------------------------------------------------------------------------------

RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:bigint,end:bigint>>"
PART_SCHEMA = "doc_id long, tag long, start long, body binary, windows binary"


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + LENGTH, n), -1)
    return np.cumsum(change[:-1]) > 0


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def _document(doc_id, text: np.ndarray, covered: np.ndarray) -> dict:
    spans = _runs(covered) if covered.any() else []
    kept = text[~covered] if spans else text
    return {"doc_id": doc_id, "n_bytes": len(text), "n_removed": len(text) - len(kept), "kept": kept.tobytes(), "spans": spans}


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
PART = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("body", pa.binary()), ("windows", pa.binary())])


def _finish(pieces: bool):
    """Documents of a chunk without their repeats; pieces of a long document carry their repeated starts on."""
    schema = PART if pieces else RESULT

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows:  # answers to a chunk of the other kind
            return schema.empty_table()
        r = chunk.to_pylist()[0]
        data, offsets = _opened(r["body"], r["sizes"])
        starts = _repeats(data, offsets, replies.to_pylist())
        if pieces:
            row = {"doc_id": r["doc_ids"][0], "tag": r["tag"], "start": r["starts"][0], "body": r["body"], "windows": np.sort(starts).tobytes()}
            return pa.Table.from_pylist([row], schema)
        covered = _covered(len(data), starts)
        rows = [_document(doc, data[a:b], covered[a:b]) for doc, a, b in zip(r["doc_ids"], offsets[:-1], offsets[1:])]
        return pa.Table.from_pylist(rows, schema)

    return run


def _repeats(data: np.ndarray, offsets: np.ndarray, replies: list[dict]) -> np.ndarray:
    """Positions in a chunk whose 200 bytes occur again, from the answers of the buckets."""
    answers = defaultdict(list)
    for x in sorted(replies, key=lambda x: x["bucket"]):
        answers[x["kind"]].append(x)
    joined = {kind: np.frombuffer(b"".join(x["payload"] for x in xs), np.uint8) for kind, xs in answers.items()}
    c = Candidates(data, offsets, answers[0])
    starts = [np.zeros(0, np.int64)]
    if len(c.lead):
        block, place = np.nonzero(np.unpackbits(joined[1].reshape(-1, 8)[c.row_of], axis=1))
        starts.append(c.blocks.at[c.plain[block]] - (STEP - 1) + place)
    if len(c.hot):
        starts.append(c.windows[joined[2][c.hot_place] > 0])
    return np.concatenate(starts)


def _assemble(pieces: pa.Table) -> pa.Table:
    rows = sorted(pieces.to_pylist(), key=lambda r: r["start"])
    parts = [np.frombuffer(zstandard.decompress(r["body"]), np.uint8) for r in rows]
    following = [r["start"] for r in rows[1:]] + [rows[-1]["start"] + len(parts[-1])]
    text = np.concatenate([p[:b - r["start"]] for r, p, b in zip(rows, parts, following)])
    starts = np.concatenate([np.frombuffer(r["windows"], np.int64) + r["start"] for r in rows])
    return pa.Table.from_pylist([_document(rows[0]["doc_id"], text, _covered(len(text), starts))], RESULT)


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, spans), a row per document: the bytes left and the spans removed.

    ``chunk_bytes`` bounds what a task holds of the text, ``hot`` the occurrences of a key that meet in
    one bucket, ``batch`` the surroundings sorted at once. None of them changes the result.
    """
    spark = docs.sparkSession
    chunks = materialise(pack(docs, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 25)
    keys = (chunks.select("chunk_id", "sizes", "body").mapInArrow(_key_pieces(buckets), PIECE_SCHEMA)
            .groupBy("bucket").applyInArrow(_count_keys(hot), PIECE_SCHEMA))
    keys = materialise(keys, "keys")
    slim = chunks.select("chunk_id", "sizes", "body").groupBy("chunk_id")
    found = (slim.cogroup(keys.groupBy("chunk_id")).applyInArrow(_candidate_pieces(buckets), PIECE_SCHEMA)
             .groupBy("bucket").applyInArrow(_resolve(batch), PIECE_SCHEMA))
    replies = keys.unionByName(materialise(found, "repeats")).groupBy("chunk_id")
    whole = chunks.where("tag IS NULL").groupBy("chunk_id").cogroup(replies).applyInArrow(_finish(False), RESULT_SCHEMA)
    parts = chunks.where("tag IS NOT NULL").groupBy("chunk_id").cogroup(replies).applyInArrow(_finish(True), PART_SCHEMA)
    return whole.unionByName(parts.groupBy("tag").applyInArrow(_assemble, RESULT_SCHEMA))
