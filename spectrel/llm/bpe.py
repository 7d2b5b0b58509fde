"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where they agree, and encoded.

A text of up to ``chunk_chars`` is one chunk and is encoded where it is read. A longer one becomes chunk
rows, each with ``overlap`` more characters of its successor, dealt over the cluster; every chunk is
pre-tokenised and encoded on its own. The pre-token pattern looks only ahead, so once two chunks share a
boundary their pre-tokens agree from there on: the stitch takes each chunk up to the first boundary it
shares with the next one. Only where an overlap holds no shared boundary (a pre-token longer than that)
are pre-tokens made anew, from the last sure boundary until one of a later chunk is met.
Decoding concatenates the bytes of the ids. Pre-tokens not yet known to a worker are merged together: those of
like length are rows of a matrix, and a round makes one merge in each of them.

Rows: a null text is empty and has no ids. Rows are independent; repeated rows and other columns do not
matter. Every byte is in the vocabulary, so every text can be encoded.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import textbytes as tb

CHUNK_CHARS = 1 << 15
OVERLAP = 256
AHEAD = 3  # characters after a pre-token that the pattern may look at
CACHE = 1 << 16  # pre-tokens in each of the two generations that a worker remembers
RUN_CHARS = 1 << 20  # of texts pre-tokenised together
DECODED = 1 << 16  # ids decoded together
WIDTHS = (6, 8, 10, 12, 16, 24, 40, 64)  # pre-tokens of like length are merged as rows of one matrix
NONE = np.iinfo(np.int64).max

_MODELS: dict[tuple[str, str], "Model"] = {}


class Model:
    """Ranks of a vocabulary file ("base64 rank" lines) and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {rank: piece for piece, rank in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way to put a token together from two others, as (left id, right id) -> rank.
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's token; ``NONE`` where there is none, or where ``right`` is -1."""
        key = np.where(right >= 0, left << 32 | right, -1)
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of least rank is merged, leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # where the part from i ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop or middle == stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(queue, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def merged_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of many pre-tokens of at most ``width`` bytes: a merge a row and round, the row of each as :meth:`merged`."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        held = np.arange(width) < size[:, None]
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[held] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        number, out = np.arange(len(pieces)), [b""] * len(pieces)

        def leave(rows: np.ndarray) -> None:
            left = ids[rows]
            flat = left[left >= 0].astype("<u4").tobytes()
            ends = (4 * np.cumsum((left >= 0).sum(1))).tolist()
            for i, a, b in zip(number[rows].tolist(), [0, *ends], ends):
                out[i] = flat[a:b]

        while len(number):
            if not pair.shape[1]:
                leave(np.arange(len(number)))
                break
            at = pair.argmin(1)
            rank = pair[np.arange(len(number)), at]
            done = rank == NONE
            if done.any():
                leave(np.flatnonzero(done))
                ids, pair, number, at, rank = ids[~done], pair[~done], number[~done], at[~done], rank[~done]
                if not len(number):
                    break
            n, row = len(number), np.arange(len(number))
            stays = np.ones(ids.shape, bool)
            stays[row, at + 1] = False
            ids = ids[stays].reshape(n, -1)
            ids[row, at] = rank
            pair = pair[stays[:, 1:]].reshape(n, -1)
            after = np.flatnonzero(at < pair.shape[1])
            pair[after, at[after]] = self.pair_rank(rank[after], ids[after, at[after] + 1])
            ahead = np.flatnonzero(at > 0)
            pair[ahead, at[ahead] - 1] = self.pair_rank(ids[ahead, at[ahead] - 1], rank[ahead])
        return out

    def merged_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens as little-endian 32-bit integers; those over the last width one by one."""
        out: list[bytes] = [b""] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                out[i] = self.ranks[piece].to_bytes(4, "little")
            else:
                by.setdefault(bisect_left(WIDTHS, len(piece)), []).append(i)
        for w, chosen in by.items():
            if w < len(WIDTHS):
                found = self.merged_rows([pieces[i] for i in chosen], WIDTHS[w])
            else:
                found = [_packed(self.merged(pieces[i])) for i in chosen]
            for i, ids in zip(chosen, found):
                out[i] = ids
        return out

    def known(self, pretokens) -> dict[str, bytes]:
        """Ids of at least these pre-tokens, in bytes; two generations of ``CACHE`` and those of one call are remembered."""
        wanted = set(pretokens)
        missing = wanted.difference(self.young)
        if missing and len(self.young) + len(missing) > CACHE:
            self.old, self.young, missing = self.young, {}, wanted
        if missing:
            self.young.update((p, self.old[p]) for p in missing if p in self.old)
            new = [p for p in missing if p not in self.old]
            self.young.update(zip(new, self.merged_all([p.encode() for p in new])))
        return self.young

    def encode(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pre-token, in bytes."""
        return list(map(self.known(pretokens).__getitem__, pretokens))

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(self.bytes_of.__getitem__, ids[lo:lo + DECODED].tolist())) for lo in range(0, len(ids), DECODED))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def model(path: str, pattern: str) -> Model:
    """The model of this worker, read once."""
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = Model(path, pattern)
    return _MODELS[path, pattern]


def chunk_tokens(m: Model, text: str, base: int, last: bool) -> tuple[np.ndarray, list[bytes]]:
    """Boundaries (in the whole text) and ids of the pre-tokens that a chunk's cut end cannot have changed."""
    tokens = m.find.findall(text)
    at = np.append(0, np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))))
    if not last:
        sure = max(0, int(np.searchsorted(at, len(text) - AHEAD, "right")) - 1)
        tokens, at = tokens[:sure], at[:sure + 1]
    return at + base, m.encode(tokens)


class Chunks:
    """What the chunks of a text found, taken apart one at a time: a long text has millions of pre-tokens."""

    def __init__(self, group: pa.Table):
        self.group = group.take(pc.sort_indices(group.column("no")))

    def __len__(self) -> int:
        return self.group.num_rows

    def text(self) -> str:
        return "".join(self.group.column("body").to_pylist())

    def __getitem__(self, k: int) -> tuple[list[int], list[bytes]]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        bounds, counts, ids = (self.group.column(c)[k].as_py() for c in ("bounds", "counts", "ids"))
        ends = np.cumsum(np.frombuffer(counts, np.int32)).tolist()
        return np.frombuffer(bounds, np.int64).tolist(), [ids[a:b] for a, b in zip([0, *ends], ends)]


def stitch(m: Model, text: str, chunks: Sequence[tuple[list[int], list[bytes]]]) -> list[bytes]:
    """Ids of ``text`` in runs of pre-tokens, from what its chunks found."""
    out, at = [], 0

    def walk() -> None:
        nonlocal at
        hit = m.find.match(text, at)
        out.extend(m.encode([hit.group()]))
        at = hit.end()

    for k, (bounds, ids) in enumerate(chunks):
        # Until the place is a boundary here too; at once, where the overlap agreed.
        i = bisect_left(bounds, at)
        while at < bounds[-1] and bounds[i] != at:
            walk()
            i = bisect_left(bounds, at)
        if at >= bounds[-1]:
            continue
        j = len(bounds) - 1
        if k + 1 < len(chunks):
            later = chunks[k + 1][0]
            shared = set(bounds[bisect_left(bounds, max(at, later[0])):]).intersection(later)
            j = bisect_left(bounds, min(shared)) if shared else j
        out.append(b"".join(ids[i:j]))
        at = bounds[j]
    while at < len(text):
        walk()
    return out


SCHEMA = "doc_id long, ids binary, decoded binary"
CHUNK_SCHEMA = "tag long, doc_id long, no int, last boolean, body string, ahead string"
FOUND_SCHEMA = "tag long, doc_id long, no int, body string, bounds binary, counts binary, ids binary"


def _whole(path, pattern):
    def run(batches):
        m = model(path, pattern)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            ends = np.append(0, np.cumsum([len(t or "") for t in rows], dtype=np.int64))
            for lo, hi in tb.slices(ends, RUN_CHARS):
                texts = [m.find.findall(t or "") for t in rows[lo:hi]]
                known = m.known(chain.from_iterable(texts))
                ids = [b"".join(map(known.__getitem__, t)) for t in texts]
                yield pa.record_batch({"doc_id": batch.column(0).slice(lo, hi - lo), "ids": pa.array(ids, pa.binary()),
                                       "decoded": pa.array([m.decode(x) for x in ids], pa.binary())})

    return run


def _cut(chars: int, overlap: int):
    def run(batches):
        base, n = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n += 1
                for no, at in enumerate(range(0, len(text), chars)):
                    yield pa.record_batch({
                        "tag": pa.array([base + n], pa.int64()), "doc_id": pa.array([doc], pa.int64()), "no": pa.array([no], pa.int32()),
                        "last": pa.array([at + chars + overlap >= len(text)]), "body": [text[at:at + chars]],
                        "ahead": [text[at + chars:at + chars + overlap]]})

    return run


def _chunked(path, pattern, chars):
    def run(batches):
        m = model(path, pattern)
        for batch in batches:
            for r in batch.to_pylist():
                bounds, ids = chunk_tokens(m, r["body"] + r["ahead"], r["no"] * chars, r["last"])
                counts = np.fromiter(map(len, ids), np.int32, len(ids))  # bytes of ids of each pre-token
                yield pa.record_batch({
                    "tag": pa.array([r["tag"]], pa.int64()), "doc_id": pa.array([r["doc_id"]], pa.int64()), "no": pa.array([r["no"]], pa.int32()),
                    "body": [r["body"]], "bounds": [bounds.astype(np.int64).tobytes()], "counts": [counts.tobytes()], "ids": [b"".join(ids)]})

    return run


def _joined(path, pattern):
    def run(group: pa.Table) -> pa.Table:
        m, chunks = model(path, pattern), Chunks(group)
        flat = b"".join(stitch(m, chunks.text(), chunks))
        return pa.table({"doc_id": pa.array([group.column("doc_id")[0].as_py()], pa.int64()), "ids": pa.array([flat], pa.binary()),
                         "decoded": pa.array([m.decode(flat)], pa.binary())})

    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids, decoded): the ids as little-endian 32-bit integers, and their bytes decoded again.

    ``path`` names the vocabulary file on the workers, ``pattern`` the pre-token pattern. The chunk size
    and overlap set the grain of parallel work and never change the ids.
    """
    rows = tb.text_rows(docs, "doc_id")
    long = F.coalesce(F.char_length("text") > chunk_chars, F.lit(False))
    # Written, so that a task run again cannot number documents anew.
    chunks = materialise(rows.where(long).mapInArrow(_cut(chunk_chars, overlap), CHUNK_SCHEMA), "chunks")
    found = chunks.repartition("tag", "no").mapInArrow(_chunked(path, pattern, chunk_chars), FOUND_SCHEMA)
    return rows.where(~long).mapInArrow(_whole(path, pattern), SCHEMA).unionByName(
        found.groupBy("tag").applyInArrow(_joined(path, pattern), SCHEMA))
