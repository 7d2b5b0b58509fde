"""Text columns as byte arrays: Arrow buffers, word bounds and hashes of byte ranges, all vectorised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
BATCH_ROWS = 256


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the text, typed, for Python workers; the text comes last.

    Whole texts are wide rows, so a batch for Python holds few of them (a setting of the session).
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kinds = {"doc_id": "long"}
    return docs.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in (*columns, "text")])

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def counter_hash(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


_BYTE_VALUE = counter_hash(1, 256)
_LOWER_VALUE = _BYTE_VALUE.copy()
_LOWER_VALUE[65:91] = _BYTE_VALUE[97:123]
_powers = {m: np.ones(1, U64) for m in (_MULTIPLIER, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        full = np.full(max(n, 1 << 16), base, U64)
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the ``len + 1`` offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes together, or one longer row alone."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, rows)
        lo = hi


def text_runs(batches, limit: int = 1 << 20):
    """(row values by column, bytes, offsets) of runs of rows; the text column comes last in a batch."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.num_columns - 1))
        for lo, hi in slices(offsets, limit):
            yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums from which the hash of any byte range follows in constant time."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_LOWER_VALUE if lower else _BYTE_VALUE)[data] * _power(_MULTIPLIER, len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each range; equal bytes give equal hashes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(sums))[starts])


def window_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from every position."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, U64)
    return mixed((sums[length:] - sums[:n]) * _power(_INVERSE, len(sums))[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes outside ``gaps`` (``[^\\x20\\x09-\\x0D]``); words never cross rows."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~gaps[data]
    begins = solid[1:] & ~solid[:-1]
    ends = ~solid[1:] & solid[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[solid[inner] & solid[inner + 1]]  # a word of one row touches a word of the next
    begins[cut] = True
    ends[cut] = True
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends)
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of every row."""
    return np.bincount(words(data, offsets)[2], minlength=len(offsets) - 1)
