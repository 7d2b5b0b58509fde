"""Lines with their place: a data source, batch and stream, over a folder of growing text files.

Each row is ``(source, offset, line)``: the file's name inside the folder, the byte at which the line starts, and its
text without the newline. A line has the same place whenever and however it is read, so ids made from
it (:func:`~spectrel.sources.frames.to_measurement` with ``identity=["source", "offset"]``) survive a replay.

Large files are read in byte ranges; a range owns the lines that start in it. A task reads one range or several that follow
each other: as many as it takes to have ``tasks`` of them, but no more than ``TASK_BYTES`` where a range is smaller. Files whose names
begin with ``_`` or ``.`` are passed over. Bytes that are no UTF-8 are replaced. The stream hands out whole lines
only; the batch reader also the last line of a file without a newline. A file may grow but not change:
the stream fails on a file that became shorter or, after a restart, went. A stream's offset names every file of the folder.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "spectrel_lines"
SCHEMA = "source string, offset bigint, line string"
RANGE_BYTES = 64 << 20
TASK_BYTES = 32 << 20
TASKS = 64
BATCH_LINES = 4_096


@dataclass
class ByteRange(InputPartition):
    """Lines of a file that start at ``lo`` or later, before ``hi``."""

    source: str
    lo: int
    hi: int


@dataclass
class Ranges(InputPartition):
    """The ranges of a task."""

    ranges: list[ByteRange]


def _dealt(ranges: list[ByteRange], size: int, tasks: int) -> list[Ranges]:
    """Ranges that follow each other share a task, so that starting tasks costs no more than reading."""
    whole = sum(r.hi - r.lo for r in ranges)
    most = max(size, min(TASK_BYTES, whole // max(1, tasks)))
    out, held = [Ranges([])], 0
    for r in ranges:
        if out[-1].ranges and held + r.hi - r.lo > most:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.hi - r.lo
    return out


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _sizes(path: str) -> dict[str, int]:
    files, root = _folder(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=False))
    return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name)
            if f.type == fs.FileType.File and f.base_name[0] not in "_."}


def _whole(path: str, source: str, lo: int, hi: int) -> int:
    """End of the last line that is complete at ``hi``, looking back as far as ``lo``."""
    files, root = _folder(path)
    with files.open_input_file(f"{root}/{source}") as f:
        while hi > lo:
            start = max(lo, hi - (1 << 16))
            f.seek(start)
            at = f.read(hi - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            hi = start
    return lo


def _ranges(source: str, lo: int, hi: int, size: int) -> list[ByteRange]:
    return [ByteRange(source, a, min(a + size, hi)) for a in range(lo, hi, size)]


def _read(path: str, part: ByteRange) -> Iterator[pa.RecordBatch]:
    files, root = _folder(path)
    with files.open_input_file(f"{root}/{part.source}") as raw:
        f = io.BufferedReader(raw, 1 << 20)
        at = part.lo
        if at:
            # A line that starts before the range belongs to the range before.
            f.seek(at - 1)
            at += len(f.readline()) - 1
        places, lines = [], []
        while at < part.hi and (line := f.readline()):
            places.append(at)
            lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
            at += len(line)
            if len(lines) == BATCH_LINES:
                yield _batch(part.source, places, lines)
                places, lines = [], []
        if lines:
            yield _batch(part.source, places, lines)


def _batch(source: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([source] * len(lines)), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["source", "offset", "line"])


class _Batch(DataSourceReader):
    def __init__(self, path: str, size: int, tasks: int):
        self.path, self.size, self.tasks = path, size, tasks

    def partitions(self):
        parts = [p for source, end in _sizes(self.path).items() for p in _ranges(source, 0, end, self.size)]
        return _dealt(parts, self.size, self.tasks)

    def read(self, partition):
        return (batch for part in partition.ranges for batch in _read(self.path, part))


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, size: int, tasks: int):
        self.path, self.size, self.tasks = path, size, tasks
        self.seen: dict[str, tuple[int, int]] = {}  # size looked at, whole lines in it

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        for source, size in _sizes(self.path).items():
            looked, whole = self.seen.get(source, (0, 0))
            if size != looked:
                self.seen[source] = (size, _whole(self.path, source, min(whole, size), size))
        return {"files": json.dumps({s: whole for s, (_, whole) in sorted(self.seen.items()) if whole})}

    def partitions(self, start, end):
        before, after = json.loads(start["files"]), json.loads(end["files"])
        shorter = [s for s, lo in before.items() if after.get(s, 0) < lo]
        if shorter:
            raise ValueError(f"files became shorter or went: {shorter[:5]}")
        parts = [p for s, hi in after.items() for p in _ranges(s, before.get(s, 0), hi, self.size)]
        return _dealt(parts, self.size, self.tasks)

    def read(self, partition):
        return (batch for part in partition.ranges for batch in _read(self.path, part))

    def commit(self, end):
        pass


class LineSource(DataSource):
    """Options: ``path``, a folder that all executors can read, ``rangeBytes`` and ``tasks``."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def _settings(self):
        if not self.options.get("path"):
            raise ValueError("the line source needs a path")
        return self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("tasks", TASKS))

    def reader(self, schema):
        return _Batch(*self._settings())

    def streamReader(self, schema):
        return _Stream(*self._settings())


def read_lines(spark: SparkSession, path: str, stream: bool = False, range_bytes: int = RANGE_BYTES):
    """``(source, offset, line)`` of the folder, as a table or as a stream."""
    spark.dataSource.register(LineSource)
    reader = spark.readStream if stream else spark.read
    tasks = 4 * spark.sparkContext.defaultParallelism
    return reader.format(NAME).option("path", path).option("rangeBytes", range_bytes).option("tasks", tasks).load()
