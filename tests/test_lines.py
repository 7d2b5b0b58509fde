import pytest

from spectrel.session import scratch_path, ship
from spectrel.sources import lines as L

TEXTS = {"a.log": b"one\n\ntwo\r\n\xc3\xa9t\xc3\xa9\n" + b"x" * 300 + b"\nlast", "b.log": b"", "c.log": b"\n\n", "_skip": b"no\n", "d e.log": b"bad \xff\n" * 40}


def want(texts, whole=False):
    out = set()
    for name, data in texts.items():
        at = 0
        for line in data.splitlines(keepends=True) if b"\r" not in data else [x + b"\n" for x in data.split(b"\n")[:-1]] + [data.split(b"\n")[-1]]:
            if line and not name.startswith("_") and (line.endswith(b"\n") or not whole):
                out.add((name, at, line.removesuffix(b"\n").decode("utf-8", "replace")))
            at += len(line)
    return out


@pytest.mark.parametrize("size", [1, 7, 64 << 20])
def test_every_line_once_at_its_place_whatever_the_ranges(spark, tmp_path, size):
    ship(spark)
    for name, data in TEXTS.items():
        (tmp_path / name).write_bytes(data)
    got = [tuple(r) for r in L.read_lines(spark, str(tmp_path), range_bytes=size).collect()]
    assert set(got) == want(TEXTS) and len(got) == len(set(got))


def test_a_stream_over_growing_files_hands_out_whole_lines_once_and_replays_the_same(spark, tmp_path):
    ship(spark)
    folder, out, ck = tmp_path / "in", scratch_path(spark, "out"), scratch_path(spark, "ck")
    folder.mkdir()

    def step(checkpoint, sink):
        q = (L.read_lines(spark, str(folder), stream=True, range_bytes=50).writeStream.format("parquet")
             .option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start())
        q.awaitTermination()
        return [tuple(r) for r in spark.read.schema(L.SCHEMA).parquet(sink).collect()]

    (folder / "a.log").write_bytes(b"first\nhal")
    assert set(step(ck, out)) == {("a.log", 0, "first")}
    (folder / "a.log").write_bytes(b"first\nhalf\nnext\n")
    for name, data in TEXTS.items():
        (folder / f"{name.replace('a.', 'z.')}").write_bytes(data)
    texts = {name.replace("a.", "z."): data for name, data in TEXTS.items()} | {"a.log": b"first\nhalf\nnext\n"}
    got = step(ck, out)
    assert set(got) == want(texts, whole=True) and len(got) == len(set(got))
    again = step(scratch_path(spark, "ck"), scratch_path(spark, "out"))
    assert sorted(again) == sorted(got)
    # A file that became shorter fails the stream instead of shifting places.
    (folder / "a.log").write_bytes(b"f\n")
    with pytest.raises(Exception, match="shorter"):
        step(ck, out)


@pytest.mark.parametrize("tasks,most", [(1, L.TASK_BYTES), (10, 1_000), (1_000, 100)])
def test_short_ranges_share_a_task(tmp_path, tasks, most):
    (tmp_path / "a.log").write_bytes(b"0123456789\n" * 800)
    (tmp_path / "b.log").write_bytes(b"0123456789\n" * 200)
    ends = {"files": '{"a.log": 8800, "b.log": 2200}'}
    for parts in (L._Batch(str(tmp_path), 100, tasks).partitions(), L._Stream(str(tmp_path), 100, tasks).partitions({"files": "{}"}, ends)):
        ranges = [(r.source, r.lo, r.hi) for p in parts for r in p.ranges]
        assert ranges == [(s, lo, lo + 100) for s, n in (("a.log", 8_800), ("b.log", 2_200)) for lo in range(0, n, 100)]
        assert len(parts) <= max(1.25 * tasks, 11_000 / most) and max(sum(r.hi - r.lo for r in p.ranges) for p in parts) <= max(most, 1_100)
    assert [p.ranges for p in L._Batch(str(tmp_path), 1 << 20, 8).partitions()] == [[L.ByteRange("a.log", 0, 8_800), L.ByteRange("b.log", 0, 2_200)]]
