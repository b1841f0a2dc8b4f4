"""MCAP files with and without their index."""

from __future__ import annotations

import struct

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from terrazzo.sources import formats, mcap, scenes

TOPICS = {1: "/color", 2: "/depth", 3: "/imu"}


def record(op, body):
    return struct.pack("<BQ", op, len(body)) + body


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def channel(number):
    return record(mcap.CHANNEL, struct.pack("<HH", number, 0) + text(TOPICS[number]) + text("cdr") + struct.pack("<I", 0))


def message(number, logged, stamp=0):
    body = b"\0\1\0\0" + struct.pack("<iI", *divmod(stamp, 1_000_000_000)) + b"x" * (logged % 50)
    return record(mcap.MESSAGE, struct.pack("<HIQQ", number, 0, logged, logged) + body)


def pack(kind, body):
    if kind == "zstd":
        return zstandard.ZstdCompressor().compress(body)
    return pa.compress(body, codec="lz4", asbytes=True) if kind == "lz4" else body


def built(chunks, kinds=("", "zstd", "lz4"), with_index=True, cut=0) -> bytes:
    """A file of chunks, each a list of (channel, logged, stamp)."""
    out, entries = bytearray(formats.MCAP_MAGIC + record(mcap.HEADER, text("ros2") + text(""))), []
    for k, rows in enumerate(chunks):
        used, kind = sorted({r[0] for r in rows}), kinds[k % len(kinds)]
        body = b"".join(map(channel, used)) + b"".join(message(*r) for r in rows)
        packed, times = pack(kind, body), [r[1] for r in rows]
        chunk = record(mcap.CHUNK, struct.pack("<QQQI", min(times), max(times), len(body), 0) + text(kind) + struct.pack("<Q", len(packed)) + packed)
        held = b"".join(struct.pack("<HQ", c, 0) for c in used)
        entries.append(record(mcap.CHUNK_INDEX, struct.pack("<QQQQI", min(times), max(times), len(out), len(chunk), len(held)) + held + struct.pack("<Q", 0) + text(kind) + struct.pack("<QQ", len(packed), len(body))))
        out += chunk
    out += record(mcap.DATA_END, struct.pack("<I", 0))
    start = len(out) if with_index else 0
    if with_index:
        out += b"".join(map(channel, TOPICS)) + b"".join(entries)
    out += record(mcap.FOOTER, struct.pack("<QQI", start, 0, 0)) + formats.MCAP_MAGIC
    return bytes(out[: len(out) - cut])


CHUNKS = [[(1 if k % 2 else 2, 100 * k + i, (100 * k + i) * 1_000_003 if i % 3 else 0) for i in range(20)] for k in range(8)] + [[(3, 5000, 0), (1, 5001, 7)]]
WANT = sorted((TOPICS[c], s or t, t) for rows in CHUNKS for c, t, s in rows)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.mcap").write_bytes(built(CHUNKS))
    return tmp_path


def got(df):
    return sorted((r.topic, r.stamp, r.logged) for r in df.collect())


def test_messages_by_index_equal_the_whole_file(spark, folder):
    df = mcap.messages(spark, folder, partition_bytes=1500)
    assert got(df) == WANT and df.rdd.getNumPartitions() > 2
    whole = [(t, formats.header_stamp(p, ns), ns) for t, ns, p in formats.mcap_messages(built(CHUNKS, kinds=("",)))]
    assert sorted(whole) == WANT
    assert scenes.mcap(spark, str(folder), ["/imu"]).columns == ["path", "topic", "stamp", "payload"]


@pytest.mark.parametrize("how", [{"with_index": False}, {"cut": 3}])
def test_files_without_a_summary_are_read_record_by_record(spark, tmp_path, how):
    (tmp_path / "b.mcap").write_bytes(built(CHUNKS, **how))
    assert mcap.index(str(tmp_path / "b.mcap")) is None
    assert got(mcap.messages(spark, tmp_path / "b.mcap")) == WANT
    assert got(mcap.messages(spark, tmp_path / "b.mcap", ["/color"], start=300)) == [w for w in WANT if w[0] == "/color" and w[2] >= 300]


def test_topics_and_times_choose_chunks(folder):
    path = str(folder / "a" / "one.mcap")
    chosen = lambda **w: sum(len(r.chunks) for r in mcap.McapReader(path, mcap.Wanted(**w), 10**9).partitions())
    assert (chosen(), chosen(topics=frozenset({"/imu"})), chosen(topics=frozenset({"/depth"})), chosen(start=300, end=420), chosen(start=9999)) == (9, 1, 4, 2, 0)


def test_filters_of_a_query_reach_the_index(spark, folder):
    df = mcap.messages(spark, folder)
    few = df.where((F.col("topic") == "/depth") & (F.col("logged") >= 210) & (F.col("logged") < 405))
    assert got(few) == [w for w in WANT if w[0] == "/depth" and 210 <= w[2] < 405]
    reader = mcap.McapReader(str(folder), mcap.Wanted(), 10**9)
    list(reader.pushFilters([mcap.EqualTo(("topic",), "/depth"), mcap.GreaterThanOrEqual(("logged",), 210), mcap.LessThan(("logged",), 405)]))
    assert sum(len(r.chunks) for r in reader.partitions()) == 2  # those from 200 and 400


def test_no_task_reads_more_than_its_chunks(folder, monkeypatch):
    path, read = str(folder / "a" / "one.mcap"), []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *how):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    plain = mcap.opened
    monkeypatch.setattr(mcap, "opened", lambda p: Counted(plain(p)))
    (run,) = mcap.McapReader(path, mcap.Wanted(topics=frozenset({"/imu"})), 10**9).partitions()
    read.clear()
    assert [t for t, *_ in mcap.read_run(run, mcap.Wanted(topics=frozenset({"/imu"})))] == ["/imu"]
    assert sum(read) == sum(n for _, n in run.chunks) < 300


def test_other_files_are_refused(tmp_path):
    (tmp_path / "c.mcap").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="not an MCAP file"):
        mcap.index(str(tmp_path / "c.mcap"))
    with pytest.raises(FileNotFoundError):
        mcap.found_files(str(tmp_path / "none"))
