"""MCAP files by their index: a task reads the chunks it needs, and no task reads a whole file.

The footer leads to the summary, which names the channels and, for each chunk, its place, its times and
the channels in it. Chunks without a wanted topic or time are never read; the others are dealt into
partitions of about `partition_bytes`. A file without a summary is read record by record in one
partition, chunk after chunk, so that it never lies in memory whole either.

Files are opened by pyarrow, so they may lie in any file system that it knows and every executor reaches.
"""

from __future__ import annotations

import dataclasses
import os
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from terrazzo.sources.formats import MCAP_MAGIC, header_stamp

# Opcodes of records.
HEADER, FOOTER, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, DATA_END = 1, 2, 4, 5, 6, 8, 15
FOOTER_BYTES = 9 + 20
PARTITION_BYTES = 64_000_000
LAST = 2**63 - 1


class Chunk(NamedTuple):
    first: int
    last: int
    offset: int
    length: int
    channels: frozenset[int]


def opened(path: str):
    """The file for reading at any place."""
    if "://" in path or path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(path)
    else:
        system, inner = pafs.LocalFileSystem(), path
    return system.open_input_file(inner)


def found_files(path: str, ending: str = ".mcap") -> list[str]:
    """The files with an ending under a folder, or those that a list names."""
    names = []
    for part in filter(None, (p.strip() for p in path.split(","))):
        uri = "://" in part or part.startswith("file:")
        system, inner = pafs.FileSystem.from_uri(part) if uri else (pafs.LocalFileSystem(), part)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            root = part.rstrip("/")
            names += sorted(root + i.path[len(inner.rstrip("/")) :] for i in system.get_file_info(pafs.FileSelector(inner, recursive=True)) if i.path.endswith(ending))
        elif info.type == pafs.FileType.File:
            names.append(part)
        else:
            raise FileNotFoundError(part)
    return names


def _text(body: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", body, at)
    return body[at + 4 : at + 4 + n].decode(), at + 4 + n


def _records(body: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(body):
        op, size = struct.unpack_from("<BQ", body, at)
        if at + 9 + size > len(body):
            return
        yield op, body[at + 9 : at + 9 + size]
        at += 9 + size


def _channel(record: bytes) -> tuple[int, str]:
    return struct.unpack_from("<H", record)[0], _text(record, 4)[0]


def _chunk_index(record: bytes) -> Chunk:
    first, last, offset, length, held = struct.unpack_from("<QQQQI", record)
    channels = frozenset(struct.unpack_from("<H", record, at)[0] for at in range(36, 36 + held, 10))
    return Chunk(first, last, offset, length, channels)


def index(path: str) -> tuple[dict[int, str], list[Chunk]] | None:
    """Channels and chunks of a file by its summary; None if it has none."""
    with opened(path) as file:
        size = file.size()
        if size < len(MCAP_MAGIC) or file.read_at(len(MCAP_MAGIC), 0) != MCAP_MAGIC:
            raise ValueError(f"{path} is not an MCAP file")
        if size < 2 * len(MCAP_MAGIC) + FOOTER_BYTES:
            return None
        end = file.read_at(FOOTER_BYTES + len(MCAP_MAGIC), size - FOOTER_BYTES - len(MCAP_MAGIC))
        op, length = struct.unpack_from("<BQ", end)
        if op != FOOTER or length != 20 or not end.endswith(MCAP_MAGIC):
            return None  # the file was cut off
        (start,) = struct.unpack_from("<Q", end, 9)
        if not start:
            return None
        summary = file.read_at(size - start - FOOTER_BYTES - len(MCAP_MAGIC), start)
    channels, chunks = {}, []
    for op, record in _records(summary):
        if op == CHANNEL:
            channels.update([_channel(record)])
        elif op == CHUNK_INDEX:
            chunks.append(_chunk_index(record))
    return (channels, chunks) if chunks else None


def unpacked(record: bytes) -> bytes:
    """The records of a chunk."""
    (size,) = struct.unpack_from("<Q", record, 16)
    kind, after = _text(record, 28)
    (length,) = struct.unpack_from("<Q", record, after)
    packed = record[after + 8 : after + 8 + length]
    if not kind:
        return packed
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)
    if kind == "lz4":
        return pa.decompress(packed, size, codec="lz4", asbytes=True)
    raise ValueError(f"MCAP chunk compressed with {kind}")


@dataclasses.dataclass
class Wanted:
    """Topics (all, if none are named) and times of messages, in ns, ends included."""

    topics: frozenset[str] | None = None
    start: int = 0
    end: int = LAST

    def chunk(self, chunk: Chunk, channels: dict[int, str]) -> bool:
        if chunk.last < self.start or chunk.first > self.end:
            return False
        # an index may leave the channels out, and a chunk may name its own
        return self.topics is None or not chunk.channels or any(channels.get(c) in self.topics or c not in channels for c in chunk.channels)

    def message(self, topic: str, logged: int) -> bool:
        return (self.topics is None or topic in self.topics) and self.start <= logged <= self.end


@dataclasses.dataclass
class ChunkRun(InputPartition):
    """Chunks of a file that one task reads; the whole file, record by record, if none are named."""

    path: str
    channels: dict[int, str]
    chunks: list[tuple[int, int]] | None


def _messages(body: bytes, channels: dict[int, str], wanted: Wanted):
    for op, record in _records(body):
        if op == CHANNEL:
            channels.update([_channel(record)])
        elif op == MESSAGE:
            number, _, logged, _ = struct.unpack_from("<HIQQ", record)
            topic = channels.get(number, "")
            if wanted.message(topic, logged):
                yield topic, logged, record[22:]


def read_run(run: ChunkRun, wanted: Wanted):
    """(topic, time in the file, payload) of the wanted messages of a run."""
    channels = dict(run.channels)
    with opened(run.path) as file:
        if run.chunks is not None:
            for offset, length in run.chunks:
                yield from _messages(unpacked(file.read_at(length, offset)[9:]), channels, wanted)
            return
        at, size = len(MCAP_MAGIC), file.size()
        while at + 9 <= size:
            op, length = struct.unpack("<BQ", file.read_at(9, at))
            if op in (FOOTER, DATA_END) or at + 9 + length > size:
                return
            if op in (CHANNEL, MESSAGE, CHUNK):
                record = file.read_at(length, at + 9)
                body = unpacked(record) if op == CHUNK else struct.pack("<BQ", op, length) + record
                yield from _messages(body, channels, wanted)
            at += 9 + length


class McapReader(DataSourceReader):
    def __init__(self, path: str, wanted: Wanted, partition_bytes: int):
        self.path, self.wanted, self.partition_bytes = path, wanted, partition_bytes

    def pushFilters(self, filters: list[Filter]):
        """Topics and times choose chunks; times of chunks are those of the file, so Spark filters once more."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if column == ("topic",) and isinstance(f, (EqualTo, In)):
                topics = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted.topics = topics if self.wanted.topics is None else self.wanted.topics & topics
            elif column == ("logged",) and isinstance(f, GreaterThanOrEqual):
                self.wanted.start = max(self.wanted.start, f.value)
            elif column == ("logged",) and isinstance(f, (LessThanOrEqual, LessThan)):
                self.wanted.end = min(self.wanted.end, f.value)
            yield f

    def partitions(self) -> list[ChunkRun]:
        runs = []
        for path in found_files(self.path):
            known = index(path)
            if known is None:
                runs.append(ChunkRun(path, {}, None))
                continue
            channels, chunks = known
            held, size = [], 0
            for chunk in sorted((c for c in chunks if self.wanted.chunk(c, channels)), key=lambda c: c.offset):
                if held and size + chunk.length > self.partition_bytes:
                    runs.append(ChunkRun(path, channels, held))
                    held, size = [], 0
                held.append((chunk.offset, chunk.length))
                size += chunk.length
            if held:
                runs.append(ChunkRun(path, channels, held))
        return runs

    def read(self, partition: ChunkRun):
        for topic, logged, payload in read_run(partition, self.wanted):
            yield partition.path, topic, header_stamp(payload, logged), logged, payload


class McapSource(DataSource):
    """spark.read.format("mcap").options(topics="/a,/b", start=.., end=.., partition_bytes=..).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        return "path string, topic string, stamp long, logged long, payload binary"

    def reader(self, schema) -> McapReader:
        topics = self.options.get("topics")
        wanted = Wanted(frozenset(t.strip() for t in topics.split(",")) if topics else None, int(self.options.get("start", 0)), int(self.options.get("end", LAST)))
        return McapReader(self.options["path"], wanted, int(self.options.get("partition_bytes", PARTITION_BYTES)))


def messages(spark: SparkSession, path: str, topics: list[str] | None = None, **options) -> DataFrame:
    """path, topic, stamp (header's, else the file's), logged (the file's, in ns), payload of a file, a list or a folder."""
    spark.dataSource.register(McapSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("mcap").options(**{k: str(v) for k, v in options.items()})
    if topics:
        reader = reader.option("topics", ",".join(topics))
    return reader.load(os.fspath(path))
