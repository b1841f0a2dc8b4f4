"""PLY files by ranges of bytes: vertices and faces of one large file in many partitions.

Vertices of a binary file have one size, so a range of them is a range of bytes. So have faces where all
are triangles, which the file's size tells; where it says otherwise, one pass over the faces notes where
each range starts, a block of the file at a time. Text files, and those with lists before the element
that is read, are one partition.
"""

from __future__ import annotations

import dataclasses
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrazzo.sources import formats
from terrazzo.sources.mcap import found_files, opened

RANGE_BYTES = 32_000_000
#: Rows of a batch that goes to Spark.
BATCH_ROWS = 65_536


class Layout(NamedTuple):
    """Byte order ("" for text), elements as (name, count, properties), start of the body, size of the file."""

    order: str
    elements: list
    start: int
    size: int

    def before(self, element: str) -> int | None:
        """Where an element starts; None if that isn't known from the header."""
        at = self.start
        for name, count, properties in self.elements:
            if name == element:
                return at if self.order else None
            if any(length for _, length, _ in properties):
                return None
            at += count * sum(np.dtype(t).itemsize for _, _, t in properties)
        raise ValueError(f"no element {element}")

    def named(self, element: str) -> tuple[int, list]:
        return next((count, properties) for name, count, properties in self.elements if name == element)


def layout(path: str) -> Layout:
    with opened(path) as file:
        head, size = b"", file.size()
        while b"end_header" not in head or b"\n" not in head[head.index(b"end_header") :]:
            more = file.read_at(min(65_536, size - len(head)), len(head))
            if not more:
                break
            head += more
    return Layout(*formats.ply_header(head), size)


@dataclasses.dataclass
class Rows(InputPartition):
    """Rows of an element in a range of bytes; the whole file if there is no range."""

    path: str
    element: str
    first: int
    count: int
    offset: int | None = None
    length: int = 0


def _ranges(path: str, element: str, at: int, count: int, stride: int, most: int) -> list[Rows]:
    step = max(1, most // stride)
    return [Rows(path, element, i, min(step, count - i), at + i * stride, min(step, count - i) * stride) for i in range(0, count, step)]


def _walk(data: bytes, at: int, properties: list, order: str) -> int | None:
    """Where a row ends that starts at `at`; None if the data end before."""
    for _, length, kind in properties:
        n = 1
        if length:
            width = np.dtype(length).itemsize
            if at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big" if order == ">" else "little")
            at += width
        at += n * np.dtype(kind).itemsize
        if at > len(data):
            return None
    return at


def _noted(path: str, element: str, at: int, count: int, properties: list, order: str, most: int, block: int = 1 << 24) -> list[Rows]:
    """Ranges of rows of different sizes."""
    found, data, base, place, first = [], b"", at, 0, 0
    start = at
    with opened(path) as file:
        for row in range(count):
            end = _walk(data, place, properties, order)
            while end is None:
                more = file.read_at(block, base + len(data))
                if not more:
                    raise ValueError(f"{path} ends within its {element}s")
                data, base, place = data[place:] + more, base + place, 0
                end = _walk(data, place, properties, order)
            place = end
            if base + place - start >= most or row == count - 1:
                found.append(Rows(path, element, first, row + 1 - first, start, base + place - start))
                start, first = base + place, row + 1
    return found


def planned(path: str, element: str, most: int = RANGE_BYTES) -> list[Rows]:
    shape = layout(path)
    count, properties = shape.named(element)
    at = shape.before(element)
    if at is None:
        return [Rows(path, element, 0, count)]
    widths = [(np.dtype(length).itemsize if length else 0, np.dtype(t).itemsize) for _, length, t in properties]
    if not any(w for w, _ in widths):
        return _ranges(path, element, at, count, sum(t for _, t in widths), most)
    three = sum(w + 3 * t if w else t for w, t in widths)
    if shape.elements[-1][0] == element and shape.size - at == count * three:
        return _ranges(path, element, at, count, three, most)
    return _noted(path, element, at, count, properties, shape.order, most)


def columns_of(part: Rows) -> dict[str, np.ndarray | list]:
    """Property -> values of a partition's rows; a list property gives a list of arrays."""
    if part.offset is None:
        with opened(part.path) as file:
            return formats.read_ply(file.read_at(file.size(), 0))[part.element]
    shape = layout(part.path)
    _, properties = shape.named(part.element)
    with opened(part.path) as file:
        data = file.read_at(part.length, part.offset)
    fields = []
    for name, length, kind in properties:
        fields += [(f"{name} length", shape.order + length), (name, shape.order + kind, 3)] if length else [(name, shape.order + kind)]
    kind = np.dtype(fields)
    if len(data) == part.count * kind.itemsize:  # numbers, and lists of three if there are lists
        rows = np.frombuffer(data, kind)
        if all((rows[f"{name} length"] == 3).all() for name, length, _ in properties if length):
            return {name: list(rows[name]) if length else rows[name] for name, length, _ in properties}
    out: dict[str, list] = {name: [] for name, _, _ in properties}
    at = 0
    for _ in range(part.count):
        for name, length, kind in properties:
            n = 1
            if length:
                n = int(np.frombuffer(data, shape.order + length, 1, at)[0])
                at += np.dtype(length).itemsize
            values = np.frombuffer(data, shape.order + kind, n, at)
            at += n * np.dtype(kind).itemsize
            out[name].append(values if length else values[0])
    if at != len(data):
        raise ValueError(f"{part.path}: faces don't fill their range")
    return {name: out[name] if length else np.array(out[name]) for name, length, _ in properties}


class PlyReader(DataSourceReader):
    element = ""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Rows]:
        return [part for path in found_files(self.path, ".ply") for part in planned(path, self.element, self.most)]

    def read(self, partition: Rows):
        columns = self.rows(partition)
        for i in range(0, len(next(iter(columns.values()))), BATCH_ROWS):
            yield pa.RecordBatch.from_pydict({k: pa.array(v[i : i + BATCH_ROWS], from_pandas=k in ("nx", "ny", "nz")) if k != "path" else pa.array(v[i : i + BATCH_ROWS], pa.string()) for k, v in columns.items()})

    def rows(self, part: Rows) -> dict:
        raise NotImplementedError


class PointReader(PlyReader):
    element = "vertex"

    def rows(self, part: Rows) -> dict:
        found = columns_of(part)
        n = part.count
        return {"path": [part.path] * n, "point_id": part.first + np.arange(n)} | {c: np.asarray(found[c], np.float64) if c in found else np.full(n, np.nan) for c in ("x", "y", "z", "nx", "ny", "nz")}


class FaceReader(PlyReader):
    element = "face"

    def rows(self, part: Rows) -> dict:
        found = columns_of(part)
        corners = found.get("vertex_indices", found.get("vertex_index"))
        t = formats.triangles(corners)
        owner = np.asarray(found["object_id"], np.int64)[t[:, 0]] if "object_id" in found else np.full(len(t), -1, np.int64)
        return {"path": [part.path] * len(t), "face": part.first + t[:, 0], "object_id": owner, "a": t[:, 1], "b": t[:, 2], "c": t[:, 3]}


class PointSource(DataSource):
    """spark.read.format("ply_points").option("range_bytes", ..).load(path)."""

    columns, kind = "path string, point_id long, x double, y double, z double, nx double, ny double, nz double", PointReader

    @classmethod
    def name(cls) -> str:
        return "ply_points"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> PlyReader:
        return self.kind(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class FaceSource(PointSource):
    columns, kind = "path string, face long, object_id long, a long, b long, c long", FaceReader

    @classmethod
    def name(cls) -> str:
        return "ply_faces"


def _read(spark: SparkSession, source: type[DataSource], path: str, range_bytes: int) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("range_bytes", range_bytes).load(os.fspath(path))


def points(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, point_id and the vertex columns x, y, z, nx, ny, nz (null where the file has none)."""
    return _read(spark, PointSource, path, range_bytes)


def triangles(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, face, object_id, a, b, c: polygons as fans."""
    return _read(spark, FaceSource, path, range_bytes)
