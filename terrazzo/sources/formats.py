"""Parsers and builders of the binary formats, on bytes."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np

# fixed values of the formats
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
PLY_ORDER = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
MCAP_MAGIC = b"\x89MCAP0\r\n"
SENS_VERSION = 4
SENS_COLOR = {-1: "unknown", 0: "raw", 1: "png", 2: "jpeg"}
SENS_DEPTH = {-1: "unknown", 0: "raw_ushort", 1: "zlib_ushort", 2: "occi_ushort"}


def ply_header(data: bytes) -> tuple[str, list, int]:
    """(byte order, elements as (name, count, properties), start of the body)."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    body = data.index(b"\n", end) + 1
    order, elements = None, []
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            order = PLY_ORDER[words[1]]
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property":
            kind = (words[4], PLY_TYPES[words[2]], PLY_TYPES[words[3]]) if words[1] == "list" else (words[2], None, PLY_TYPES[words[1]])
            elements[-1][2].append(kind)
    if order is None:
        raise ValueError("a PLY header without a format")
    return order, elements, body


def ply_vertex_count(data: bytes) -> int:
    """The number of vertices, from the header alone."""
    return next(n for name, n, _ in ply_header(data)[1] if name == "vertex")


def read_ply(data: bytes) -> dict[str, dict[str, np.ndarray | list]]:
    """element -> property -> values; a list property gives a list of arrays."""
    order, elements, at = ply_header(data)
    out: dict = {}
    words = iter(data[at:].split()) if order == "" else None
    for name, count, properties in elements:
        if words is None and all(length is None for _, length, _ in properties):
            kind = np.dtype([(p, order + t) for p, _, t in properties])
            rows = np.frombuffer(data, kind, count, at)
            at += kind.itemsize * count
            out[name] = {p: rows[p] for p, _, _ in properties}
            continue
        columns: dict[str, list] = {p: [] for p, _, _ in properties}
        for _ in range(count):
            for p, length, t in properties:
                if words is not None:
                    n = int(next(words)) if length else 1
                    values = np.array([float(next(words)) for _ in range(n)]).astype(t)
                else:
                    n = 1
                    if length:
                        n = int(np.frombuffer(data, order + length, 1, at)[0])
                        at += np.dtype(length).itemsize
                    values = np.frombuffer(data, order + t, n, at)
                    at += np.dtype(t).itemsize * n
                columns[p].append(values if length else values[0])
        out[name] = {p: columns[p] if length else np.array(columns[p], t) for p, length, t in properties}
    return out


def triangles(faces: list) -> np.ndarray:
    """(face, a, b, c): polygons as fans around their first corner; under three corners is an error."""
    out = []
    for i, face in enumerate(faces):
        if len(face) < 3:
            raise ValueError(f"face {i} has {len(face)} corners")
        out += [(i, int(face[0]), int(face[k]), int(face[k + 1])) for k in range(1, len(face) - 1)]
    return np.array(out, np.int64).reshape(-1, 4)


def write_ply(columns: dict[str, np.ndarray]) -> bytes:
    """A binary PLY with one element, vertex."""
    back = {"f4": "float", "f8": "double", "u1": "uchar", "i4": "int", "i8": "int"}
    kinds = {k: "i4" if v.dtype.str[1:] == "i8" else v.dtype.str[1:] for k, v in columns.items()}
    n = len(next(iter(columns.values())))
    rows = np.empty(n, [(k, "<" + t) for k, t in kinds.items()])
    for k, v in columns.items():
        rows[k] = v
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property {back[t]} {k}\n" for k, t in kinds.items()) + "end_header\n"
    return head.encode() + rows.tobytes()


def read_png(data: bytes) -> np.ndarray:
    """Pixels of a non-interlaced PNG of 8 or 16 bits, grey or colour: height x width (x channels)."""
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG file")
    at, packed, head = len(PNG_MAGIC), [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height, depth, color, _, _, interlace = head
    if depth not in (8, 16) or color not in PNG_CHANNELS or interlace:
        raise ValueError("only plain PNG of 8 or 16 bits is read")
    channels = PNG_CHANNELS[color]
    pixel = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * pixel)
    out = np.zeros((height, width * pixel), np.uint8)
    above = np.zeros(width * pixel, np.uint8)
    for y in range(height):
        line, kind = raw[y, 1:], raw[y, 0]
        if kind == 0:
            row = line
        elif kind == 2:
            row = line + above
        elif kind == 1:
            row = line.reshape(width, pixel).cumsum(axis=0, dtype=np.uint8).reshape(-1)
        else:
            row = np.zeros_like(line)
            for x in range(len(line)):
                left = int(row[x - pixel]) if x >= pixel else 0
                up, corner = int(above[x]), int(above[x - pixel]) if x >= pixel else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                row[x] = (int(line[x]) + guess) & 255
        out[y] = above = row
    image = out.reshape(height, width, channels, depth // 8)
    image = image[..., 0] if depth == 8 else (image[..., 0].astype(np.uint16) << 8 | image[..., 1])
    return image[..., 0] if channels == 1 else image


def write_png(image: np.ndarray) -> bytes:
    """A PNG of an 8- or 16-bit grey or 8-bit RGB image."""
    height, width = image.shape[:2]
    depth = 16 if image.dtype == np.uint16 else 8
    lines = image.astype(">u2").view(np.uint8).reshape(height, -1) if depth == 16 else image.astype(np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), lines], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def depth_pixels(image: np.ndarray) -> np.ndarray:
    """(u, v, metres) of the pixels with a positive depth in millimetres."""
    v, u = np.nonzero(image > 0)
    return np.stack([u, v, image[v, u] / 1000.0], axis=1)


def read_sens(stream) -> tuple[dict, object]:
    """Header of a version 4 sensor stream, and an iterator of its frames.

    stream: a binary file. A frame is (index, camera_to_world, color stamp, depth stamp, color, depth).
    """
    take = lambda layout: struct.unpack("<" + layout, stream.read(struct.calcsize("<" + layout)))
    (version,) = take("I")
    if version != SENS_VERSION:
        raise ValueError(f"sensor stream of version {version}")
    (size,) = take("Q")
    head = {"version": version, "name": stream.read(size).decode()}
    for key in ("intrinsic_color", "extrinsic_color", "intrinsic_depth", "extrinsic_depth"):
        head[key] = list(take("16f"))
    color, depth = take("ii")
    head |= {"color": SENS_COLOR[color], "depth": SENS_DEPTH[depth]}
    head |= dict(zip(("color_width", "color_height", "depth_width", "depth_height"), take("IIII")))
    (head["depth_shift"],) = take("f")
    (head["frames"],) = take("Q")

    def frames():
        for i in range(head["frames"]):
            pose = list(take("16f"))
            color_stamp, depth_stamp, color_size, depth_size = take("QQQQ")
            yield i, pose, color_stamp, depth_stamp, stream.read(color_size), stream.read(depth_size)

    return head, frames()


def sens_depth(head: dict, data: bytes) -> np.ndarray:
    """Depth image of a frame in the stream's units."""
    raw = zlib.decompress(data) if head["depth"] == "zlib_ushort" else data
    return np.frombuffer(raw, "<u2").reshape(head["depth_height"], head["depth_width"])


def mcap_messages(data: bytes, topics: set[str] | None = None):
    """(topic, bag stamp in ns, payload) of an MCAP file, chunks included, in file order."""
    if not data.startswith(MCAP_MAGIC):
        raise ValueError("not an MCAP file")
    channels: dict[int, str] = {}

    def text(body: bytes, at: int) -> tuple[str, int]:
        (n,) = struct.unpack_from("<I", body, at)
        return body[at + 4 : at + 4 + n].decode(), at + 4 + n

    def records(body: bytes, at: int):
        while at + 9 <= len(body):
            op, size = struct.unpack_from("<BQ", body, at)
            if at + 9 + size > len(body):
                return
            yield op, body[at + 9 : at + 9 + size]
            at += 9 + size

    def messages(body: bytes, at: int):
        for op, record in records(body, at):
            if op == 4:
                number, _ = struct.unpack_from("<HH", record)
                channels[number] = text(record, 4)[0]
            elif op == 5:
                number, _, stamp, _ = struct.unpack_from("<HIQQ", record)
                topic = channels.get(number, "")
                if topics is None or topic in topics:
                    yield topic, stamp, record[22:]
            elif op == 6:
                kind, after = text(record, 28)
                (size,) = struct.unpack_from("<Q", record, after)
                packed = record[after + 8 : after + 8 + size]
                if kind == "zstd":
                    import zstandard

                    packed = zstandard.ZstdDecompressor().decompress(packed, max_output_size=struct.unpack_from("<Q", record, 16)[0])
                elif kind:
                    raise ValueError(f"MCAP chunk compressed with {kind}")
                yield from messages(packed, 0)

    yield from messages(data, len(MCAP_MAGIC))


def header_stamp(payload: bytes, bag_ns: int) -> int:
    """Stamp of a message's header in ns (after the 4 bytes of CDR), else that of the bag."""
    seconds, nanos = struct.unpack_from("<iI", payload, 4) if len(payload) >= 12 else (0, 0)
    stamp = seconds * 1_000_000_000 + nanos
    return stamp if stamp > 0 else bag_ns


def zip_frames(data: bytes) -> list[tuple[str, int, bytes]]:
    """(kind, frame, content) of pose, rgb and depth members; the three must hold the same frames."""
    found: dict[str, dict[int, bytes]] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for name in archive.namelist():
            parts = name.strip("/").split("/")
            stem = parts[-1].rsplit(".", 1)[0]
            digits = stem[len(stem.rstrip("0123456789")) :]
            if len(parts) > 1 and digits and not name.endswith("/"):
                found.setdefault(parts[-2], {})[int(digits)] = archive.read(name)
    frames = {frozenset(v) for k, v in found.items() if k in ("pose", "rgb", "depth")}
    if len(frames) != 1 or not {"pose", "rgb", "depth"} <= found.keys():
        raise ValueError("pose, rgb and depth differ in their frames")
    return [(k, i, found[k][i]) for k in ("pose", "rgb", "depth") for i in sorted(found[k])]


def instance_arrays(data: bytes) -> dict[str, np.ndarray]:
    """Arrays of an instance prediction, held against the whole contract."""
    with np.load(io.BytesIO(data), allow_pickle=False) as npz:
        a = {k: npz[k] for k in npz.files}
    points, index, offset = a["points"], a["hypothesis_indices"], a["hypothesis_offsets"]
    features, budget = a["point_features"], int(a["K"])
    checks = {
        "points are N x 3 and finite": points.ndim == 2 and points.shape[1] == 3 and bool(np.isfinite(points).all()),
        "offsets start at 0, never fall and end at the last index": len(offset) > 0 and offset[0] == 0 and bool((np.diff(offset) >= 0).all()) and offset[-1] == len(index),
        "indices are points": not len(index) or (index.min() >= 0 and index.max() < len(points)),
        "features are one finite row a point": features.ndim == 2 and len(features) == len(points) and bool(np.isfinite(features).all()),
        "no hypothesis holds a point twice": all(len(np.unique(index[s:e])) == e - s for s, e in zip(offset[:-1], offset[1:])),
        "no point is in more than K hypotheses": not len(index) or np.bincount(index).max() <= budget,
    }
    broken = [k for k, ok in checks.items() if not ok]
    if broken:
        raise ValueError("; ".join(broken))
    return a


def pose_arrays(data: bytes) -> np.ndarray:
    """Camera-to-world matrices of a pose file whose frames are 0..n-1."""
    with np.load(io.BytesIO(data), allow_pickle=False) as npz:
        poses, index = npz["data"], npz["inds"]
    if not np.array_equal(index, np.arange(len(poses))):
        raise ValueError("the frames of a pose file must be 0..n-1")
    return poses
