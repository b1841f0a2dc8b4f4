"""PLY files in ranges of bytes."""

from __future__ import annotations

import numpy as np
import pytest

from terrazzo.sources import formats, ply


def mesh(faces, order="little", text=False, n=50) -> bytes:
    """A file with vertices and faces of any size, each with an owner."""
    rng = np.random.default_rng(n)
    xyz = rng.normal(size=(n, 3)).astype("f4")
    kind = "ascii" if text else f"binary_{order}_endian"
    head = f"ply\nformat {kind} 1.0\ncomment made here\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nproperty ushort object_id\nend_header\n".encode()
    if text:
        return head + "\n".join(" ".join(map(str, p)) for p in xyz.tolist()).encode() + b"\n" + "\n".join(f"{len(f)} {' '.join(map(str, f))} {i % 7}" for i, f in enumerate(faces)).encode() + b"\n"
    mark = "<" if order == "little" else ">"
    body = xyz.astype(mark + "f4").tobytes()
    return head + body + b"".join(bytes([len(f)]) + np.array(f, mark + "i4").tobytes() + np.array([i % 7], mark + "u2").tobytes() for i, f in enumerate(faces))


TRIANGLES = [[i, i + 1, i + 2] for i in range(40)]
MIXED = [[i + k for k in range(3 + i % 4)] for i in range(40)]


@pytest.mark.parametrize("faces, how", [(TRIANGLES, {}), (MIXED, {}), (TRIANGLES, {"order": "big"}), (MIXED, {"order": "big"}), (MIXED, {"text": True})])
def test_ranges_equal_the_whole_file(spark, tmp_path, faces, how):
    data = mesh(faces, **how)
    (tmp_path / "m.ply").write_bytes(data)
    whole = formats.read_ply(data)
    points, found = ply.points(spark, tmp_path, 100), ply.triangles(spark, tmp_path, 90)
    many = 1 if "text" in how else 5
    assert points.rdd.getNumPartitions() >= many and found.rdd.getNumPartitions() >= many
    rows = sorted(points.collect(), key=lambda r: r.point_id)
    assert [r.point_id for r in rows] == list(range(50)) and all(r.nx is None for r in rows)
    assert np.array_equal([[r.x, r.y, r.z] for r in rows], np.stack([whole["vertex"][c] for c in "xyz"], 1).astype(float))
    t = formats.triangles(whole["face"]["vertex_indices"])
    want = sorted((int(f), int(whole["face"]["object_id"][f]), int(a), int(b), int(c)) for f, a, b, c in t)
    assert sorted((r.face, r.object_id, r.a, r.b, r.c) for r in found.collect()) == want


def test_a_range_of_a_sparse_file_of_three_gigabytes(tmp_path):
    """Only the header and the range are read."""
    n, path = 100_000_000, tmp_path / "big.ply"
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty float nx\nproperty float ny\nproperty float nz\nproperty float q\nproperty float w\nend_header\n".encode()
    with open(path, "wb") as file:
        file.write(head)
        file.seek(len(head) + 32 * (n - 1))
        file.write(np.arange(8, dtype="f4").tobytes())
    parts = ply.planned(str(path), "vertex")
    assert len(parts) == 100 and sum(p.count for p in parts) == n and max(p.length for p in parts) <= ply.RANGE_BYTES
    last = ply.columns_of(ply.Rows(str(path), "vertex", n - 1, 1, len(head) + 32 * (n - 1), 32))
    assert [float(last[c][0]) for c in ("x", "y", "z", "nx", "w")] == [0, 1, 2, 3, 7]


def test_the_pass_over_faces_reads_blocks(tmp_path):
    data = mesh(MIXED)
    (tmp_path / "m.ply").write_bytes(data)
    shape = ply.layout(str(tmp_path / "m.ply"))
    count, properties = shape.named("face")
    for block in (7, 64, 1 << 20):
        parts = ply._noted(str(tmp_path / "m.ply"), "face", shape.before("face"), count, properties, shape.order, 120, block)
        assert [p.first for p in parts] == np.cumsum([0, *[p.count for p in parts]])[:-1].tolist() and sum(p.count for p in parts) == 40
        assert sum(p.length for p in parts) == len(data) - shape.before("face")


def test_cut_files_are_an_error(tmp_path):
    (tmp_path / "m.ply").write_bytes(mesh(MIXED)[:-9])
    with pytest.raises(ValueError, match="ends within"):
        ply.planned(str(tmp_path / "m.ply"), "face")
