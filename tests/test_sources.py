"""Formats round trip; readers refuse what breaks their contract."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from terrazzo.sources import formats, scenes, sinks


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for image in (rng.integers(0, 65536, (5, 7)).astype(np.uint16), rng.integers(0, 256, (4, 6, 3)).astype(np.uint8)):
        assert np.array_equal(formats.read_png(formats.write_png(image)), image)


def test_ply_round_trip_and_fans():
    data = formats.write_ply({"x": np.arange(3, dtype="f4"), "y": np.zeros(3, "f4"), "z": np.ones(3, "f4"), "instance": np.arange(3)})
    assert b"property int instance" in data and formats.ply_vertex_count(data) == 3
    assert formats.read_ply(data)["vertex"]["x"].tolist() == [0, 1, 2]
    assert formats.triangles([[0, 1, 2, 3]]).tolist() == [[0, 0, 1, 2], [0, 0, 2, 3]]
    text = b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n"
    assert formats.read_ply(text)["face"]["vertex_indices"][0].tolist() == [0, 1, 2]


def sens_bytes(frames=2):
    pose = struct.pack("<16f", *np.eye(4).ravel())
    depth = zlib.compress(np.full((2, 3), 1500, "<u2").tobytes())
    head = struct.pack("<I", 4) + struct.pack("<Q", 4) + b"test" + pose * 4 + struct.pack("<ii", 2, 1) + struct.pack("<IIII", 3, 2, 3, 2) + struct.pack("<f", 1000.0) + struct.pack("<Q", frames)
    return head + b"".join(pose + struct.pack("<QQQQ", i, i, 3, len(depth)) + b"jpg" + depth for i in range(frames))


def test_sens_source(spark, tmp_path):
    (tmp_path / "a.sens").write_bytes(sens_bytes())
    spark.dataSource.register(scenes.SensSource)
    rows = spark.read.format("sens").load(str(tmp_path / "a.sens")).orderBy("frame").collect()
    assert [r["frame"] for r in rows] == [0, 1] and rows[0]["color_codec"] == "jpeg"
    head, _ = formats.read_sens(io.BytesIO(sens_bytes()))
    assert formats.sens_depth(head, bytes(rows[0]["depth"])).tolist() == [[1500] * 3] * 2


def test_mcap_with_chunks_and_stamps():
    record = lambda op, body: struct.pack("<BQ", op, len(body)) + body
    text = lambda s: struct.pack("<I", len(s)) + s.encode()
    channel = record(4, struct.pack("<HH", 1, 0) + text("/color") + text("cdr") + struct.pack("<I", 0))
    message = record(5, struct.pack("<HIQQ", 1, 0, 77, 77) + b"\0\1\0\0" + struct.pack("<iI", 2, 5))
    inner = channel + message
    chunk = record(6, struct.pack("<QQQI", 0, 0, len(inner), 0) + text("") + struct.pack("<Q", len(inner)) + inner)
    (found,) = formats.mcap_messages(formats.MCAP_MAGIC + chunk + formats.MCAP_MAGIC, {"/color"})
    assert found[:2] == ("/color", 77) and formats.header_stamp(found[2], 77) == 2_000_000_005
    assert formats.header_stamp(b"\0" * 12, 77) == 77


def test_zip_needs_equal_frames():
    def packed(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, b"x")
        return out.getvalue()

    assert len(formats.zip_frames(packed(["s/pose/p_1.txt", "s/rgb/c_1.png", "s/depth/d_1.png"]))) == 3
    with pytest.raises(ValueError, match="differ"):
        formats.zip_frames(packed(["s/pose/p_1.txt", "s/rgb/c_2.png", "s/depth/d_1.png"]))


def prediction(**change):
    a = {"points": np.zeros((4, 3), "f4"), "hypothesis_indices": np.array([0, 1, 1, 2], "i4"), "hypothesis_offsets": np.array([0, 2, 4], "i4"), "K": np.int32(2), "point_features": np.ones((4, 2), "f4")} | change
    out = io.BytesIO()
    np.savez(out, **a)
    return out.getvalue()


def test_instance_files(spark, tmp_path):
    (tmp_path / "s.npz").write_bytes(prediction())
    memb, points = scenes.instances(spark, str(tmp_path))
    assert sorted((r["hyp_id"], r["point_id"]) for r in memb.collect()) == [(0, 0), (0, 1), (1, 1), (1, 2)] and points.count() == 4
    packed = [(r["indices"], r["offset_end"]) for r in scenes.pack(memb).orderBy("hyp_id").collect()]
    assert packed == [([0, 1], 2), ([1, 2], 4)]
    for change in ({"K": np.int32(1)}, {"hypothesis_offsets": np.array([0, 3], "i4")}, {"hypothesis_indices": np.array([0, 1, 1, 9], "i4")}):
        with pytest.raises(ValueError):
            formats.instance_arrays(prediction(**change))


def test_pose_files_are_contiguous():
    out = io.BytesIO()
    np.savez(out, data=np.eye(4)[None], inds=np.array([1]))
    with pytest.raises(ValueError):
        formats.pose_arrays(out.getvalue())


def test_scene_folder(spark, tmp_path):
    meta = {"format": "any_rgbd_v1", "name": "a", "width": 2, "height": 1, "fps": 5.0, "frames": [{"k": "0"}, {"k": "1"}]}
    (tmp_path / "metadata.json").write_text(json.dumps(meta, indent=1))
    rows = scenes.metadata(spark, str(tmp_path / "metadata.json"))
    frames = scenes.frames(rows)
    assert [r["depth_path"] for r in frames.orderBy("frame").collect()] == ["depth/000000.png", "depth/000001.png"]
    assert scenes.frame_at(frames, -1).first()["frame"] == 1
    with pytest.raises(Exception, match="out of range"):
        scenes.frame_at(frames, 2).collect()
    (tmp_path / "bad.json").write_text(json.dumps(meta | {"fps": 0.0}))
    with pytest.raises(Exception, match="fps must be positive"):
        scenes.metadata(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "depth").mkdir()
    (tmp_path / "depth" / "000000.png").write_bytes(formats.write_png(np.array([[1000, 0]], np.uint16)))
    assert [tuple(r) for r in scenes.depth_pixels(spark, str(tmp_path / "depth")).collect()] == [(0, 0, 0, 1.0)]
    (tmp_path / "pose").mkdir()
    for i, first in enumerate(("1", "nan")):
        (tmp_path / "pose" / f"{i:06d}.txt").write_text(" ".join([first] + ["0"] * 15))
    got = {r["frame"]: r["pose"] for r in scenes.poses(spark, str(tmp_path / "pose")).collect()}
    assert got[0][0] == 1.0 and got[1] is None
    assert scenes.same_frames(frames.select("frame"), scenes.poses(spark, str(tmp_path / "pose"))).count() == 0


def test_annotation_join(spark):
    from terrazzo import schemas

    seg = spark.createDataFrame([([10, 10, 20, 30],)], schemas.SEGMENTS_JSON)
    agg = spark.createDataFrame([([(0, [10], "floor"), (7, [20], "chair")],)], schemas.AGGREGATION_JSON)
    rows = scenes.annotation(seg, agg).orderBy("point_id").collect()
    assert [r["object"] for r in rows] == [0, 0, 7, -1] and rows[2]["label"] == "chair"


def test_class_conflicts(spark):
    ok = spark.createDataFrame([(1, " Big  Chair"), (1, "big chair")], "class_id int, name string")
    assert scenes.class_names(ok).first()["name"] == "big chair"
    with pytest.raises(Exception, match="a class has one name"):
        scenes.class_names(spark.createDataFrame([(1, "a"), (1, "b")], "class_id int, name string")).collect()


def test_metric_files_and_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"s1": {"ar": 0.5}, "mean": {"ar": 0.5}}))
    (tmp_path / "n.json").write_text("{broken")
    rows = scenes.metric_rows(spark, str(tmp_path)).collect()
    assert [(r["scene"], r["value"]) for r in rows if r["scene"]] == [("s1", 0.5)] and any(r["corrupt"] for r in rows)
    files = spark.createDataFrame([("s", "a", 1, 2), ("s", "b", 3, 4)], "scene string, name string, size long, modified long")
    one = scenes.manifest(files)
    assert scenes.complete(one, one).count() == 1


EYE = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}/a/{i}.bin", bytes([i])) for i in range(6)], sinks.CONTENT).repartition(3)
    sinks.write_files(rows, str(tmp_path))
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*.bin")} == {f"s{i}/a/{i}.bin": bytes([i]) for i in range(6)}
    sinks.write_files(rows.limit(0).union(spark.createDataFrame([("s0/a/0.bin", b"new")], sinks.CONTENT)), str(tmp_path))
    assert (tmp_path / "s0" / "a" / "0.bin").read_bytes() == b"new" and len(list(tmp_path.rglob("*.bin"))) == 6
    for bad in ([("x", b"1"), ("x", b"2")], [("../x", b"1")]):
        with pytest.raises(Exception, match="name of another|outside its folder"):
            sinks.write_files(spark.createDataFrame(bad, sinks.CONTENT), str(tmp_path / "bad"))
    assert not [p for p in tmp_path.rglob("*") if p.name in ("x",) or p.name.startswith("_staged")]
    sinks.write_files(spark.createDataFrame([("only", b"1")], sinks.CONTENT), str(tmp_path), "overwrite")
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["only"]


def test_scene_files_round_trip(spark, tmp_path):
    """What the writers make, the readers take."""
    meta = spark.createDataFrame([("a", "any_rgbd_v1", "a", 3, 2, 5.0, [{"k": "0"}, {"k": "1"}], {})], "scene string, format string, name string, width int, height int, fps double, frames array<map<string,string>>, source map<string,string>")
    camera = spark.createDataFrame([("a", "any_pinhole_intrinsics_v1", "pinhole", 3, 2, 1.0, 1.0, 0.0, 0.0)], "scene string, format string, camera_model string, width int, height int, fx double, fy double, cx double, cy double")
    path = spark.createDataFrame([("a", i, EYE if i else None) for i in range(2)], "scene string, frame long, pose array<double>")
    depth = spark.createDataFrame([("a", 0, 0, 1, 1.5), ("a", 0, 2, 0, 0.001), ("a", 1, 1, 1, 2.0)], "scene string, frame long, u int, v int, depth double")
    color = spark.createDataFrame([("a", 0, u, v, 1.0, u / 2, v / 1) for u in range(3) for v in range(2)], "scene string, frame long, u int, v int, r double, g double, b double")
    sizes = meta.select("scene", "width", "height")
    for rows in (sinks.json_files(meta, "metadata.json"), sinks.json_files(camera, "intrinsics.json"), sinks.pose_texts(path), sinks.pose_files(path.where("pose is not null").withColumn("frame", F.col("frame") - 1)), sinks.image_files(depth, sizes, "depth"), sinks.image_files(color, sizes, "color")):
        sinks.write_files(rows, str(tmp_path))
    folder = str(tmp_path / "a")
    assert scenes.metadata(spark, f"{folder}/metadata.json").first()["n_frames"] == 2
    assert scenes.intrinsics(spark, f"{folder}/intrinsics.json").first()["fx"] == 1.0
    assert {r["frame"]: r["pose"] for r in scenes.poses(spark, f"{folder}/pose").collect()} == {0: None, 1: EYE}
    assert [r["pose"] for r in scenes.pose_file(spark, folder).collect()] == [EYE]
    assert sorted(tuple(r) for r in scenes.depth_pixels(spark, f"{folder}/depth").collect()) == [(0, 0, 1, 1.5), (0, 2, 0, 0.001), (1, 1, 1, 2.0)]
    assert {tuple(r)[1:] for r in scenes.color_pixels(spark, f"{folder}/color").collect()} == {(u, v, 1.0, round(u / 2 * 255) / 255, float(v)) for u in range(3) for v in range(2)}


def test_instances_and_surfaces_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("s", i, float(i), 0.0, 1.0, [1.0, float(i)], None if i == 3 else i // 2) for i in (3, 1, 0, 2)], "scene string, point_id long, x double, y double, z double, e array<float>, instance long")
    members = spark.createDataFrame([("s", h, p) for h, p in ((7, 1), (7, 0), (9, 1), (9, 2))], "scene string, hyp_id long, point_id long")
    contacts = spark.createDataFrame([("s", 0, 1)], "scene string, a long, b long")
    sinks.write_files(sinks.instance_files(points, members, 2), str(tmp_path))
    memb, found = scenes.instances(spark, str(tmp_path / "s"))
    assert sorted((r["hyp_id"], r["point_id"]) for r in memb.collect()) == [(0, 0), (0, 1), (1, 1), (1, 2)] and found.count() == 4
    with pytest.raises(Exception, match="more than K"):
        sinks.instance_files(points, members, 1).collect()
    sinks.write_files(sinks.ply_files(points, "surface.ply", {"x": "f4", "y": "f4", "z": "f4", "point_id": "i4"}, ["point_id"]).union(sinks.labelled_ply_files(points, contacts, "instances.ply")), str(tmp_path))
    assert formats.read_ply((tmp_path / "s" / "surface.ply").read_bytes())["vertex"]["x"].tolist() == [0, 1, 2, 3]
    vertex = formats.read_ply((tmp_path / "s" / "instances.ply").read_bytes())["vertex"]
    assert vertex["instance"].tolist() == [0, 0, 1, -1] and (vertex["red"][3], vertex["green"][3], vertex["blue"][3]) == sinks.UNCLAIMED
    assert vertex["red"][0] == vertex["red"][1] and [vertex[c][0] for c in ("red", "green", "blue")] != [vertex[c][2] for c in ("red", "green", "blue")]


def test_listed_files_and_failures(spark, tmp_path):
    from terrazzo.operators import selection

    pairs = spark.createDataFrame([("s", 2, 20, -5), ("s", 1, 10, 3)], "scene string, seq int, stamp long, dt long")
    sinks.write_files(sinks.listed_files(pairs, "sync_meta.json", "seq", {"topic": "/color"}), str(tmp_path))
    assert json.loads((tmp_path / "s" / "sync_meta.json").read_text()) == {"topic": "/color", "count": 2, "items": [{"seq": 1, "stamp": 10, "dt": 3}, {"seq": 2, "stamp": 20, "dt": -5}]}

    def halves(rows):
        if rows.dt.min() < 0:
            raise ValueError("negative")
        return rows[["seq"]]

    both = pairs.union(spark.createDataFrame([("t", 4, 1, 1)], pairs.schema))
    done = selection.per_scene(both, halves, "seq int", error="error")
    assert sorted(map(tuple, done.collect()), key=str) == [("s", None, "ValueError: negative"), ("t", 4, None)]
    sinks.write_files(sinks.json_files(selection.failures(done), "failure.json"), str(tmp_path))
    assert json.loads((tmp_path / "s" / "failure.json").read_text()) == {"error": "ValueError: negative"}
    with pytest.raises(Exception, match="scene s: negative"):
        selection.per_scene(both, halves, "seq int").collect()
