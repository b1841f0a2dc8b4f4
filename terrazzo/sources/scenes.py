"""Scene files as relations, and relations as scene files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrazzo import schemas
from terrazzo.sources import formats, jpeg, ply
from terrazzo.sources import mcap as indexed


def stem(index: str | Column = "frame") -> Column:
    """Six-digit name of a frame."""
    return F.lpad(F.col(index).cast("string") if isinstance(index, str) else index.cast("string"), 6, "0")


def frame_of(path: str | Column) -> Column:
    """Trailing number of a file's stem; null without one."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"(\d+)\.[^./]*$", 1).try_cast("long")


def checked(df: DataFrame, **rules: Column) -> DataFrame:
    """`df`, failing when it is read where a rule doesn't hold; the rule's name is the message."""
    for name, rule in rules.items():
        df = df.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(name.replace("_", " "))).cast("boolean")))
    return df


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a scene: its metadata and number of frames."""
    rows = spark.read.schema(schemas.SCENE_JSON).option("multiLine", "true").json(path)
    rows = checked(rows, unknown_scene_format=F.col("format").rlike(schemas.SCENE_FORMAT), fps_must_be_positive=F.col("fps") > 0, a_scene_needs_frames=F.size("frames") > 0)
    return rows.withColumn("n_frames", F.size("frames"))


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.INTRINSICS_JSON).option("multiLine", "true").json(path)
    return checked(rows, unknown_intrinsics_format=F.col("format").rlike(schemas.INTRINSICS_FORMAT), unknown_camera_model=F.col("camera_model") == "pinhole")


def frames(meta: DataFrame) -> DataFrame:
    """scene, frame, color_path, depth_path of every frame of every scene."""
    rows = meta.select(F.col("name").alias("scene"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)).alias("frame"))
    name = stem()
    return rows.withColumns({"color_path": F.concat(F.lit("color/"), name, F.lit(".png")), "depth_path": F.concat(F.lit("depth/"), name, F.lit(".png"))})


def frame_at(rows: DataFrame, index: int) -> DataFrame:
    """The frame of each scene at an index; negative ones count from the end, others are an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy("scene"))
    rows = rows.withColumn("n", n)
    rows = checked(rows, frame_index_out_of_range=F.lit(index).between(-F.col("n"), F.col("n") - 1))
    return rows.where(F.col("frame") == F.pmod(F.lit(index), F.col("n"))).drop("n")


def depth_pixels(spark: SparkSession, path: str) -> DataFrame:
    """frame, u, v, depth of all valid depth pixels, in metres."""

    def decode(batches):
        for batch in batches:
            for frame, content in zip(batch.frame, batch.content):
                p = formats.depth_pixels(formats.read_png(content))
                yield pd.DataFrame({"frame": np.full(len(p), frame), "u": p[:, 0].astype("int32"), "v": p[:, 1].astype("int32"), "depth": p[:, 2]})

    return files(spark, path, "*.png").select(frame_of("path").alias("frame"), "content").mapInPandas(decode, "frame long, u int, v int, depth double")


def read_image(content: bytes) -> np.ndarray:
    """Pixels of a PNG or JPEG, by its first bytes."""
    return formats.read_png(content) if content.startswith(formats.PNG_MAGIC) else jpeg.read_jpeg(content)


def color_pixels(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray] = read_image, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """frame, u, v, r, g, b in 0..1 of PNG and sequential JPEG files, grey ones in equal parts;
    another codec comes as `decode`."""

    def run(batches):
        for batch in batches:
            for frame, content in zip(batch.frame, batch.content):
                image = decode(bytes(content))
                image = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
                v, u = np.indices(image.shape[:2])
                c = image.reshape(-1, 3) / 255.0
                yield pd.DataFrame({"frame": np.full(len(c), frame), "u": u.ravel().astype("int32"), "v": v.ravel().astype("int32"), "r": c[:, 0], "g": c[:, 1], "b": c[:, 2]})

    return files(spark, path, pattern).select(frame_of("path").alias("frame"), "content").mapInPandas(run, "frame long, u int, v int, r double, g double, b double")


def poses(spark: SparkSession, path: str) -> DataFrame:
    """frame, pose (row-major 16) of text files; a pose with a number that isn't finite is null."""
    rows = spark.read.text(path, wholetext=True).select(frame_of(F.input_file_name()).alias("frame"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("w"))
    rows = checked(rows, a_pose_has_16_numbers=F.size("w") == 16).select("frame", F.transform("w", lambda x: x.cast("double")).alias("pose"))
    bad = F.exists("pose", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select("frame", F.when(~bad, F.col("pose")).alias("pose"))


def pose_lines(spark: SparkSession, path: str) -> DataFrame:
    """frame, pose of a file with one pose of 16 numbers a line, numbered from 0."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("frame", "line"))
    rows = text.select(F.col("frame").cast("long").alias("frame"), F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("pose"))
    return checked(rows, a_pose_has_16_numbers=F.size("pose") == 16)


def same_frames(*sides: DataFrame) -> DataFrame:
    """Frames that some side lacks; empty if all hold the same."""
    rows = None
    for i, side in enumerate(sides):
        one = side.select("frame").distinct().withColumn("side", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < len(sides)).select("frame")


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    """path, point_id and the vertex columns x, y, z, nx, ny, nz (null where the file has none)."""
    return ply.points(spark, path)


def ply_triangles(spark: SparkSession, path: str) -> DataFrame:
    """path, face, object_id, a, b, c: polygons as fans."""
    return ply.triangles(spark, path)


def semantic_samples(points: DataFrame, faces: DataFrame) -> DataFrame:
    """path, object, x, y, z: the middle of each triangle; object 0 is background and becomes -1."""
    corners = faces.select("path", F.monotonically_increasing_id().alias("t"), "object_id", F.explode(F.array("a", "b", "c")).alias("point_id"))
    joined = corners.join(points.select("path", "point_id", "x", "y", "z"), ["path", "point_id"])
    return joined.groupBy("path", "t").agg(F.first("object_id").alias("object_id"), *[F.avg(c).alias(c) for c in ("x", "y", "z")]).select("path", F.when(F.col("object_id") == 0, -1).otherwise(F.col("object_id")).alias("object"), "x", "y", "z")


def annotation(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """point_id, object, label of annotated vertices; -1 and null where no group holds the segment."""
    points = segments.select(F.posexplode("segIndices").alias("point_id", "segment"))
    owners = groups.select(F.explode("segGroups").alias("g")).select(F.col("g.objectId").alias("object"), F.col("g.label").alias("label"), F.explode("g.segments").alias("segment"))
    return points.join(owners, "segment", "left").select(F.col("point_id").cast("long").alias("point_id"), F.coalesce("object", F.lit(-1).cast("long")).alias("object"), "label")


def normalized(name: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def class_names(objects: DataFrame) -> DataFrame:
    """class_id, name with one spelling; two names under one class fail when it is read."""
    rows = objects.groupBy("class_id").agg(F.collect_set(normalized("name")).alias("names"))
    return checked(rows, a_class_has_one_name=F.size("names") == 1).select("class_id", F.col("names")[0].alias("name"))


def instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hyp_id, point_id) and (point_id, x, y, z, e) of prediction files, each with its path."""
    rows = files(spark, path, "*.npz").select("path", "content")

    def membership(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                a = formats.instance_arrays(content)
                sizes = np.diff(a["hypothesis_offsets"])
                yield pd.DataFrame({"path": name, "hyp_id": np.repeat(np.arange(len(sizes)), sizes), "point_id": a["hypothesis_indices"].astype("int64")})

    def points(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                a = formats.instance_arrays(content)
                p = a["points"].astype(float)
                yield pd.DataFrame({"path": name, "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "e": list(a["point_features"].astype("float32"))})

    return rows.mapInPandas(membership, "path string, hyp_id long, point_id long"), rows.mapInPandas(points, "path string, point_id long, x double, y double, z double, e array<float>")


def pose_file(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                p = formats.pose_arrays(content).reshape(-1, 16).astype(float)
                yield pd.DataFrame({"path": name, "frame": np.arange(len(p)), "pose": list(p)})

    return files(spark, path, "*.npz").select("path", "content").mapInPandas(run, "path string, frame long, pose array<double>")


def mcap(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """path, topic, stamp (header's, else the bag's), payload; by the files' index, see sources.mcap."""
    return indexed.messages(spark, path, topics).drop("logged")


def zipped(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, frame, content of zipped scenes."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                yield pd.DataFrame([(name, *f) for f in formats.zip_frames(content)], columns=["path", "kind", "frame", "content"])

    return files(spark, path, "*.zip").select("path", "content").mapInPandas(run, "path string, kind string, frame long, content binary")


class SensReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p.strip()) for p in self.path.split(",")]

    def read(self, partition):
        with indexed.opened(partition.value) as stream:
            head, rows = formats.read_sens(stream)
            for i, pose, color_stamp, depth_stamp, color, depth in rows:
                ok = all(np.isfinite(pose))
                yield head["name"], i, [float(x) for x in pose] if ok else None, color_stamp, depth_stamp, head["color"], color, head["depth"], head["depth_width"], head["depth_height"], float(head["depth_shift"]), depth


class SensSource(DataSource):
    """Sensor streams of version 4, a partition a file: spark.read.format("sens").load("a.sens,b.sens").

    Streams are too long for one row, so they are read as files that every executor can open.
    """

    @classmethod
    def name(cls) -> str:
        return "sens"

    def schema(self) -> str:
        return "sensor string, frame long, pose array<double>, color_stamp long, depth_stamp long, color_codec string, color binary, depth_codec string, width int, height int, depth_shift double, depth binary"

    def reader(self, schema):
        return SensReader(self.options["path"])


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """scene, name, value of metric files {scene: {name: number}}; the key mean is no scene, and a
    file that can't be read gives its text in `corrupt`."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"), "value")
    rows = raw.select(F.when(F.col("m").isNull(), F.col("value")).alias("corrupt"), F.explode_outer("m").alias("scene", "metrics"))
    return rows.select("corrupt", "scene", F.explode_outer("metrics").alias("name", "value")).where("scene is null or scene <> 'mean'")


def pack(membership: DataFrame, scene: str | None = None) -> DataFrame:
    """hyp_id, indices (sorted), offset_end: the ragged form of hypotheses; `scene` names a column of
    scenes that are packed apart, without it all rows are one scene's (one task runs over its sizes)."""
    keys = [scene] if scene else []
    rows = membership.groupBy(*keys, "hyp_id").agg(F.sort_array(F.collect_set("point_id")).alias("indices"))
    return rows.withColumn("offset_end", F.sum(F.size("indices")).over(Window.partitionBy(*keys).orderBy("hyp_id").rowsBetween(Window.unboundedPreceding, 0)))


def manifest(artefacts: DataFrame) -> DataFrame:
    """scene, fingerprint of artefact rows (scene, name, size, modified)."""
    line = F.concat_ws("|", "name", F.col("size").cast("string"), F.col("modified").cast("string"))
    return artefacts.groupBy("scene").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("fingerprint"))


def complete(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Scenes whose recorded fingerprint is the present one."""
    return wanted.join(done.select("scene", "fingerprint"), ["scene", "fingerprint"], "left_semi").select("scene")
