"""Scene artefacts as files: rows (name, content) go to files through a data source, and relations
become such rows, a group a file.

A task writes to a folder of its own; only when all tasks are done do the files move to their
places, so a lost executor or a failed job leaves no half of an artefact. The folder may be on any
file system that Arrow opens by its path.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from terrazzo.operators.selection import contact_colors, palette
from terrazzo.sources import formats
from terrazzo.sources.scenes import stem

CONTENT = "name string, content binary"
#: Colour of points without an instance.
UNCLAIMED = (60, 60, 60)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    stage: str
    names: list[str]


class ArtefactWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.stage = path, overwrite, f"_staged_{uuid.uuid4().hex}"

    def write(self, iterator):
        files, root = _opened(self.path)
        stage, names = posixpath.join(root, self.stage, uuid.uuid4().hex), []
        for row in iterator:
            name = posixpath.normpath(row["name"])
            if name.startswith(("/", "..")):
                raise ValueError(f"an artefact outside its folder: {name}")
            target = posixpath.join(stage, name)
            files.create_dir(posixpath.dirname(target), recursive=True)
            with files.open_output_stream(target) as out:
                out.write(bytes(row["content"]))
            names.append(name)
        return Written(stage, names)

    def commit(self, messages):
        files, root = _opened(self.path)
        found = [(m.stage, name) for m in messages if m is not None for name in m.names]
        twice = len(found) - len({name for _, name in found})
        if twice:
            self.abort(messages)
            raise ValueError(f"{twice} artefacts have the name of another")
        if self.overwrite:
            for info in files.get_file_info(_selector(root)):
                if posixpath.basename(info.path) != self.stage:
                    (files.delete_file if info.is_file else files.delete_dir)(info.path)
        for stage, name in found:
            target = posixpath.join(root, name)
            files.create_dir(posixpath.dirname(target), recursive=True)
            files.move(posixpath.join(stage, name), target)
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        files, root = _opened(self.path)
        stage = posixpath.join(root, self.stage)
        if files.get_file_info(stage).type == fs.FileType.Directory:
            files.delete_dir(stage)


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root, allow_not_found=True)


class ArtefactSink(DataSource):
    """df.write.format("artefacts").option("path", folder): rows (name, content) as files."""

    @classmethod
    def name(cls) -> str:
        return "artefacts"

    def schema(self) -> str:
        return CONTENT

    def writer(self, schema, overwrite: bool):
        return ArtefactWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Files of rows(name, content) under a folder; a file of the same name is replaced."""
    rows.sparkSession.dataSource.register(ArtefactSink)
    rows.select("name", "content").write.format("artefacts").mode(mode).option("path", path).save()


def json_files(rows: DataFrame, name: str, scene: str = "scene") -> DataFrame:
    """A JSON object a row, in <scene>/<name>, of all columns but the scene: metadata, intrinsics,
    run summaries, metrics, timings, failures. Nulls are written."""
    fields = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != scene])
    return rows.select(F.concat(F.col(scene).cast("string"), F.lit(f"/{name}")).alias("name"), F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary").alias("content"))


def listed_files(rows: DataFrame, name: str, order: str, about: dict[str, str] | None = None, scene: str = "scene") -> DataFrame:
    """A JSON object a scene, in <scene>/<name>: `about`, the number of its rows and the rows as
    items, in order: frame stamps after synchronisation, poses as they came."""
    fields = [c for c in rows.columns if c != scene]
    item = F.struct(F.col(order).alias("__order"), F.struct(*[F.col(f"`{c}`") for c in fields]).alias("item"))
    grouped = rows.groupBy(scene).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    whole = grouped.select(scene, *[F.lit(v).alias(k) for k, v in (about or {}).items()], F.size("rows").alias("count"), F.transform("rows", lambda x: x["item"]).alias("items"))
    return json_files(whole, name, scene)


def _per_scene(df: DataFrame, scene: str, make) -> DataFrame:
    """make(scene, rows) gives (name, content) of a scene's files."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(make(str(rows[scene].iloc[0]), rows)), columns=["name", "content"])

    return df.groupBy(scene).applyInPandas(run, CONTENT)


def ply_files(points: DataFrame, name: str, columns: dict[str, str], order: list[str], scene: str = "scene") -> DataFrame:
    """A binary PLY a scene, in <scene>/<name>, its vertices in `order`, packed; columns: name -> numpy type."""

    def make(key, rows):
        rows = rows.sort_values(order, kind="stable")
        yield f"{key}/{name}", formats.write_ply({c: rows[c].to_numpy().astype(t) for c, t in columns.items()})

    return _per_scene(points.select(scene, *dict.fromkeys([*columns, *order])), scene, make)


def labelled_ply_files(points: DataFrame, contacts: DataFrame, name: str, scene: str = "scene") -> DataFrame:
    """A PLY a scene with the instance of every point (-1 for none) and colours that tell those apart
    that touch: points(scene, point_id, x, y, z, instance), contacts(scene, a, b)."""

    def run(key: tuple, rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id", kind="stable")
        label = rows.instance.fillna(-1).to_numpy(np.int64)
        shades = palette()
        chosen = contact_colors(np.unique(label[label >= 0]).tolist(), set(zip(pairs.a.tolist(), pairs.b.tolist())))
        colors = np.array([shades[chosen[i]] if i >= 0 else UNCLAIMED for i in label.tolist()], np.uint8).reshape(-1, 3)
        columns = {c: rows[c].to_numpy(np.float32) for c in "xyz"} | dict(zip(("red", "green", "blue"), colors.T)) | {"instance": label.astype(np.int32)}
        return pd.DataFrame([(f"{key[0]}/{name}", formats.write_ply(columns))], columns=["name", "content"])

    rows = points.select(scene, "point_id", *"xyz", "instance").groupBy(scene)
    # a scene without points has no file, whatever touches there
    return rows.cogroup(contacts.select(scene, "a", "b").join(points.select(scene).distinct(), scene, "left_semi").groupBy(scene)).applyInPandas(run, CONTENT)


def pose_files(poses: DataFrame, name: str = "pose.npz", scene: str = "scene") -> DataFrame:
    """A pose archive a scene, (data, inds), of frames 0..n-1: poses(scene, frame, pose of 16 numbers)."""

    def make(key, rows):
        rows = rows.sort_values("frame")
        if rows.frame.tolist() != list(range(len(rows))):
            raise ValueError(f"scene {key}: the frames of a pose file must be 0..n-1")
        out = io.BytesIO()
        np.savez(out, data=np.stack(rows.pose.to_numpy()).astype(float).reshape(-1, 4, 4), inds=np.arange(len(rows), dtype=np.int64))
        yield f"{key}/{name}", out.getvalue()

    return _per_scene(poses.select(scene, "frame", "pose"), scene, make)


def pose_texts(poses: DataFrame, folder: str = "pose", scene: str = "scene") -> DataFrame:
    """A text a frame, <scene>/<folder>/<frame>.txt, of four lines of four numbers; a null pose gives
    no numbers but nan."""
    value = F.coalesce("pose", F.array_repeat(F.lit(float("nan")), 16))
    lines = F.array(*[F.array_join(F.transform(F.slice(value, 4 * k + 1, 4), lambda x: x.cast("string")), " ") for k in range(4)])
    return poses.select(F.concat(F.col(scene).cast("string"), F.lit(f"/{folder}/"), stem("frame"), F.lit(".txt")).alias("name"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).cast("binary").alias("content"))


def image_files(pixels: DataFrame, sizes: DataFrame, folder: str, scene: str = "scene") -> DataFrame:
    """A PNG a frame, <scene>/<folder>/<frame>.png. pixels(scene, frame, u, v, depth in metres) make
    16-bit images of millimetres (0 where no pixel is), pixels(scene, frame, u, v, r, g, b in 0..1)
    colour ones; sizes(scene, width, height)."""
    values = ["depth"] if "depth" in pixels.columns else ["r", "g", "b"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        scale, kind = (1000, np.uint16) if values == ["depth"] else (255, np.uint8)
        image = np.zeros((int(first.height), int(first.width), len(values)), kind)
        image[rows.v, rows.u] = np.clip(np.rint(rows[values].to_numpy(float) * scale), 0, np.iinfo(kind).max)
        return pd.DataFrame([(f"{first[scene]}/{folder}/{int(first.frame):06d}.png", formats.write_png(image[:, :, 0] if len(values) == 1 else image))], columns=["name", "content"])

    placed = pixels.select(scene, "frame", "u", "v", *values).join(sizes.select(scene, "width", "height"), scene)
    return placed.groupBy(scene, "frame").applyInPandas(run, CONTENT)


def instance_files(points: DataFrame, membership: DataFrame, budget: int, name: str = "instances.npz", scene: str = "scene") -> DataFrame:
    """An archive a scene of points(scene, point_id, x, y, z, e) and the hypotheses of
    membership(scene, hyp_id, point_id), packed: what instances() reads. It is held against the
    same contract before it is written; a hypothesis number may be any, its place is by order."""

    def run(key: tuple, rows: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        at = {p: i for i, p in enumerate(rows.point_id.tolist())}
        groups = [sorted(at[p] for p in part.point_id.tolist()) for _, part in members.groupby("hyp_id", sort=True)]
        out = io.BytesIO()
        np.savez(
            out,
            points=rows[["x", "y", "z"]].to_numpy(np.float32),
            hypothesis_indices=np.array([p for g in groups for p in g], np.int32),
            hypothesis_offsets=np.cumsum([0, *map(len, groups)]).astype(np.int64),
            K=np.int32(budget),
            domain=np.array("tsdf_surface"),
            point_features=np.stack(rows.e.to_numpy()).astype(np.float32),
        )
        formats.instance_arrays(out.getvalue())
        return pd.DataFrame([(f"{key[0]}/{name}", out.getvalue())], columns=["name", "content"])

    held = membership.select(scene, "hyp_id", "point_id").join(points.select(scene).distinct(), scene, "left_semi")
    return points.select(scene, "point_id", *"xyz", "e").groupBy(scene).cogroup(held.groupBy(scene)).applyInPandas(run, CONTENT)
