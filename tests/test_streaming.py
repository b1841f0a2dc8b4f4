"""Streams give what the batch operators give."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import lie
from terrazzo.operators import motion, temporal
from terrazzo.streaming import stateful


def play(spark, tmp_path, batches, schema, operator, mode="append"):
    """Feed the batches as files, one a trigger, and return what comes out."""
    folder, name = tmp_path / "in", f"t{uuid.uuid4().hex}"
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = operator(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_moved_frames_equal_the_batch_scan(spark, tmp_path):
    values = [0, 3, 7, 8, 20, 22, 31, 30, 5]
    rows = [(s, i, float(v + s)) for s in (0, 1) for i, v in enumerate(values)]
    got = play(spark, tmp_path, [[r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4]], "scene long, frame long, v double", lambda df: stateful.moved_frames(df, 6.0))
    batch = temporal.scan_groups(spark.createDataFrame(rows, "scene long, frame long, v double"), "scene", ["frame"], temporal.keep_moved("v", 6.0))
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))


def test_chunks_flush_at_the_end(spark, tmp_path):
    rows = [(0, i, i == 10) for i in range(11)]
    got = play(spark, tmp_path, [rows[:5], rows[5:9], rows[9:]], "scene long, frame long, last boolean", lambda df: stateful.frame_chunks(df, 4))
    assert [(r["chunk"], r["frames"], r["first_id"]) for r in sorted(got, key=lambda r: r["chunk"])] == [(0, [0, 1, 2, 3], 0), (1, [4, 5, 6, 7], 4), (2, [8, 9, 10], 8)]


def test_state_of_an_ended_scene_is_removed(spark, tmp_path):
    """After its last row a scene's number may come again, as a scene of its own."""
    batches = [[(0, 0, False), (0, 1, True), (1, 0, False)], [(0, 2, False), (0, 3, True)], [(1, 1, True)]]
    got = play(spark, tmp_path, batches, "scene long, frame long, last boolean", lambda df: stateful.frame_chunks(df, 4))
    assert sorted((r["scene"], r["chunk"], r["frames"], r["first_id"]) for r in got) == [(0, 0, [0, 1], 0), (0, 0, [2, 3], 0), (1, 0, [0, 1], 0)]


def test_idle_scenes_are_forgotten(spark, tmp_path):
    """An idle scene flushes what it holds, and starts anew when it comes back."""
    import time

    folder, schema, name = tmp_path / "in", "scene long, frame long, last boolean", f"t{uuid.uuid4().hex}"
    folder.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(folder))
    query = stateful.frame_chunks(stream, 4, 1.0).writeStream.format("memory").queryName(name).trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()

    def wait(count):
        until = time.time() + 60
        while time.time() < until and spark.table(name).count() < count:
            time.sleep(0.3)

    try:
        spark.createDataFrame([(0, 0, False), (0, 1, False)], schema).coalesce(1).write.mode("append").parquet(str(folder))
        wait(1)
        spark.createDataFrame([(0, 2, True)], schema).coalesce(1).write.mode("append").parquet(str(folder))
        wait(2)
        got = spark.table(name).collect()
    finally:
        query.stop()
    assert [(r["chunk"], r["frames"]) for r in sorted(got, key=lambda r: r["frames"])] == [(0, [0, 1]), (0, [2])]


def test_edges_age_and_go(spark, tmp_path):
    got = play(spark, tmp_path, [[(0, 1), (0, 2)], [(0, 2)], [(0, 3)]], "scene long, edge long", lambda df: stateful.aged_edges(df, 1), "update")
    assert [sorted(r["edges"]) for r in got] == [[1, 2], [1, 2], [2, 3]]


def test_running_means(spark, tmp_path):
    got = play(spark, tmp_path, [[(1, 2.0), (2, 4.0)], [(1, 4.0)]], "g long, v double", lambda df: stateful.running_means(df, "g"), "complete")
    assert {(r["g"], r["mean"], r["weight"]) for r in got} >= {(1, 3.0, 2), (2, 4.0, 1)}


def test_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{m:02d}:00") for i, m in enumerate((0, 1, 6, 30))]
    schema = "event_id long, ts string"
    events = lambda df: df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit(1).alias("user_id"))
    got = play(spark, tmp_path, [rows, [(9, "2024-01-01 02:00:00")]], schema, lambda df: stateful.windowed(events(df), "5 minutes"))
    assert sorted(r["n"] for r in got) == [1, 1, 2]


def splits(rows, seed):
    """The rows of each scene in order, cut into batches at random."""
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


@pytest.mark.parametrize("seed", [1, 2])
def test_filled_poses_equal_the_batch_infill(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    poses = lie.exp(rng.normal(size=(30, 6)))
    rows = [(i % 2, i // 2, poses[i].tolist(), i // 2 in (2, 3, 9), i >= 28) for i in range(30)]
    got = play(spark, tmp_path, splits(rows, seed), "scene long, frame long, pose array<double>, key boolean, last boolean", stateful.filled_poses)
    whole = spark.createDataFrame([(s, f, f, p, k) for s, f, p, k, _ in rows], "scene long, id long, t long, v array<double>, key boolean")
    want = {(r.scene, r.id): r.pose for r in motion.infilled(whole, "scene", F.col("key")).collect()}
    assert len(got) == len(want) == 30
    assert all(np.abs(np.array(r["pose"]) - want[r["scene"], r["frame"]]).max() < 1e-9 for r in got)


def test_edge_changes_add_up_to_the_edges(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(s, rng.randrange(12)) for s in (0, 1) for _ in range(3)] for _ in range(7)]
    got = play(spark, tmp_path, batches, "scene long, edge long", lambda df: stateful.edge_changes(df, 1), "update")
    for scene in (0, 1):
        ages, held = {}, set()
        for turn, batch in enumerate(batches):
            named = {e for s, e in batch if s == scene}
            ages = {e: 0 if e in named else a + 1 for e, a in ages.items()} | {e: 0 for e in named}
            ages = {e: a for e, a in ages.items() if a <= 1}
            (row,) = [r for r in got if r["scene"] == scene and r["turn"] == turn]
            assert not held & set(row["added"]) and set(row["dropped"]) <= held
            held = (held | set(row["added"])) - set(row["dropped"])
            assert held == set(ages)


def test_chunks_go_on_after_a_restart(spark, tmp_path):
    """A query that starts again from its checkpoint finds the state of the scenes."""
    schema = "scene long, frame long, last boolean"
    (tmp_path / "in").mkdir()
    rows = [(0, i, i == 10) for i in range(11)]
    for k, part in enumerate((rows[:6], rows[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = stateful.frame_chunks(stream, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = sorted((r["chunk"], r["frames"], r["first_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [(0, [0, 1, 2, 3], 0), (1, [4, 5, 6, 7], 4), (2, [8, 9, 10], 8)][: 1 + 2 * k]


def test_state_stays_as_large_as_what_it_holds(spark, tmp_path):
    """Entries of edges that have gone are gone from the store too."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("scene long, edge long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = stateful.edge_changes(stream, 1).writeStream.outputMode("update").format("memory").queryName(f"t{uuid.uuid4().hex}").option("checkpointLocation", str(tmp_path / "cp")).start()
    sizes = []
    try:
        for k in range(7):
            spark.createDataFrame([(0, 10 * k + i) for i in range(10)], "scene long, edge long").coalesce(1).write.mode("append").parquet(str(folder))
            query.processAllAvailable()
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        query.stop()
    assert sizes[-1] == sizes[-2] == sizes[-3] < 40
