"""Frame-at-a-time decisions with state per scene, and time windows over streams.

The stateful operators take micro-batches in any size and give what the batch operators give on the
whole. Their state lies in entries of its own (values, lists, maps), so a batch reads and writes only
the entries that it changes. State doesn't outlive its scene: a row with `last` set ends a scene, flushes
its state and removes it; where no row says so, a scene that is idle for `idle` seconds is forgotten
(never, if none are given), by a timer where it holds something to flush and else by the state's
time to live. Entries need the RocksDB state store; the operators set it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terrazzo.functions import lie

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PerScene(StatefulProcessor):
    """What the operators share: the handle, and a timer that each batch of a scene sets anew."""

    def __init__(self, idle: float | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def lives(self) -> int | None:
        """Milliseconds that an entry lives after it was written."""
        return None if self.idle is None else int(self.idle * 1000)

    def awaited(self, now, ended: bool) -> None:
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(now.getCurrentProcessingTimeInMs() + int(self.idle * 1000))

    def close(self) -> None:
        pass


def _run(rows: DataFrame, processor: PerScene, schema: str, mode: str = "append") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy("scene").transformWithStateInPandas(processor, schema, mode, "none" if processor.idle is None else "processingTime")


def _rows(batches: Iterator[pd.DataFrame], by: str = "frame") -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, kind="stable")


class _Moved(PerScene):
    def __init__(self, threshold: float, idle: float | None):
        super().__init__(idle)
        self.threshold = threshold

    def open(self) -> None:
        self.kept = self.handle.getValueState("kept", "v double", self.lives())

    def handleInputRows(self, key, rows, timerValues):
        last = self.kept.get()[0] if self.kept.exists() else None
        found, rows = [], _rows(rows)
        for frame, v in zip(rows.frame, rows.v):
            if last is None or abs(v - last) > self.threshold:
                found.append((key[0], frame, v))
                last = float(v)
        if last is not None and (found or self.idle is not None):
            self.kept.update((last,))
        yield pd.DataFrame(found, columns=["scene", "frame", "v"])


def moved_frames(frames: DataFrame, threshold: float, idle: float | None = None) -> DataFrame:
    """scene, frame, v of the frames that lie more than `threshold` from the last one kept."""
    return _run(frames.select("scene", "frame", "v"), _Moved(threshold, idle), "scene long, frame long, v double")


class _Chunks(PerScene):
    def __init__(self, size: int, idle: float | None):
        super().__init__(idle)
        self.size = size

    def open(self) -> None:
        self.held = self.handle.getListState("held", "frame long")
        self.told = self.handle.getValueState("told", "chunk long, given long, held long")

    def handleInputRows(self, key, rows, timerValues):
        chunk, given, n = self.told.get() if self.told.exists() else (0, 0, 0)
        out, new, ended, rows = [], [], False, _rows(rows)
        for frame, last in zip(rows.frame, rows["last"]):
            new.append((int(frame),))
            n += 1
            if n == self.size or last:
                whole = [f for (f,) in self.held.get()] if n > len(new) else []
                out.append((key[0], chunk, whole + [f for (f,) in new], given))
                if whole:
                    self.held.clear()
                chunk, given, n, new = chunk + 1, given + n, 0, []
            ended = bool(last)
        if ended:
            self.told.clear()
        else:
            if new:
                self.held.appendList(new)
            self.told.update((chunk, given, n))
        self.awaited(timerValues, ended)
        yield pd.DataFrame(out, columns=["scene", "chunk", "frames", "first_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        chunk, given, n = self.told.get() if self.told.exists() else (0, 0, 0)
        out = [(key[0], chunk, [f for (f,) in self.held.get()], given)] if n else []
        self.held.clear()
        self.told.clear()
        yield pd.DataFrame(out, columns=["scene", "chunk", "frames", "first_id"])


def frame_chunks(frames: DataFrame, size: int = 8, idle: float | None = None) -> DataFrame:
    """scene, chunk, frames, first_id: full chunks of retained frames, the rest when a scene ends.

    first_id counts the frames of earlier chunks, so identities are never given out twice. What an
    idle scene still holds is flushed when it is forgotten.
    """
    return _run(frames.select("scene", "frame", "last"), _Chunks(size, idle), "scene long, chunk long, frames array<long>, first_id long")


class _Infill(PerScene):
    """State: the last keyframe, and the frames since."""

    def open(self) -> None:
        self.key = self.handle.getValueState("key", "frame long, pose array<double>")
        self.since = self.handle.getListState("since", "frame long")

    def _between(self, scene, left, right, frames: list[int], eps: float = 1e-3) -> list[tuple]:
        if not frames:
            return []
        if left is None or right is None:  # before the first keyframe, or after the last
            pose = (left or right)[1]
            return [(scene, f, list(pose)) for f in frames]
        share = (np.array(frames, float) - left[0]) / (right[0] - left[0] + eps)
        many = lambda pose: np.tile(np.array(pose, float), (len(frames), 1))
        return [(scene, f, p.tolist()) for f, p in zip(frames, lie.interpolate(many(left[1]), many(right[1]), share))]

    def handleInputRows(self, key, rows, timerValues):
        left = tuple(self.key.get()) if self.key.exists() else None
        out, new, read, ended, rows = [], [], False, False, _rows(rows)
        for frame, pose, mark, last in zip(rows.frame, rows.pose, rows.key, rows["last"]):
            if mark or last:
                pending = ([f for (f,) in self.since.get()] if not read else []) + new
                read, new = True, []
                here = (int(frame), [float(x) for x in pose]) if mark else None
                if not mark:
                    pending.append(int(frame))
                if here or left:
                    out += self._between(key[0], left, here, pending)
                if here:
                    out.append((key[0], *here))
                    left = here
            else:
                new.append(int(frame))
            ended = bool(last)
        if read:
            self.since.clear()
        if ended:
            self.key.clear()
        else:
            if new:
                self.since.appendList([(f,) for f in new])
            if read and left:
                self.key.update(left)
        self.awaited(timerValues, ended)
        yield pd.DataFrame(out, columns=["scene", "frame", "pose"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        left = tuple(self.key.get()) if self.key.exists() else None
        out = self._between(key[0], left, None, [f for (f,) in self.since.get()]) if left else []
        self.key.clear()
        self.since.clear()
        yield pd.DataFrame(out, columns=["scene", "frame", "pose"])


def filled_poses(frames: DataFrame, idle: float | None = None) -> DataFrame:
    """scene, frame, pose of every frame(scene, frame, pose, key, last): keyframes at once, the others
    when the next keyframe or the end of their scene comes, as `motion.infilled` places them.

    Frames come in order. Those of a scene that ends without a keyframe have no pose and no row.
    """
    return _run(frames.select("scene", "frame", "pose", "key", "last"), _Infill(idle), "scene long, frame long, pose array<double>")


class _Ages(PerScene):
    """State: each edge's last turn, and for each turn the edges that it named; so a batch reads the
    edges that it names and those of the one turn that grows too old."""

    def __init__(self, most: int, whole: bool, idle: float | None):
        super().__init__(idle)
        self.most, self.whole = most, whole

    def open(self) -> None:
        self.turn = self.handle.getValueState("turn", "n long", self.lives())
        self.named = self.handle.getMapState("named", "edge long", "turn long", self.lives())
        self.at = self.handle.getMapState("at", "turn long", "edges array<long>", self.lives())

    def handleInputRows(self, key, rows, timerValues):
        turn = self.turn.get()[0] + 1 if self.turn.exists() else 0
        edges = sorted({int(e) for part in rows for e in part.edge})
        new = [e for e in edges if not self.named.containsKey((e,))]
        for e in edges:
            self.named.updateValue((e,), (turn,))
        self.at.updateValue((turn,), (edges,))
        self.turn.update((turn,))
        old, gone = (turn - self.most - 1,), []
        if self.at.containsKey(old):
            for e in self.at.getValue(old)[0]:
                if self.named.containsKey((e,)) and self.named.getValue((e,))[0] == old[0]:
                    self.named.removeKey((e,))
                    gone.append(e)
            self.at.removeKey(old)
        if self.whole:
            yield pd.DataFrame({"scene": [key[0]], "edges": [sorted(e for (e,) in self.named.keys())]})
        else:
            yield pd.DataFrame({"scene": [key[0]], "turn": [turn], "added": [new], "dropped": [gone]})


def aged_edges(updates: DataFrame, most: int = 25, idle: float | None = None) -> DataFrame:
    """scene, edges after each batch of updates(scene, edge): an edge's age grows by one with every
    batch of its scene that doesn't name it, and edges older than `most` go."""
    return _run(updates.select("scene", "edge"), _Ages(most, True, idle), "scene long, edges array<long>", "update")


def edge_changes(updates: DataFrame, most: int = 25, idle: float | None = None) -> DataFrame:
    """scene, turn, added, dropped: what each batch changes in the edges of aged_edges."""
    return _run(updates.select("scene", "edge"), _Ages(most, False, idle), "scene long, turn long, added array<long>, dropped array<long>", "update")


def running_means(samples: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Sum, weight and mean of each key so far (for update or complete mode)."""
    return samples.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("weight"), F.avg(value).alias("mean"))


# Event-time windows: additions to the inventory, in their plain Spark form.


def windowed(events: DataFrame, every: str, slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts and sums of tumbling (or sliding) windows; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every, slide or every), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
