"""The board that follows metric files."""

from __future__ import annotations

import json

import pytest

from terrazzo.operators import metrics
from terrazzo.streaming import board


def put(folder, side, name, content):
    (folder / side).mkdir(parents=True, exist_ok=True)
    (folder / side / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture()
def run(spark, tmp_path):
    def go(files_per_trigger=None):
        query = board.follow(board.metric_updates(spark, str(tmp_path / "in"), files_per_trigger=files_per_trigger), str(tmp_path / "store"), str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(map(tuple, board.board(spark, str(tmp_path / "store"), "auc").collect()), key=str)

    return go


def plain(spark, before, after):
    side = lambda d: spark.createDataFrame(sorted(d.items()), "scene string, value double")
    return sorted(map(tuple, metrics.dashboard(side(before), side(after), "scene").collect()), key=str)


def test_board_follows_its_files(spark, tmp_path, run):
    put(tmp_path / "in", "before", "one", {"a": {"auc": 0.5, "ate": 1.0}, "b": {"auc": 0.25}, "mean": {"auc": 0.4}})
    put(tmp_path / "in", "after", "one", {"a": {"auc": 0.75}, "c": {"auc": 0.1}})
    assert run() == plain(spark, {"a": 0.5, "b": 0.25}, {"a": 0.75, "c": 0.1})
    put(tmp_path / "in", "after", "two", {"a": {"auc": 0.25}, "b": {"ate": 3.0}})
    put(tmp_path / "in", "after", "bad", '{"a": {"auc": ')
    assert run(1) == plain(spark, {"a": 0.5, "b": 0.25}, {"a": 0.25, "c": 0.1})
    (bad,) = board.failures(spark, str(tmp_path / "store")).collect()
    assert bad.file.endswith("bad.json") and bad.corrupt == '{"a": {"auc": '
    assert run() == plain(spark, {"a": 0.5, "b": 0.25}, {"a": 0.25, "c": 0.1})  # nothing new


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("before", "f", None, None, "a", "auc", 0.5), ("after", "g", None, None, "a", "auc", 0.75)], board.ROWS)
    store = str(tmp_path / "store")
    seen = lambda: sorted(map(tuple, board.board(spark, store, "auc").collect()))
    board.keep(store)(rows, 3)
    first = seen()
    board.keep(store)(rows, 3)
    assert seen() == first == [("a", 0.5, 0.75, 0.25, "up")]
    board.keep(store)(spark.createDataFrame([("after", "h", None, None, "a", "auc", 0.5)], board.ROWS), 4)
    board.keep(store)(rows, 3)  # an older batch doesn't come back over a later one
    assert seen() == [("a", 0.5, 0.5, 0.0, "same")]
