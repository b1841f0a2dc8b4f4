"""Near-duplicates and searches of tables in which an id has several rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows_of

from terrazzo.llm import neardup, queries, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(n)]


def test_an_id_has_the_links_of_all_its_texts(spark):
    a, b, c, d = texts(4)
    near = d.rsplit(" ", 1)[0]  # one word less
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (9, c), (11, d), (12, near), (12, c), (None, a), (20, None)]
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).where("n_shingles > 0").collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 9, True), (11, 9, False), (12, 9, False), (None, None, True)}


def test_one_row_of_each_group_stays_also_with_maps(spark):
    a, b = texts(2)
    rows = [(3, a, {"k": 1}), (5, a, {"k": 2}), (5, b, None), (7, b, {"k": 3}), (3, a, {"k": 0})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    kept = neardup.keep_first(docs).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(3, a)]


@pytest.mark.parametrize("shard_rows", [16_384, 40])
def test_every_row_of_an_id_asks_and_is_a_candidate(spark, monkeypatch, shard_rows):
    import duckdb

    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-40, 40, 3) / 8).tolist()) for i in rng.integers(0, 60, 240)]
    rows += [(7, [1.0, 1.0, 1.0])] * 130 + [(20, [2.0, 0.5, 1.0])] * 30 + [(9, (rng.integers(-40, 40, 3) / 8).tolist()) for _ in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    own = duckdb.connect()
    own.register("embeddings", df.toPandas())
    assert rows_of(topk.top_k(df).toPandas()) == rows_of(own.execute(queries.TOP_K_SQL).df())
