"""Steps that outgrew a task, a worker or the driver on larger tables."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest

from terrazzo.operators import evidence as ev
from terrazzo.operators import contraction, selection, semantic, slam
from terrazzo.plans import catalogue
from terrazzo.plans import evidence as evidence_plans


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_factor_edges_of_many_scenes_share_a_batch(spark, data):
    """No pairs in a join and no table a scene; the edges are those of the one-scene function."""
    text = plan(catalogue.QUERIES["factor_edges"](spark, data))
    assert "FlatMapGroupsInPandas" not in text and "Join" not in text
    rng = np.random.default_rng(0)
    scenes = [(s, [None if x > 95 else float(x) for x in rng.uniform(0, 100, n)]) for s, n in enumerate((1, 2, 9, 32, 32))]
    got = slam.sequence_edges(spark.createDataFrame(scenes, "scene long, values array<double>"), 1, 20.0, 2, 200).collect()
    want = []
    for s, values in scenes:
        v = np.array(values, float)
        i, j = np.nonzero(~np.eye(len(v), dtype=bool))
        edges = slam.proximity_edges(pd.DataFrame({"i": i, "j": j, "dist": np.abs(v[i] - v[j])}), len(v), 1, 20.0, 2, 200)
        want += [(s, *e) for e in edges.itertuples(index=False)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["coverage_rows", "phi_scores", "node_mean_iou", "node_evidence_best_mask", "lazy_greedy_cover", "ancestor_exchange", "chain_collapse", "co_mask_pairs"])
def test_the_tree_is_not_broadcast(name, spark, data):
    """Atoms meet their nodes by a shuffle, and lie by their coarsest node before they are laid out."""
    text = plan(catalogue.QUERIES[name](spark, data))
    assert "BroadcastHashJoin [atom" not in text and "REBALANCE_PARTITIONS_BY_COL" in text


def test_votes_and_chances_meet_by_shuffles(spark, data):
    """No side of a join goes through the driver, however small, and the costs don't run the votes again."""
    pairs = evidence_plans._kn(spark, data)
    assert pairs.collect()
    text = plan(pairs)
    assert "isFinalPlan=true" in text and "Broadcast" not in text
    assert "Join" not in plan(catalogue.QUERIES["join_llr_em"](spark, data))


def test_sums_of_a_ragged_tree(spark):
    """Repeated members count twice, and atoms of one node may end under different tops."""
    members = spark.createDataFrame([(2, 0, 1), (2, 0, 2), (3, 5, 1), (3, 5, 1), (4, 9, 3)], "lvl int, node long, atom long")
    leaf = spark.createDataFrame([(1, 7, 10), (2, 7, 100), (3, 8, 1), (4, 8, 5)], "atom long, f int, n long")
    got = ev.sums_up(members, leaf, "f", value="n")
    assert got.columns == ["lvl", "node", "f", "n"]
    assert sorted(map(tuple, got.collect())) == [(2, 0, 7, 110), (3, 5, 7, 20), (4, 9, 8, 1)]


def test_overlap_takes_a_mean_for_each_set(spark, data):
    """No aggregate of every point's elements; a hypothesis that is named twice counts twice."""
    assert not re.search(r"keys=\[id#\d+L?, dim#", plan(catalogue.QUERIES["overlap_field"](spark, data)))
    pooled = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 4.0)], "hyp long, dim int, value double")
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 1), (12, 1), (12, 1), (12, 2), (13, 3)], "id long, hyp long")
    got = sorted(map(tuple, semantic.overlap(pooled, members).collect()))
    assert got == [(10, 0, 2.5), (10, 1, 2.0), (11, 0, 2.5), (11, 1, 2.0), (12, 0, 2.0), (12, 1, 2.0)]


@pytest.mark.parametrize("seed", range(3))
def test_contraction_in_blocks_is_that_of_one_pass(spark, seed):
    """Two scenes of tied whole costs, in blocks far smaller than a scene: the same contractions in the same order."""
    rng = np.random.default_rng(seed)
    rows = []
    for scene in (1, 2):
        lo = np.sort(rng.integers(0, 2000, 400))
        hi = lo + rng.integers(0, 12, 400)
        for i, j in {(i, i + int(k)) for i in range(400) for k in rng.integers(1, 9, 5) if i + k < 400}:
            cost = float(rng.integers(-4, 9))
            rows.append((scene, 1000 * scene + i, 1000 * scene + j, cost, int(lo[i]), int(hi[i]), int(lo[j]), int(hi[j])))
    edges = spark.createDataFrame(rows, "scene long, id long, id2 long, cost double, lo long, hi long, lo2 long, hi2 long")
    got = contraction.contracted(edges, 60, block_edges=150).orderBy("scene", "candidate").collect()
    want = []
    for scene in (1, 2):
        own = [r for r in rows if r[0] == scene]
        nodes = {k: (a, b, b - a + 1) for r in own for k, a, b in ((r[1], *r[4:6]), (r[2], *r[6:8]))}
        want += [(scene, i, list(m)) for i, m in enumerate(selection.additive_contraction(nodes, sorted(r[1:4] for r in own), 60))]
    assert [tuple(r) for r in got] == want and want
    assert contraction.contracted(edges.where("false"), 60).collect() == []


def test_contraction_query_groups_no_scene(spark, data, monkeypatch):
    """The query gives the same rows when its one large component is dealt to many blocks."""
    want = sorted(map(tuple, catalogue.QUERIES["gaec_candidates"](spark, data).collect()))
    monkeypatch.setattr(contraction.contracted, "__defaults__", (100,))
    found = catalogue.QUERIES["gaec_candidates"](spark, data)
    assert sorted(map(tuple, found.collect())) == want
    assert "FlatMapGroupsInPandas" not in plan(found)


def test_contraction_holds_no_scene_in_a_task(spark):
    """One chain of 4,000 edges; a worker gets blocks of about 500."""
    rows = spark.range(4000).selectExpr("0L as scene", "id", "id + 1 as id2", "double(id * 7919 % 101) as cost", "id * 2 as lo", "id * 2 + 1 as hi", "id * 2 + 2 as lo2", "id * 2 + 3 as hi2")
    calls, large = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    run = contraction._run_block

    def counted(block, most):
        calls.add(1)
        large.add(int(len(block) > 1000))
        return run(block, most)

    contraction._run_block = counted
    try:
        assert contraction.contracted(rows, 12, block_edges=500).count()
    finally:
        contraction._run_block = run
    assert calls.value > 8 and large.value == 0
