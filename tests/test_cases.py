"""Hand-worked cases of the operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.functions import lie
from terrazzo.operators import evidence as ev
from terrazzo.operators import graph, metrics, selection, semantic, slam, spatial, surface, temporal


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_touching_instances_differ_in_color():
    color = selection.contact_colors([0, 1, 2], {(0, 1)})
    assert color[0] != color[1]


def test_long_side_and_index_map(spark):
    w, h = geo.long_side_size(F.lit(6), F.lit(4), F.lit(3))
    assert tuple(spark.range(1).select(w, h).first()) == (3, 2)
    x = spark.range(3).select(geo.nearest_index("id", F.lit(6), F.lit(3)))
    y = spark.range(2).select(geo.nearest_index("id", F.lit(4), F.lit(2)))
    assert [r[0] for r in x.collect()] == [0, 2, 4] and [r[0] for r in y.collect()] == [0, 2]


def test_coreset_of_poses(spark):
    rows = frame(spark, [(0, i, float(x), 0.0, 0.0, 0.0, 0.0, 1.0) for i, x in enumerate((0, 0.04, 0.09, 0.13, 0.18))], "scene int, i int, x double, y double, z double, ax double, ay double, az double")
    kept = temporal.scan_groups(rows, "scene", ["i"], temporal.keep_poses(0.08, geo.heading_moved(8)))
    assert pairs(kept, "i") == [(0,), (2,), (4,)]


def test_visible_points(spark):
    pose = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    points = frame(spark, [(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0)], "id int, x double, y double, z double").withColumn("pose", pose)
    x, y, z = geo.world_to_camera("x", "y", "z", "pose")
    u, v = geo.project(x, y, z, 1.0, 1.0, 0.0, 0.0)
    seen = points.withColumns({"u": u, "v": v, "zc": z}).where(geo.visible("u", "v", "zc", F.lit(1.0), 2, 1, 0.05))
    assert pairs(seen, "id", "u", "v") == [(0, 0.0, 0.0), (1, 1.0, 0.0)]


def test_points_behind_the_camera_are_guarded(spark):
    u, v = geo.project(F.lit(1.0), F.lit(1.0), F.col("z"), 1.0, 1.0, 0.0, 0.0)
    assert [tuple(r) for r in frame(spark, [(0.0,), (-1.0,), (2.0,)], "z double").select(u, v).collect()] == [(None, None), (None, None), (0.5, 0.5)]


LIFT_I = [(0, 0, 0, 0, 1), (0, 0, 0, 1, 1), (1, 0, 0, 0, 1), (1, 0, 0, 1, 2)]


def test_affinity_of_a_lift(spark):
    leaf_i = frame(spark, LIFT_I, "atom long, f int, g int, seg long, cnt long")
    leaf_n = frame(spark, [(0, 0, 2), (1, 0, 2)], "atom long, f int, n long")
    row = ev.affinity(frame(spark, [(0, 1)], "a long, b long"), leaf_i, leaf_n).first()
    assert row["num"] == pytest.approx(3 / math.sqrt(20)) and row["w"] == 1


def test_a_frame_with_one_claimed_side_counts_against(spark):
    leaf_i = frame(spark, [(0, 0, 0, 0, 1), (1, 0, 0, 0, 1), (0, 1, 0, 1, 1)], "atom long, f int, g int, seg long, cnt long")
    leaf_n = frame(spark, [(0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1)], "atom long, f int, n long")
    row = ev.affinity(frame(spark, [(0, 1)], "a long, b long"), leaf_i, leaf_n).first()
    assert (row["num"], row["w"]) == (1.0, 2)


def test_affinity_equals_a_dense_formula(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(1, 6, (6, 4))
    counts = rng.integers(0, 3, (6, 4, 5))
    leaf_n = frame(spark, [(a, f, int(n[a, f])) for a in range(6) for f in range(4)], "atom long, f int, n long")
    leaf_i = frame(spark, [(a, f, 0, m, int(counts[a, f, m])) for a in range(6) for f in range(4) for m in range(5) if counts[a, f, m]], "atom long, f int, g int, seg long, cnt long")
    edges = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    found = {(r["a"], r["b"]): (r["num"], r["w"]) for r in ev.affinity(frame(spark, edges, "a long, b long"), leaf_i, leaf_n).collect()}
    x = counts / n[:, :, None]
    length = np.sqrt((x**2).sum(axis=2, keepdims=True))
    s = np.where(length > 0, x / np.where(length > 0, length, 1), 0) * np.sqrt(np.minimum(x.max(axis=2, keepdims=True), 1))
    for a, b in edges:
        num, w = float((s[a] * s[b]).sum()), int(((x[a].sum(axis=1) > 0) | (x[b].sum(axis=1) > 0)).sum())
        if num > 0:
            assert found[a, b] == (pytest.approx(num, rel=1e-12), w)


def test_links_of_equal_tracks(spark):
    sets = frame(spark, [(t, p) for t in (0, 1) for p in (1, 2, 3)], "track long, atom long")
    links = ev.mutual_best(ev.set_overlaps(sets), frame(spark, [(0, 0), (1, 1)], "track long, chunk long"))
    assert pairs(links, "track", "track2", "iou") == [(0, 1, 1.0)]


def test_crowded_elements_raise(spark):
    with pytest.raises(ValueError, match="more than"):
        ev.set_overlaps(frame(spark, [(t, 1) for t in range(5)], "track long, atom long"), most=3)


def test_constrained_components_refuse_a_chunk_twice():
    import pandas as pd

    links = pd.DataFrame([(0.95, 1, 2, 0, 1), (0.9, 2, 3, 1, 0)], columns=["iou", "a", "b", "chunk_a", "chunk_b"])
    found = dict(selection.constrained_components(links).itertuples(index=False))
    assert found == {1: 1, 2: 1, 3: 3}


def test_atoms_and_adjacency(spark):
    atoms = frame(spark, list(enumerate((1, 0, 1, 2, 0))), "id long, atom long")
    edges = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "lo long, hi long, dist double")
    assert pairs(spatial.adjacency(edges, atoms), "a", "b", "cross_edges") == [(0, 1, 2), (1, 2, 1)]


def test_tree_evidence_sums_leaves(spark):
    tree = selection.tree_rows(4, {4: (0, 1), 5: (2, 3), 6: (4, 5)}, [1, 1, 1, 1, 2, 2, 4])
    assert tree.set_index("node").loc[[4, 5, 6], ["lo", "hi"]].values.tolist() == [[0, 1], [2, 3], [0, 3]]


def test_fusion_pool_and_overlap(spark):
    points = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])], "id long, e array<double>")
    memb = frame(spark, [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (2, 1)], "hyp long, id long")
    pooled = semantic.pool(points, memb)
    b = {(r["hyp"], r["dim"]): r["value"] for r in pooled.collect()}
    assert b == {(0, 0): 0.5, (0, 1): 1.5, (2, 0): 0.0, (2, 1): 3.0}
    c = {(r["id"], r["dim"]): r["value"] for r in semantic.overlap(pooled, memb).collect()}
    assert c == {(0, 0): 0.5, (0, 1): 1.5, (1, 0): 0.25, (1, 1): 2.25, (2, 0): 0.5, (2, 1): 1.5}


def test_text_scores_do_not_compete(spark):
    cos = frame(spark, [(0, 0, 1.0), (0, 1, 0.0)], "id long, query long, cos double")
    neg = frame(spark, [(0, k, 0.0) for k in range(4)], "id long, query long, cos double")
    got = {r["query"]: r["score"] for r in semantic.text_scores(cos, neg).collect()}
    assert got[0] == pytest.approx(math.exp(2) / (math.exp(2) + 4)) and got[1] == pytest.approx(1 / 5)


def test_kabsch_turn(spark):
    p = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)]
    rows = frame(spark, [(*q, -q[1] + 2, q[0] - 3, q[2] + 4) for q in p], "x double, y double, z double, x2 double, y2 double, z2 double")
    r, t, s = metrics.kabsch(rows, True)
    assert np.allclose(r, [[0, -1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-12) and np.allclose(t, (2, -3, 4)) and s == pytest.approx(1)


def test_recall_with_an_excluded_label(spark):
    memb = frame(spark, [(0, 0), (0, 1), (0, 4), (1, 2), (1, 3)], "hyp long, id long")
    labels = frame(spark, [(0, 1), (1, 1), (2, 2), (3, 2), (4, None)], "id long, gt long")
    row = metrics.average_recall(metrics.instance_ious(memb, labels), labels, (0.5, 0.75)).first()
    assert (row["ar"], row["r50"], row["r75"], row["n_gt"]) == (0.75, 1.0, 0.5, 2)


def test_gt_cloud_cell(spark):
    pose = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    rows = frame(spark, [(0, 0, 1000), (1, 0, 0)], "u int, v int, mm int").withColumn("d", geo.from_millimetres("mm")).where("d > 0")
    x, y, z = geo.apply_pose(*geo.unproject("u", "v", "d", 1.0, 1.0, 0.0, 0.0), pose)
    cells = spatial.occupancy(rows.select(F.lit(0).alias("id"), x.alias("x"), y.alias("y"), z.alias("z")), 0.5)
    assert pairs(cells, "cx", "cy", "cz") == [(1.25, 0.25, 1.25)]


def test_auc_counts_an_error_at_the_threshold(spark):
    got = {r["threshold"]: r["auc"] for r in metrics.pose_auc(frame(spark, [(3.0,), (0.5,), (10.0,)], "e double"), (3,)).collect()}
    assert got[3] == pytest.approx((1 / 3 + 1 / 3 + 2 / 3) / 3)


def test_empty_clouds_are_infinitely_far(spark):
    none = frame(spark, [], "id long, x double, y double, z double")
    row = metrics.reconstruction(none, none).first()
    assert row["acc"] == math.inf and row["comp"] == math.inf


def test_asof_tie_takes_the_later(spark):
    left = frame(spark, [(1, 10, 0)], "u int, t long, id long")
    right = frame(spark, [(1, 8, 7), (1, 12, 9), (2, 10, 5)], "u int, t long, id long")
    assert pairs(temporal.asof_nearest(left, right, "u", 5), "id", "id2", "dt") == [(0, 9, 2)]
    assert temporal.asof_nearest(left, right, "u", 1).count() == 0


def test_nearest_without_a_cap(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 3)) * [1, 1, 30], rng.normal(size=(25, 3))
    left, right = (frame(spark, [(i, *map(float, p)) for i, p in enumerate(c)], "id long, x double, y double, z double") for c in (a, b))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    got = {(r["id"], r["rank"]): r["id2"] for r in spatial.nearest(left, right, 3, 0.05).collect()}
    for i in range(len(a)):
        assert [got[i, k + 1] for k in range(3)] == np.argsort(d[i], kind="stable")[:3].tolist()


def test_shortest_paths_to_seeds(spark):
    rng = np.random.default_rng(2)
    edges = {(int(min(a, b)), int(max(a, b))): float(c) for a, b, c in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.uniform(0.1, 1, 60)) if a != b}
    seeds = [0, 7, 20]
    got = {r["id"]: (r["seed"], r["cost"]) for r in spatial.shortest_to_seeds(frame(spark, [(a, b, c) for (a, b), c in edges.items()], "lo long, hi long, cost double"), frame(spark, [(s,) for s in seeds], "id long"), frame(spark, [(i,) for i in range(30)], "id long")).collect()}
    best = {s: (0.0, s) for s in seeds}
    for _ in range(30):
        for (a, b), c in edges.items():
            for x, y in ((a, b), (b, a)):
                if x in best and (best[x][0] + c, best[x][1]) < best.get(y, (math.inf, 99)):
                    best[y] = (best[x][0] + c, best[x][1])
    for i in range(30):
        cost, seed = best.get(i, (0.0, i))
        assert got[i] == (seed, pytest.approx(cost))


def test_components_of_a_chain(spark):
    rows = graph.components(frame(spark, [(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long"))
    assert {(r["node"], r["component"]) for r in rows.collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_subsampled_times(spark):
    rows = frame(spark, [(0, t) for t in (0, 100, 200, 300, 400, 500, 600)], "s int, ns long").withColumn("ns", F.col("ns") * 1_000_000)
    kept = temporal.scan_groups(rows, "s", ["ns"], temporal.keep_ticks("ns", 5.0))
    assert [r[1] // 1_000_000 for r in pairs(kept, "s", "ns")] == [0, 200, 400, 600]


def test_agglomeration_prefers_the_strong_border():
    tree = selection.agglomerate({0: 1, 1: 1, 2: 1}, [(0, 1, 9.0, 10.0), (1, 2, 1.0, 10.0)], 1.0, 1.0).set_index("node")
    assert tree.loc[3, ["left", "right"]].tolist() == [0, 1] and tree.loc[4, "size"] == 3
    leaves = tree[tree.left < 0]
    assert sorted(leaves.lo) == [0, 1, 2]


def test_agglomeration_against_a_slow_version():
    rng = np.random.default_rng(3)
    edges = [(a, b, float(rng.uniform(0, 5)), 5.0) for a in range(12) for b in range(a + 1, 12) if rng.uniform() < 0.4]
    tree = selection.agglomerate({i: 1 for i in range(12)}, edges, 1.0, 2.0)
    groups = {i: frozenset([i]) for i in range(12)}
    made = []
    while True:
        best = None
        for x in groups:
            for y in groups:
                if x < y:
                    e = [(n, w) for a, b, n, w in edges if a in groups[x] and b in groups[y] or b in groups[x] and a in groups[y]]
                    if e:
                        gain = (1 + sum(n for n, _ in e)) / (3 + sum(w for _, w in e))
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, x, y)
        if best is None:
            break
        merged = groups.pop(best[1]) | groups.pop(best[2])
        groups[min(best[1:])] = merged
        made.append(merged)
    rows = tree.set_index("node")
    at = {int(rows.lo[i]): i for i in range(12)}
    ours = [frozenset(at[p] for p in range(r.lo, r.hi + 1)) for r in tree[tree.left >= 0].itertuples()]
    assert ours == made


def test_contraction_vetoes():
    nodes = {i: (i, i, 1) for i in range(4)} | {9: (0, 3, 4)}
    costs = [(0, 1, 2.0), (1, 2, 1.5), (2, 9, 5.0), (2, 3, -1.0)]
    assert selection.additive_contraction(nodes, costs, 100) == [(0, 1, 2)]
    assert selection.additive_contraction(nodes, costs, 2) == []


def test_greedy_cover_budget_and_price():
    c = [(10, np.array([0, 1]), {0: 1.0}), (11, np.array([1, 2]), {1: 0.9}), (12, np.array([3]), {2: 0.3})]
    picks = selection.greedy_cover(c, 4, (1, 2))
    assert [(n, k) for n, k, _ in picks] == [(10, 1), (11, 2)]


def test_exchange_is_free_of_loss():
    children = {1: (0, 0, {0: 0.5}), 2: (1, 1, {0: 0.4})}
    assert selection.ancestor_exchange(children, {3: (0, 1, {0: 0.5})}, 2, 5) == {1: 3, 2: 3}
    assert selection.ancestor_exchange(children, {3: (0, 1, {0: 0.4})}, 2, 5) == {1: 1, 2: 2}


def test_mixture_of_two_rates(spark):
    rows = [(9.0, 10.0)] * 30 + [(0.0, 10.0)] * 70
    same, other, share = ev.mixture(frame(spark, rows, "k double, n double"))
    assert ev.mixture(frame(spark, rows, "k double, n double"), 5, in_driver=0) == pytest.approx(ev.mixture(frame(spark, rows, "k double, n double"), 5))
    assert same == pytest.approx(0.9, abs=0.02) and other < 0.01 and share == pytest.approx(0.3, abs=0.02)


def test_se3_round_trip():
    rng = np.random.default_rng(0)
    xi = rng.normal(size=(20, 6))
    pose = lie.exp(xi)
    assert np.allclose(lie.log(pose), xi, atol=1e-9)
    p = rng.normal(size=(20, 3))
    assert np.allclose(lie.act(lie.inv(pose), lie.act(pose, p)), p)
    assert np.allclose(lie.matrix(pose)[:, :3, :3] @ p[..., None] + lie.matrix(pose)[:, :3, 3:], lie.act(pose, p)[..., None])
    assert np.allclose(lie.interpolate(pose[:10], pose[10:], np.ones(10)), lie.mul(lie.mul(pose[10:], lie.inv(pose[:10])), pose[:10]), atol=1e-9)
    assert np.allclose(lie.matrix(lie.exp(lie.adjoint(pose, xi * 0.1))), lie.matrix(lie.mul(lie.mul(pose, lie.exp(xi * 0.1)), lie.inv(pose))), atol=1e-8)


def test_quaternion_round_trip(spark):
    q = np.array([0.5, 0.5, -0.5, 0.5])
    m = geo.quaternion_matrix(*[F.lit(float(x)) for x in q])
    back = spark.range(1).select(geo.quaternion(m)).first()[0]
    assert np.allclose(back, q)


def test_schur_solve_equals_the_dense_system(spark):
    rng = np.random.default_rng(5)
    h0, e0, c0 = rng.normal(size=(3, 3)), rng.normal(size=(3, 6)) * 0.3, rng.uniform(2, 3, 6)
    h0 = h0 @ h0.T + 5 * np.eye(3)
    v0, w0 = rng.normal(size=3), rng.normal(size=6)
    block = lambda a: frame(spark, [(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "i long, j long, value double")
    x, z = slam.schur_solve(block(h0), block(e0), block(np.diag(c0)).where("i = j"), frame(spark, list(enumerate(map(float, v0))), "i long, value double"), frame(spark, list(enumerate(map(float, w0))), "i long, value double"))
    full = np.linalg.solve(np.block([[h0, e0], [e0.T, np.diag(c0)]]), np.concatenate([v0, w0]))
    assert np.allclose([r["value"] for r in x.orderBy("i").collect()], full[:3])
    assert np.allclose([r["value"] for r in z.orderBy("i").collect()], full[3:])


def test_schur_solves_each_scene(spark, monkeypatch):
    blocks = lambda rows: frame(spark, rows, "s string, i long, j long, value double")
    h, e, c = blocks([("a", 0, 0, 4.0), ("b", 0, 0, 2.0)]), blocks([("a", 0, 0, 1.0), ("b", 0, 0, 0.5)]), blocks([("a", 0, 0, 2.0), ("b", 0, 0, 1.0)])
    v, w = (frame(spark, rows, "s string, i long, value double") for rows in ([("a", 0, 9.0), ("b", 0, 5.0)], [("a", 0, 4.0), ("b", 0, 3.0)]))
    x, z = slam.schur_solve(h, e, c, v, w, "s")
    assert {r["s"]: r["value"] for r in x.collect()} == pytest.approx({"a": 2.0, "b": 2.0})
    assert {r["s"]: r["value"] for r in z.collect()} == pytest.approx({"a": 1.0, "b": 2.0})
    monkeypatch.setattr(slam, "MOST_VARIABLES", 0)
    with pytest.raises(Exception, match="more than 0"):
        slam.schur_solve(h, e, c, v, w, "s")


def test_proximity_edges_by_hand():
    import pandas as pd

    pairs = pd.DataFrame([(i, j, 0.1 * abs(i - j) if i - j != 5 else 0.05) for i in range(9) for j in range(9) if i != j], columns=["i", "j", "dist"])
    forced = {(i, j) for i in range(9) for j in range(9) if 0 < abs(i - j) <= 2}
    found = lambda **how: {tuple(r) for r in slam.proximity_edges(pairs, 9, 1, 0.06, 2, **how).to_numpy().tolist()}
    # of 5-0, 6-1, 7-2, 8-3 (distance 0.05) each suppresses the next, which is 2 away in both indices together
    assert found(budget=100) == forced | {(5, 0), (0, 5), (7, 2), (2, 7)}
    assert found(budget=len(forced)) == forced | {(5, 0), (0, 5)}  # stops at more than the budget
    assert found(budget=0) == forced
    assert found(budget=100, present=((5, 0),)) == forced | {(7, 2), (2, 7)} - {(6, 1)}


def test_surface_of_a_plane(spark):
    voxels = frame(spark, [(i, j, k, k - 1.25) for i in range(3) for j in range(3) for k in range(4)], "gx long, gy long, gz long, tsdf double")
    rows = surface.surface_points(voxels, 1.0).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["z"] == pytest.approx(1.75) and r["nz"] == pytest.approx(1) and r["gz"] == 1


def test_ssim_of_equal_images():
    a = np.random.default_rng(0).uniform(size=(20, 20, 3))
    assert metrics.ssim(a, a) == pytest.approx(1)


def test_images_of_size_zero_mse(spark):
    assert spark.range(1).select(metrics.psnr(F.lit(0.0))).first()[0] == math.inf
