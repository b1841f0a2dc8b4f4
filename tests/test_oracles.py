"""Every query with SQL gives what DuckDB gives."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows_of

from terrazzo.operators import surface
from terrazzo.plans import catalogue, tables
from terrazzo.plans import spatial as spatial_plans


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(name, spark, data, duck):
    ours, theirs = catalogue.QUERIES[name](spark, data).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours)
    a, b = rows_of(ours), rows_of(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p[0] == q[0] and (p[1] == pytest.approx(q[1], abs=2e-6) if p[0] == 1 else p[1] == q[1]), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(name, spark, data):
    assert catalogue.QUERIES[name](spark, data).count()


def test_contraction_query_equals_a_slow_version(spark, data):
    """Costs between groups summed anew from the edges that no veto retired."""
    rows = tables._contraction_rows(spark, data).toPandas()
    want = []
    for scene, part in rows.groupby("scene"):
        span = {k: (lo, hi) for k, lo, hi in [*zip(part.id, part.lo, part.hi), *zip(part.id2, part.lo2, part.hi2)]}
        groups = [frozenset([k]) for k in sorted(span)]
        live = {frozenset(p): c for *p, c in zip(part.id, part.id2, part.cost)}
        found = 0
        while True:
            cost = {}
            of = {k: g for g in groups for k in g}
            for pair, c in live.items():
                x, y = (of[k] for k in pair)
                if x != y:
                    cost[frozenset((x, y))] = cost.get(frozenset((x, y)), 0.0) + c
            best = max(cost.items(), key=lambda e: (e[1], *(-m for m in sorted(map(min, e[0])))), default=(None, 0.0))
            if best[1] <= 0:
                break
            x, y = best[0]
            nests = any(a[0] <= b[0] and b[1] <= a[1] or b[0] <= a[0] and a[1] <= b[1] for a in map(span.get, x) for b in map(span.get, y))
            if nests or sum(span[k][1] - span[k][0] + 1 for k in x | y) > 400:
                live = {p: c for p, c in live.items() if {of[k] for k in p} != {x, y}}
                continue
            groups = [g for g in groups if g not in (x, y)] + [x | y]
            if len(x | y) > 2:
                want.append((scene, found, sorted(x | y)))
                found += 1
    got = [(r["scene"], r["candidate"], r["members"]) for r in catalogue.QUERIES["gaec_candidates"](spark, data).collect()]
    assert sorted(got) == sorted(want) and want


def test_tree_query_equals_a_slow_version(spark, data):
    """Merges of the greatest pooled gain, pooled anew from the edges each time; places by more neighbours."""
    rows = tables._tree_edges(spark, data).toPandas()
    tree = catalogue.QUERIES["agglomerate_tree"](spark, data).toPandas()
    for scene, part in rows.groupby("scene"):
        atoms = sorted({*part.a, *part.b})
        a0, b0 = part.a0.iloc[0], part.b0.iloc[0]
        groups, made = {i: {x} for i, x in enumerate(atoms)}, []
        while True:
            of = {x: i for i, g in groups.items() for x in g}
            pooled = {}
            for a, b, num, w in zip(part.a, part.b, part.num, part.w):
                if of[a] != of[b]:
                    e = pooled.setdefault((min(of[a], of[b]), max(of[a], of[b])), [0.0, 0.0])
                    e[0], e[1] = e[0] + num, e[1] + w
            if not pooled:
                break
            gain = {p: (a0 + n) / (a0 + b0 + w) for p, (n, w) in pooled.items()}
            pair = min(gain, key=lambda p: (-round(gain[p], 12), p))
            around = {i: sum(i in p for p in pooled) for i in pair}
            kept = min(pair, key=lambda i: (-around[i], i))
            union = groups.pop(pair[0]) | groups.pop(pair[1])
            groups[kept] = union
            made.append(union)
        mine = tree[tree.scene == scene].set_index("node")
        leaf = {int(mine.lo[i]): x for i, x in enumerate(atoms)}
        inner = mine[mine.left >= 0].sort_index()
        assert [{leaf[p] for p in range(lo, hi + 1)} for lo, hi in zip(inner.lo, inner.hi)] == made
        assert inner["size"].tolist() == [len(g) for g in made]


def test_surface_query_lies_on_the_surface(spark, data):
    """Each point is a zero of the cell's interpolant and no ray from the centre meets the surface earlier."""
    cells = surface.cells_with_corners(surface.fuse(spatial_plans._tsdf_samples(spark, data))).toPandas()
    corners = {tuple(map(int, r[:3])): np.array(r[3:11], float) for r in cells.itertuples(index=False)}

    def value(s, p):
        """Linear on the simplex of the order of the coordinates."""
        order = np.argsort(-p, axis=-1, kind="stable")
        x = np.take_along_axis(p, order, -1)
        first = 1 << order[..., 0]
        second = first | 1 << order[..., 1]
        return s[0] * (1 - x[..., 0]) + s[first] * (x[..., 0] - x[..., 1]) + s[second] * (x[..., 1] - x[..., 2]) + s[7] * x[..., 2]

    rng = np.random.default_rng(0)
    rays = rng.normal(size=(400, 3))
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    steps = np.linspace(0, 0.87, 600)
    found = catalogue.QUERIES["surface_cells"](spark, data).toPandas()
    assert len(found) == len(corners)
    for r in found.itertuples():
        s = corners[r.gx, r.gy, r.gz]
        p = np.array([r.x, r.y, r.z]) / spatial_plans.VOXEL - np.array([r.gx, r.gy, r.gz]) - 0.5
        assert (p > -1e-4).all() and (p < 1 + 1e-4).all() and abs(value(s, np.clip(p, 0, 1))) < 1e-4 * max(1, np.abs(s).max())
        assert np.linalg.norm([r.nx, r.ny, r.nz]) == pytest.approx(1, abs=1e-4)
        path = 0.5 + rays[:, None] * steps[:, None]
        inside = ((path >= 0) & (path <= 1)).all(axis=2)
        sign = value(s, np.clip(path, 0, 1)) >= 0
        met = inside & (sign != sign[:, :1])
        first = np.where(met.any(axis=1), steps[met.argmax(axis=1)], np.inf).min()
        assert np.linalg.norm(p - 0.5) <= first + 2e-3


def test_colour_query_equals_the_eigenvectors(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding).astype(float)
    x, ids = x[(x != 0).any(axis=1)], rows.vec_id[(x != 0).any(axis=1)]
    away = x - x.mean(axis=0)
    _, axes = np.linalg.eigh(away.T @ away)
    axes = axes[:, ::-1][:, :3].T
    axes = axes * np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    along = away @ axes.T
    low, high = np.percentile(along, [1, 99], axis=0)
    want = dict(zip(ids, np.clip((along - low) / (high - low), 0, 1)))
    got = {r["id"]: (r["c0"], r["c1"], r["c2"]) for r in catalogue.QUERIES["principal_colors"](spark, data).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-4) for k in got)


@pytest.mark.parametrize("name", ["node_evidence_best_mask", "knn_edges", "asof_nearest_sync", "chain_collapse", "pack_offsets"])
def test_partitions_do_not_matter(name, spark, data):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows_of(catalogue.QUERIES[name](spark, data).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
