"""Exact top-k by integer inner product: ball-tree branch and bound in every shard.

Vectors are dealt into cells around centres that are fitted on a bounded sample, and cells into
shards of about SHARD_ROWS. Each shard's task builds one ball tree and streams queries through it
in blocks. A node is visited only by the queries whose upper bound q.c + |q| r reaches their
current k-th score, larger bounds first. Every query first searches its own shard; the k-th score
found there goes with it, and only to cells whose own ball can still hold a better row.

Defined cases: vectors that are null or hold a null or non-finite component take no part, as
queries or candidates; nor does an empty one or a row without an id. Vectors of different lengths
aren't compared. Where an id occurs more than once, each of its rows asks and each is a candidate of
other ids' queries; the answer of an id is the best of what its rows find, rows of its own id left
out. Ties go to the smaller id. With fewer than k other rows a query returns them all. An empty table gives no rows.
A component or a score that doesn't fit 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.llm.common import materialise, n_partitions

SHARD_ROWS = 16_384
LEAF = 256
SCALE = 64
#: Bounds of what the driver fits and every task holds: cells, rows a cell in the sample, numbers in it.
CELLS = 4096
SAMPLE_PER_CELL = 16
SAMPLE_NUMBERS = 4_000_000
NONE = np.iinfo(np.int64).min


def ball_slack(norms, centre_norm, radius):
    """What a score in a ball can have above q.c; the small part covers rounding, so no row is ever cut wrongly."""
    return norms * radius + 1e-9 * norms * (centre_norm + radius) + 1e-3


class BallTree:
    """Nodes as (centre, radius, children or rows); balls hold all rows below them."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows = rows.astype(np.float64)
        self.nodes: list[tuple[np.ndarray, float, tuple[int, int] | None, np.ndarray]] = []
        self._grow(np.arange(len(rows)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        points = self.rows[members]
        centre = points.mean(axis=0)
        away = ((points - centre) ** 2).sum(axis=1)
        self.nodes.append((centre, float(np.sqrt(away.max())), None, members))
        if len(members) > leaf and away.max() > 0:
            one = points[away.argmax()]
            other = points[((points - one) ** 2).sum(axis=1).argmax()]
            order = np.argsort(points @ (other - one), kind="stable")
            half = len(members) // 2
            children = (self._grow(members[order[:half]], leaf), self._grow(members[order[half:]], leaf))
            self.nodes[at] = (centre, self.nodes[at][1], children, members[:0])
        return at

    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        centre, radius = self.nodes[node][:2]
        return queries @ centre + ball_slack(norms, np.sqrt(centre @ centre), radius)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int):
    """(query row, id, score) of each query's best k rows that score at least its kth so far."""
    points, norms = queries.astype(np.float64), np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    kth = kth.copy()
    best_q, best_i, best_s = (np.zeros(0, np.int64) for _ in range(3))
    stack = [(0, np.arange(len(queries)))]
    most = float(np.abs(tree.rows).max(initial=0)) * float(np.abs(points).max(initial=0)) * tree.rows.shape[1]
    if most >= 2**62:
        raise ValueError("inner products may not fit 64 bits")
    exact = most < 2**53
    while stack:
        node, active = stack.pop()
        active = active[tree.bound(node, points[active], norms[active]) >= kth[active]]
        if not len(active):
            continue
        _, _, children, members = tree.nodes[node]
        if children:
            bounds = [tree.bound(c, points[active], norms[active]).mean() for c in children]
            stack += [(c, active) for _, c in sorted(zip(bounds, children))]  # the larger bound is popped first
            continue
        if exact:
            scores = (points[active] @ tree.rows[members].T).astype(np.int64)
        else:
            scores = queries[active].astype(np.int64) @ tree.rows[members].astype(np.int64).T
        hit = (scores >= kth[active][:, None]) & (query_ids[active][:, None] != ids[members][None, :])
        q, c = np.nonzero(hit)
        if not len(q):
            continue
        touched = np.zeros(len(queries), bool)
        touched[active[q]] = True
        again = touched[best_q]
        all_q, all_i, all_s = np.concatenate([best_q[again], active[q]]), np.concatenate([best_i[again], ids[members][c]]), np.concatenate([best_s[again], scores[q, c]])
        order = np.lexsort((all_i, -all_s, all_q))
        all_q, all_i, all_s = all_q[order], all_i[order], all_s[order]
        start = np.flatnonzero(np.r_[True, all_q[1:] != all_q[:-1]])
        rank = np.arange(len(all_q)) - np.repeat(start, np.diff(np.r_[start, len(all_q)]))
        last = rank == k - 1
        kth[all_q[last]] = np.maximum(kth[all_q[last]], all_s[last])
        keep = rank < k
        best_q, best_i, best_s = np.concatenate([best_q[~again], all_q[keep]]), np.concatenate([best_i[~again], all_i[keep]]), np.concatenate([best_s[~again], all_s[keep]])
    return best_q, best_i, best_s


def _usable(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(64 x)) of the vectors of each length that take part."""
    keys, lists = batch.column(0), batch.column(1)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    owner = np.repeat(np.arange(len(size)), size)
    whole = np.bincount(owner, ~np.isfinite(x), len(size)) == 0
    start = np.cumsum(size) - size
    ok = whole & (size > 0) & ~keys.is_null().to_numpy(zero_copy_only=False)
    if (np.abs(x[ok[owner]]) >= 2.0**63).any():
        raise ValueError("a component doesn't fit 64 bits")
    ids = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
    rows = [(np.flatnonzero(ok & (size == n)), n) for n in np.unique(size[ok])]
    return [(ids[at], x[start[at][:, None] + np.arange(n)].astype(np.int64)) for at, n in rows]


def _fitted(points: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Centres of `cells` clusters of the points, by Lloyd's rounds."""
    centres = points[np.linspace(0, len(points) - 1, cells).astype(int)]
    for _ in range(rounds):
        cell = _nearest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, cell, points)
        size = np.bincount(cell, minlength=cells)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(points[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])


def _centres(slim: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For each vector length, the centres of its cells, from a sample; none where one shard holds all."""
    cells = min(CELLS, -(-count // SHARD_ROWS))
    if cells < 2:
        return {}
    wanted = cells * SAMPLE_PER_CELL
    dealt = F.xxhash64("vec_id", F.lit(11))
    sample = slim.where(dealt / 2.0**64 + 0.5 < 2 * wanted / count).where(F.size("e") <= SAMPLE_NUMBERS // wanted).orderBy(dealt, "vec_id").limit(wanted).toArrow()
    parts = [part for batch in sample.to_batches() for part in _usable(batch)]
    whole = sum(len(ids) for ids, _ in parts)
    found = {}
    for n in {rows.shape[1] for _, rows in parts}:
        points = np.concatenate([rows for _, rows in parts if rows.shape[1] == n]).astype(np.float64)
        found[n] = _fitted(points, max(1, cells * len(points) // whole))
    return found


def _placed(batches, centres: dict[int, np.ndarray]):
    """vec_id, v, dim, cell and the distance from the cell's centre (from 0 where a length has no centres)."""
    for batch in batches:
        for ids, rows in _usable(batch):
            points, own = rows.astype(np.float64), centres.get(rows.shape[1], np.zeros((1, rows.shape[1])))
            cell = _nearest(points, own)
            away = np.sqrt(((points - own[cell]) ** 2).sum(axis=1))
            packed = rows.astype("<i8").tobytes()
            width = 8 * rows.shape[1]
            v = [packed[i : i + width] for i in range(0, len(packed), width)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(v, pa.binary()), pa.array(np.full(len(ids), rows.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array(away)], names=["vec_id", "v", "dim", "cell", "away"])


def _sent(batches, cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """Queries (dim, cell, sub, vec_id, v, kth) of a shard -> the same for every other shard whose
    cell's ball may hold a row that scores at least kth. cells: by length, numbers, centres, radii
    and shards of the cells."""
    for batch in batches:
        dims, home, sub, ids, v, kth = (batch.column(i) for i in range(6))
        dims = dims.to_numpy()
        for n in np.unique(dims).tolist():
            at = np.flatnonzero(dims == n)
            number, centre, radius, shards = cells[n]
            own, part, least = (c.to_numpy()[at] for c in (home, sub, kth))
            rows = np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), "<i8").reshape(-1, n)
            points = rows.astype(np.float64)
            norms = np.sqrt((points**2).sum(axis=1))
            bound = points @ centre.T + ball_slack(norms[:, None], np.sqrt((centre**2).sum(axis=1)), radius)
            q, c = np.nonzero(bound >= least[:, None])
            many = shards[c]
            q, c = np.repeat(q, many), np.repeat(c, many)
            inside = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
            other = (number[c] != own[q]) | (inside != part[q])
            q, c, inside = q[other], c[other], inside[other]
            for i in range(0, len(q), 4096):
                k, row = slice(i, i + 4096), at[q[i : i + 4096]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), n, np.int32)), pa.array(number[c[k]].astype(np.int32)), pa.array(inside[k].astype(np.int32)), ids.take(pa.array(row)), v.take(pa.array(row)), kth.take(pa.array(row))], names=["dim", "cell", "sub", "vec_id", "v", "kth"])


def _search_shards(batches, k: int):
    """Rows (dim, cell, sub, kind, vec_id, v, kth) sorted by shard and kind: a shard's candidates,
    then the queries sent to it."""
    here, ids, vectors, tree = None, [], [], None
    for batch in batches:
        marks = np.stack([batch.column(i).to_numpy() for i in range(4)])
        cut = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for start, stop in zip([0, *cut], [*cut, batch.num_rows]):
            part, shard = batch.slice(start, stop - start), tuple(marks[:3, start].tolist())
            if shard != here:
                here, ids, vectors, tree = shard, [], [], None
            block = np.frombuffer(b"".join(part.column(5).to_pylist()), "<i8").reshape(-1, shard[0])
            key = part.column(4).to_numpy()
            if marks[3, start] == 0:
                ids.append(key)
                vectors.append(block)
                continue
            if not ids:
                continue
            if tree is None:
                all_ids, tree = np.concatenate(ids), BallTree(np.concatenate(vectors))
            q, i, s = search(tree, all_ids, block, key, part.column(6).to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(key[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, against all others."""
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    count = slim.count()
    centres = vectors.sparkSession.sparkContext.broadcast(_centres(slim, count))
    rows = slim.mapInArrow(lambda batches: _placed(batches, centres.value), "vec_id long, v binary, dim int, cell int, away double")
    dealt = F.xxhash64("vec_id", F.lit(7))
    if not slim.where("vec_id is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        # of equal rows k say as much as all; an id with very many rows is dealt by row
        equal = rows.groupBy("vec_id", "v", "dim", "cell").agg(F.first("away").alias("away"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
        rows = equal.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
        dealt = F.xxhash64("vec_id", "v", "copy")
    rows = materialise(rows)
    held = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("c"), F.max("away").alias("radius"))
    # a row a cell: at most CELLS for each length of vectors
    found = sorted(map(tuple, held.collect()))
    cells = {}
    for n in {f[0] for f in found}:
        number, size, radius = (np.array([f[i] for f in found if f[0] == n]) for i in (1, 2, 3))
        cells[n] = number, centres.value.get(n, np.zeros((1, n)))[number], radius, -(-size // SHARD_ROWS)
    shards = max(1, sum(int(c[3].sum()) for c in cells.values()))
    if shards > 1:
        split = [(n, int(c), int(m)) for n, (number, _, _, many) in cells.items() for c, m in zip(number, many)]
        split = F.broadcast(vectors.sparkSession.createDataFrame(split, "dim int, cell int, parts int"))  # a row a cell
        rows = rows.join(split, ["dim", "cell"]).withColumn("sub", F.pmod(dealt, F.col("parts")).cast("int"))
    else:
        rows = rows.withColumn("sub", F.lit(0))
    columns = ["dim", "cell", "sub", "kind", "vec_id", "v", "kth"]
    nothing = F.lit(int(NONE))
    candidates = rows.withColumns({"kind": F.lit(0), "kth": nothing}).select(columns)
    queries = rows.where(F.col("vec_id") % every == 0)
    parts = max(n_partitions(vectors), shards)

    def searched(asked: DataFrame) -> DataFrame:
        both = candidates.unionByName(asked.withColumn("kind", F.lit(1)).select(columns)).repartition(parts, "dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "kind", "vec_id")
        return both.mapInArrow(lambda batches: _search_shards(batches, k), "query_id long, vec_id long, score long")

    result = searched(queries.withColumn("kth", nothing))
    if shards > 1:
        result = home = materialise(result)
        reached = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
        bounded = queries.join(reached, F.col("vec_id") == F.col("query_id"), "left").select("dim", "cell", "sub", "vec_id", "v", F.coalesce("least", nothing).alias("kth"))
        known = vectors.sparkSession.sparkContext.broadcast(cells)
        away = bounded.mapInArrow(lambda batches: _sent(batches, known.value), "dim int, cell int, sub int, vec_id long, v binary, kth long")
        result = home.unionByName(searched(away))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return result.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
