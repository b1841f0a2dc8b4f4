"""Near-duplicate documents by SetSketch banding, joint likelihood and exact verification.

1. One pass over the texts gives each document's shingle set size, a 128-bit fingerprint of the
   set and the band keys of its SetSketch. Documents with equal sets share one representative
   from here on, so a group of copies, however large, costs one row.
2. Representatives that share a band key are joined to the least of them; connected components of
   these stars are candidate clusters. With the banding chosen below, two documents at the
   threshold share no band once in about 10^5 pairs, and more similar ones far less often.
3. Each cluster is dealt into blocks of bounded size, and a block is one task. In a task, register
   agreement gives each pair's similarity of greatest likelihood; pairs that could reach the
   threshold (five standard deviations of slack) and aren't yet connected are confirmed on their
   full shingle sets. About PIVOTS members of a cluster go to all its blocks, so the blocks of one
   family of near copies link up through them and are never compared with each other.
4. What a cluster of several blocks still holds apart from its largest group, the leftovers, is
   compared with all members that share a band key with a leftover, block by block. A cluster of
   one block is settled by step 3, and so is one that it has linked up.
5. Components of the confirmed links give each document the least id that it can reach.

Defined cases: a document without words is linked with nothing and keeps itself. Repeated rows are
equal sets; rows of one id and different texts are one document that has the links of both. Rows with a null id keep themselves and take no part. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.llm.common import materialise, n_partitions, slices, small_batches
from terrazzo.llm.graph import components
from terrazzo.llm.sketch import WordIds, bands, joint_estimate, shingles, sketch

N_BANDS = 40
MISSED = 1e-5
#: A verification task holds a block, or two that are compared with each other, of about so many
#: documents and shingles.
BLOCK_DOCS = 256
PAIR_DOCS = 1000
PIVOTS = 16
BLOCK_SHINGLES = 2_000_000
#: Characters whose sets are sketched together.
SLICE_CHARS = 500_000


def rows_per_band(percent: int) -> int:
    """The longest bands that miss a pair at the threshold less than once in 1/MISSED."""
    j, rows = percent / 100, 1
    while (1 - j ** (rows + 1)) ** N_BANDS < MISSED:
        rows += 1
    return rows


def _sketched(batches, width: int, m: int):
    ids = WordIds()
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for start, stop in slices([len(t or "") for t in texts], SLICE_CHARS):
            sets = [shingles(t, width, ids) for t in texts[start:stop]]
            full = [i for i, s in enumerate(sets) if len(s)]
            found = bands(sketch([sets[i] for i in full], m), N_BANDS) if full else None
            rows: list = [None] * len(sets)
            for k, i in enumerate(full):
                rows[i] = found[k]
            marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [keys.slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64())] + [pa.array([int.from_bytes(x[k : k + 8], "big", signed=True) for x in marks], pa.int64()) for k in (0, 8)] + [pa.array(rows, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "f1", "f2", "bands"],
            )


def _linked(sets: list[np.ndarray], side: list[int], group: list[int], percent: int, m: int):
    """Index pairs that connect all documents linked within a task.

    Sides 1 and 2 are compared with each other, side 0 with itself; documents of one group are
    linked already.
    """
    count = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    registers = sketch(sets, m)
    side_of, label = np.array(side), np.array(group, np.int64)
    slack = 5 * math.sqrt(percent * (100 - percent)) / 100 / math.sqrt(m)
    least = percent / 100 - slack
    first, second, likely = [], [], []
    for i in range(count - 1):
        rest = np.arange(i + 1, count)
        rest = rest[(label[rest] != label[i]) & ((side_of[rest] != side_of[i]) | (side_of[i] == 0))]
        rest = rest[np.minimum(size[rest], size[i]) * 100 >= percent * np.maximum(size[rest], size[i])]
        if not len(rest):
            continue
        greater, less = (registers[i] > registers[rest]).sum(axis=1), (registers[i] < registers[rest]).sum(axis=1)
        close = (m - greater - less) >= (least - 0.05) * m
        rest, greater, less = rest[close], greater[close], less[close]
        if len(rest):
            j = joint_estimate(np.full(len(rest), size[i]), size[rest], greater, less, m)
            ok = j >= least
            first.append(np.full(int(ok.sum()), i))
            second.append(rest[ok])
            likely.append(j[ok])
    if not first:
        return
    first, second, likely = np.concatenate(first), np.concatenate(second), np.concatenate(likely)
    order = np.argsort(-likely, kind="stable")
    first, second = first[order], second[order]
    for start in range(0, len(first), 512):
        a, b = first[start : start + 512], second[start : start + 512]
        apart = label[a] != label[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            if label[x] == label[y]:
                continue
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                label[label == label[y]] = label[x]
                yield x, y


def _verified(batches, width: int, percent: int, m: int):
    """Rows sorted by task: (cluster, lo, hi, side, group, doc_id, text). Yields confirmed links."""
    ids = WordIds()
    task, keys, sets, side, group = None, [], [], [], []

    def links():
        pairs = [(keys[x], keys[y]) for x, y in _linked(sets, side, group, percent, m)] if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            if (row["cluster"], row["lo"], row["hi"]) != task:
                if len(sets) > 1:
                    yield links()
                task, keys, sets, side, group = (row["cluster"], row["lo"], row["hi"]), [], [], [], []
            keys.append(row["doc_id"])
            sets.append(shingles(row["text"], width, ids))
            side.append(row["side"])
            group.append(row["group"])
    if len(sets) > 1:
        yield links()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Two documents are linked when 100 * shared shingles >= percent * all shingles of both.
    """
    m = N_BANDS * rows_per_band(percent)
    slim = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = materialise(slim.mapInArrow(lambda batches: _sketched(batches, width, m), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"))
    sets = materialise(known.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    keyed = sets.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "pivot")
    stars = keyed.join(shared, "key").where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    members = components(stars).join(sets.select(F.col("rep").alias("node"), "n_shingles", "bands"), "node")
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), _blocks(BLOCK_DOCS).alias("blocks"))
    placed = members.join(size, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "size", "blocks", "n_shingles", "bands")
    # the texts are shuffled once; from here on only those of members are carried
    held = materialise(slim.join(placed, "doc_id"))

    def verified(tasks: DataFrame) -> DataFrame:
        """Links in tasks(cluster, lo, hi, side, group, doc_id, text)."""
        rows = tasks.select("cluster", "lo", "hi", "side", "group", "doc_id", "text").repartition(n_partitions(docs), "cluster", "lo", "hi")
        return rows.sortWithinPartitions("cluster", "lo", "hi", "side", "doc_id").mapInArrow(lambda batches: _verified(batches, width, percent, m), "a long, b long")

    # step 3: every member in its own block, pivots in all
    pivot = (F.col("blocks") > 1) & (F.xxhash64("doc_id", F.lit(9)) / 2.0**64 + 0.5 < PIVOTS / F.col("size"))
    block = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_dealt("doc_id", F.col("blocks")))))
    joined = components(verified(held.withColumn("lo", block).withColumns({"hi": F.col("lo"), "side": F.lit(0), "group": F.col("doc_id")})))
    # step 4: leftovers of the clusters that took several blocks
    split = held.where("blocks > 1")
    if not split.isEmpty():
        split = materialise(split.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("group", F.coalesce("component", "doc_id")).drop("component", "blocks"))
        # a group lies in one cluster; by the group alone, so that a large cluster is dealt over tasks
        groups = split.groupBy("group").agg(F.first("cluster").alias("cluster"), F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "group"))["group"].alias("most"))
        left = split.join(groups, "cluster").where("group <> most").drop("most")
        asked = left.select(F.explode("bands").alias("key")).distinct()
        hit = split.select("doc_id", F.explode("bands").alias("key")).join(asked, "key", "left_semi").select("doc_id").distinct()
        left, near = left.drop("bands"), split.drop("bands").join(hit, "doc_id", "left_semi")
        parts = left.groupBy("cluster").agg(_blocks(PAIR_DOCS).alias("parts")).join(near.groupBy("cluster").agg(_blocks(PAIR_DOCS).alias("others")), "cluster")
        left, near = (df.join(parts, "cluster") for df in (left, near))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = left.withColumns({"lo": _dealt("doc_id", F.col("parts")), "side": F.lit(1)}).withColumn("hi", every("others"))
        two = near.withColumns({"hi": _dealt("doc_id", F.col("others")), "side": F.lit(2)}).withColumn("lo", every("parts"))
        more = materialise(verified(one.unionByName(two)))
        if not more.isEmpty():
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # the sets of one id are one document
    of_id = known.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id")
    twice = of_id.agg(F.min(F.struct("f1", "f2")).alias("least"), F.max(F.struct("f1", "f2")).alias("most")).where("least <> most").select("doc_id")
    if not twice.isEmpty():
        reps = known.join(twice, "doc_id", "left_semi").where("n_shingles > 0").select("doc_id", "f1", "f2").distinct().join(sets.select("f1", "f2", "rep"), ["f1", "f2"]).select("doc_id", "rep")
        own = reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(own))
    lead = sets.select("f1", "f2", "rep").join(joined, F.col("rep") == F.col("node"), "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "rep").alias("component"))
    # the keys of the join are null where a document stands alone, so such rows meet nothing
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    rows = known.select("doc_id", "n_shingles", F.when(~alone, F.col("f1")).alias("f1"), F.when(~alone, F.col("f2")).alias("f2"))
    out = rows.join(lead, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _blocks(most: int):
    """Number of blocks that a group's documents need."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")


def _dealt(node: str, blocks):
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """Pipeline form: one row of each group of near-duplicates, that of the least id; columns stay.

    Of rows that repeat an id with its text one stays (of differing other columns, those of least
    hash). Rows with a null id take no part and stay. Maps are hashed as JSON.
    """
    kept = near_duplicates(docs, **how).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept_id")).distinct()
    rows = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__kept_id"), "left_semi")
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*plain)))
    return rows.withColumn("__again", again).where("__again = 1").drop("__again").unionByName(docs.where("doc_id is null"))
