"""Greedy additive edge contraction of a graph that no task holds whole.

The nodes are dealt to blocks by their place. A block contracts what no edge that leaves it can overtake and
freezes the rest; the next round deals what is frozen to other blocks, until one block holds all of it.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.operators.common import stored
from terrazzo.operators.selection import MOST_EDGES

#: Edges of a block, about; a worker holds one block.
BLOCK_EDGES = 25_000

#: A place in the order of the whole graph's contractions, see after(); an event is (-cost, a, b).
Moment = tuple[tuple[float, int, int], ...]


def after(moment: Moment, event: tuple[float, int, int]) -> Moment:
    """When an event comes that waits for `moment`; moments compare as tuples.

    Greedy takes the best edge there is, so what a contraction makes possible comes at once if it costs more,
    and else when its own cost's turn has come: in both cases after the least of those it waits for.
    """
    end = len(moment)
    while end and moment[end - 1] < event:
        end -= 1
    return (*moment[:end], event)


class Block:
    """The groups of one block and the edges that touch them; groups outside are known as they were at its start.

    groups: label -> (members, moment), a member being (id, lo, hi); inside: labels that belong to the block.
    """

    def __init__(self, groups: dict[int, tuple[list[tuple[int, int, int]], Moment]], inside: Iterable[int], edges: Iterable[tuple[int, int, float]], most: int):
        self.most = most
        self.members = {x: members for x, (members, _) in groups.items()}
        self.moment = {x: moment for x, (_, moment) in groups.items()}
        self.weight = {x: sum(hi - lo + 1 for _, lo, hi in members) for x, members in self.members.items()}
        self.edges: dict[int, dict[int, float]] = {x: {} for x in groups}
        for x, y, cost in edges:
            if x != y and self.weight[x] + self.weight[y] <= most:
                self.edges[x][y] = self.edges[y][x] = self.edges[x].get(y, 0.0) + cost
        self.waiting = sorted(((self.moment[x], x) for x in inside), reverse=True)  # the next one last
        self.inside, self.active = set(inside), set()
        self.offers: list[tuple[float, int, int]] = []
        self.threats: list[tuple[float, int]] = []
        self.exposed: dict[int, float] = {}
        self.parts = {x: [x] for x in inside}
        self.found: list[tuple[list[int], Moment]] = []

    def _apart(self, x: int, y: int) -> bool:
        """Whether no interval of one lies in one of the other."""
        return all((a > c or d > b) and (c > a or b > d) for (_, a, b), (_, c, d) in itertools.product(self.members[x], self.members[y]))

    def _offer(self, x: int, y: int) -> None:
        if y in self.active and (cost := self.edges[x][y]) > 0:
            heapq.heappush(self.offers, (-cost, min(x, y), max(x, y)))

    def _expose(self, x: int) -> None:
        """What edges to the outside can add up to, however its groups are joined."""
        self.exposed[x] = sum(cost for y, cost in self.edges[x].items() if y not in self.inside and cost > 0)
        if self.exposed[x] > 0:
            heapq.heappush(self.threats, (-self.exposed[x], x))

    def _drop(self, x: int, y: int) -> None:
        del self.edges[x][y], self.edges[y][x]

    def _activate(self, x: int) -> None:
        self.active.add(x)
        for y in self.edges[x]:
            self._offer(x, y)
        self._expose(x)

    def _freeze(self, x: int) -> None:
        """From now on a group of the outside, unless what it is exposed to are no possible groups."""
        nested = [y for y, cost in self.edges[x].items() if y not in self.inside and cost > 0 and not self._apart(x, y)]
        if nested:
            for y in nested:
                self._drop(x, y)
            self._expose(x)
            return
        self.active.remove(x)
        self.inside.remove(x)
        for y, cost in self.edges[x].items():
            if y in self.active and cost > 0:
                self._expose(y)

    def _merge(self, a: int, b: int, event: tuple[float, int, int]) -> None:
        self.active.remove(b)
        self.inside.remove(b)
        self.moment[a] = after(max(self.moment[a], self.moment[b]), event)
        self.members[a] = self.members[a] + self.members.pop(b)
        self.parts[a] += self.parts.pop(b)
        self.weight[a] += self.weight[b]
        loose = self.edges.pop(b)
        changed = []
        for y, cost in loose.items():
            del self.edges[y][b]
            if y != a:
                known = self.edges[a].get(y)
                self.edges[a][y] = self.edges[y][a] = cost if known is None else known + cost
                changed.append(y)
        for y in [y for y in self.edges[a] if self.weight[a] + self.weight[y] > self.most]:
            self._drop(a, y)
        for y in changed:
            if y in self.edges[a]:
                self._offer(a, y)
        self._expose(a)
        if len(self.members[a]) >= 3:
            self.found.append((sorted(m[0] for m in self.members[a]), self.moment[a]))

    def run(self) -> None:
        """Until each group is frozen or has no edge of positive cost left."""
        while True:
            while self.offers and not (self.offers[0][1] in self.active and self.offers[0][2] in self.active and self.edges[self.offers[0][1]].get(self.offers[0][2]) == -self.offers[0][0]):
                heapq.heappop(self.offers)
            while self.threats and not (self.threats[0][1] in self.active and self.exposed[self.threats[0][1]] == -self.threats[0][0]):
                heapq.heappop(self.threats)
            event = None
            if self.threats and (not self.offers or self.threats[0][0] <= self.offers[0][0]):  # equal: the outside may be first
                x = self.threats[0][1]
                when = after(self.moment[x], (self.threats[0][0], -1, -1))
            elif self.offers:
                event = self.offers[0]
                when = after(max(self.moment[event[1]], self.moment[event[2]]), event)
            elif not self.waiting:
                return
            else:
                when = None
            if self.waiting and (when is None or self.waiting[-1][0] < when):
                self._activate(self.waiting.pop()[1])
            elif event is None:
                heapq.heappop(self.threats)
                self._freeze(x)
            elif self._apart(*event[1:]):
                self._merge(*event[1:], event)
            else:
                self._drop(*event[1:])


def _flat(rows) -> list:
    return [v for row in rows for v in row]


def _run_block(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """What one block found (kind 0), its frozen groups (1) and the edges between those (2)."""
    if len(rows) > MOST_EDGES:
        raise ValueError(f"{len(rows)} edges in one block, more than {MOST_EDGES}")
    groups, scenes = {}, {}
    for end in ("", "2"):
        own = (rows[f"block{end}"] == rows["dealt"]).tolist()
        for x, mine, scene, members, moment in zip(rows[f"id{end}"].tolist(), own, rows["scene"].tolist(), rows[f"members{end}"], rows[f"moment{end}"]):
            if x not in groups:
                groups[x] = [tuple(m) for m in np.reshape(members, (-1, 3)).tolist()], tuple((c, int(a), int(b)) for c, a, b in np.reshape(moment, (-1, 3)).tolist())
            if mine:
                scenes[x] = scene
    block = Block(groups, sorted(scenes), sorted(zip(rows["id"].tolist(), rows["id2"].tolist(), rows["cost"].tolist())), most)
    block.run()
    frozen = block.parts.keys() - block.inside
    out = [(0, scenes[members[0]], None, None, None, members, _flat(moment), None) for members, moment in block.found]  # a group's label is its least member
    out += [(1, scenes[x], x, None, None, _flat(block.members[x]), _flat(block.moment[x]), block.parts[x]) for x in frozen]
    out += [(2, scenes[x], x, y, cost, None, None, None) for x in frozen for y, cost in block.edges[x].items() if x < y and y in frozen]
    return pd.DataFrame(out, columns=["kind", "scene", "id", "id2", "cost", "members", "moment", "parts"], dtype=object)


def _block_of(column: str, bounds: list[float]) -> Column:
    """The number of the block whose range of places holds a group's first member."""
    if not bounds:
        return F.lit(0).cast("long")
    return F.pandas_udf(lambda place: pd.Series(np.searchsorted(bounds, place, side="right")), "long")(F.col(column)[1])


def _next_edges(placed: DataFrame, out: DataFrame) -> DataFrame:
    """The edges between groups that are frozen on both sides, with what is known of these."""
    frozen = out.where("kind = 1")
    name = frozen.select(F.explode("parts").alias("part"), F.col("id").alias("label"))
    first, second = (name.select(F.col("part").alias(end), F.col("label").alias(f"label{end}")).hint("merge") for end in ("id", "id2"))
    across = placed.where("block <> block2").select("scene", "id", "id2", "cost").join(first, "id").join(second, "id2")
    in_order = F.array_sort(F.collect_list(F.struct("id", "id2", "cost")))  # so that sums don't depend on partitions
    summed = across.groupBy("scene", F.least("labelid", "labelid2").alias("id"), F.greatest("labelid", "labelid2").alias("id2")).agg(F.aggregate(in_order, F.lit(0.0), lambda total, e: total + e["cost"]).alias("cost"))
    edges = out.where("kind = 2").select("scene", "id", "id2", "cost").unionByName(summed)
    one = frozen.select("id", "members", "moment")
    two = one.select(F.col("id").alias("id2"), F.col("members").alias("members2"), F.col("moment").alias("moment2"))
    return edges.join(one.hint("merge"), "id").join(two.hint("merge"), "id2")


def _numbered(found: DataFrame) -> DataFrame:
    """scene, candidate, members: counted from 0 in each scene by moment; ranges of moments are counted apart."""
    placed = stored(found.repartitionByRange("scene", "moment").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("scene").orderBy("part")
    before = placed.groupBy("scene", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("scene", "part").orderBy("moment")) - 1
    return placed.withColumn("at", at).join(before.select("scene", "part", "before"), ["scene", "part"]).select("scene", (F.col("before") + F.col("at")).alias("candidate"), "members")


def contracted(rows: DataFrame, most: int, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """scene, candidate, members of selection.additive_contraction for each scene, which may be any size.

    rows(scene, id, id2, cost, lo, hi, lo2, hi2): edges and the intervals of their ends; a node is in one scene.
    Nodes that edges link should lie near in `lo`, or blocks freeze more than they contract; blocks grow where
    a round leaves more than half of the edges.
    """
    node = lambda end: F.array(*[F.col(f"{c}{end}").cast("long") for c in ("id", "lo", "hi")]).alias(f"members{end}")
    new = F.array().cast("array<double>")
    held = stored(rows.select("scene", "id", "id2", "cost", node(""), node("2"), new.alias("moment"), new.alias("moment2")))
    kind = rows.schema["scene"].dataType.simpleString()
    schema = f"kind int, scene {kind}, id long, id2 long, cost double, members array<long>, moment array<double>, parts array<long>"
    found, last = [], None
    for turn in itertools.count():
        count = held.count()
        if last is not None and count > last / 2:
            block_edges *= 2
        last, blocks = count, math.ceil(count / block_edges)
        shares = [(k + (0.5 if turn % 2 else 1)) / blocks for k in range(blocks)]
        bounds = held.select(F.col("members")[1].cast("double").alias("place")).approxQuantile("place", [s for s in shares if s < 1], 0.25 / blocks) if blocks > 1 else []
        placed = held.withColumns({"block": _block_of("members", bounds), "block2": _block_of("members2", bounds)})
        dealt = placed.withColumn("dealt", F.explode(F.array_distinct(F.array("block", "block2"))))
        out = stored(dealt.groupBy("dealt").applyInPandas(lambda block: _run_block(block, most), schema))
        found.append(out.where("kind = 0").select("scene", "members", "moment"))
        if blocks <= 1:
            return _numbered(functools.reduce(DataFrame.unionByName, found))
        held = stored(_next_edges(placed, out))
