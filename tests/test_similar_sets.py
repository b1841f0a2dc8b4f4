"""The similarity join with prefixes against all pairs."""

from __future__ import annotations

import random

import pytest

from terrazzo.operators import evidence as ev

SETS = "track long, atom long"


def some(seed: int) -> dict[int, set[int]]:
    rng = random.Random(seed)
    base = [set(rng.sample(range(60), rng.randint(1, 25))) for _ in range(30)]
    found = list(base)
    for s in base:
        for _ in range(rng.randint(0, 4)):
            t = set(s)
            for _ in range(rng.randint(0, 3)):
                t ^= {rng.randrange(60)}
            found.append(t or {1})
    return dict(enumerate(found))


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_pairs_equal_all_pairs(spark, least):
    sets = some(int(least * 10))
    rows = [(k, e) for k, s in sets.items() for e in s]
    df = spark.createDataFrame(rows + rows[:50] + [(None, 1), (3, None)], SETS)
    want = {(a, b): (len(x & y), len(x), len(y)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= least}
    got = {(r.track, r.track2): (r.inter, r["size"], r.size2) for r in ev.similar_sets(df, least).collect()}
    assert got == want and len(want) > 5
    assert all(abs(r.iou - r.inter / (r["size"] + r.size2 - r.inter)) < 1e-12 for r in ev.similar_sets(df, least).collect())


def test_an_element_in_very_many_sets_brings_none_together(spark):
    from pyspark.sql import functions as F

    n = 100_000
    df = spark.range(n).select(F.col("id").alias("track"), F.explode(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"), *[F.col("id") * 4 + k for k in range(4)])).alias("atom"))
    near = spark.createDataFrame([(n + t, e) for t in (0, 1) for e in (-1, -2, -3, -4, -5 - t)], SETS)
    _, prefixes = ev._prefixes(df.union(near).select(F.col("track").alias("s"), F.col("atom").alias("e")), 0.6)
    assert ev._candidates(prefixes, 0.6).count() == 1
    assert [(r.track, r.track2, r.inter) for r in ev.similar_sets(df.union(near), 0.6).collect()] == [(n, n + 1, 4)]


def test_empty_sets(spark):
    assert ev.similar_sets(spark.createDataFrame([], SETS)).count() == 0
