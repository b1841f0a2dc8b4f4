"""Collocations against counting by hand, in chunks and parts of every size."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of

from terrazzo.llm import phrases, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    words = "new york city hall of the is in São Paulo état-major x \xa0nbsp a\x1fb".split(" ")
    rows = []
    for i in range(160):
        text = "".join(rng.choice(words[: rng.choice((4, 6, len(words)))]).upper() * (rng.random() < 0.1) + rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", ": ")) for _ in range(rng.randint(0, 60)))
        rows.append((i % 150, rng.choice((text, text, "New York City Hall, new york")), rng.choice(("en", "en", "pt", None, "und")), "s", 0))
    return rows + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, " . , ", "en", "s", 0), (902, "the the the the the the", "en", "s", 0), (903, "the of " * 4000, "en", "s", 0), (904, "new york city. " * 2000, "pt", "s", 0), (905, "z" * 30_000 + " of the", "zz", "s", 0)]


def plain(rows: list[tuple], least: int, top: int) -> list[tuple]:
    f: dict = collections.defaultdict(collections.Counter)
    n: collections.Counter = collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in known.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in known.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 700, "part_entries": 300}])
def test_collocations_equal_counting_by_hand(spark, sizes):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = phrases.collocations(docs, least=12, top=40, **sizes).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == plain(rows, 12, 40)


def test_a_count_beyond_64_bits_of_products_is_exact(spark):
    big = 2**62
    counts = spark.createDataFrame([("x", "a", 1, big + 1), ("x", "b", 1, big + 3), ("x", "a b", 2, big)], "lang string, phrase string, m int, f long")
    row = phrases.uncovered(phrases.scores(counts)).first()
    assert row.score == 2_000_000 * big // (2 * big + 4) and (row.l, row.r) == (big + 1, big + 3)


def test_ties_of_cuts_take_the_least_k_and_covered_phrases_go(spark):
    rows = [("a", 1, 20), ("b", 1, 20), ("c", 1, 20), ("a b", 2, 10), ("b c", 2, 10), ("a b c", 3, 8), ("b c d", 3, 7), ("d", 1, 9), ("c d", 2, 9)]
    counts = spark.createDataFrame([("x", p, m, f) for p, m, f in rows], "lang string, phrase string, m int, f long")
    scored = {r.phrase: (r.l, r.r, r.score) for r in phrases.scores(counts).collect()}
    assert scored["a b c"] == (20, 10, 2_000_000 * 8 // 30)
    assert {r.phrase for r in phrases.uncovered(phrases.scores(counts)).collect()} == {"a b c", "b c d", "c d"}


def gram(ids, i, m):
    return tuple(ids[i : i + m].tolist())


def test_words_are_numbered_and_read_again():
    lines = phrases.plain("One two. ONE\ttwo  é one, " + "w" * 3000 + " one")
    names, ids = phrases.numbered(lines)
    assert [names[i] for i in ids.tolist()] == b"one two \n one two \xc3\xa9 one \n".split(b" ") + [b"w" * 3000, b"one"] and len(set(names)) == len(names)
    docs = ["a b. c", "d " * 500, "", "e. " * 300]
    rows = list(phrases._chunks(200)([pa.RecordBatch.from_arrays([pa.array(["x"] * 4), pa.array(docs)], names=["lang", "text"])]))
    read = [phrases._read(r) for r in rows]
    again = [names[i] for _, _, names, ids in read for i in ids.tolist() if i]
    assert again == [w for t in docs for w in phrases.plain(t).replace(b"\n", b" ").split(b" ") if w] and sum(r["n"][0].as_py() for r in rows) == len(again) and len(rows) > 3


def test_matches_overlap_and_keep_to_whole_words():
    text = b" the the the \n the cat the \n cat \xc3\xa9 "
    assert phrases.matches([b"the the", b"the cat", b"cat the", b"cat \xc3\xa9", b"he cat", b"the the the"], text).tolist() == [2, 1, 1, 1, 0, 1]


def test_sketch_bounds_counts_from_above():
    rng = random.Random(1)
    names, ids = phrases.numbered(" ".join(rng.choice("abcdef\n") for _ in range(600)).encode())
    ids = ids.astype(np.int64)
    for m, at, codes in phrases._grams("en", names, ids, 3, 4):
        exact = collections.Counter(gram(ids, i, m) for i in range(len(ids) - m + 1))
        cells = collections.Counter(codes.tolist())
        assert all(cells[c] >= exact[gram(ids, i, m)] for i, c in zip(at.tolist(), codes.tolist()))
        assert set(at.tolist()) == {i for i in range(len(ids) - m + 1) if 0 not in gram(ids, i, m)}
    small = collections.Counter(np.concatenate([c for m, _, c in phrases._grams("en", names, ids, 3, 2)]).tolist())
    known = phrases.Cells(np.array([c for c, f in small.items() if f >= 10], np.uint64))
    for m, at, _ in phrases._grams("en", names, ids, 3, 4, known, 2):
        exact = collections.Counter(gram(ids, i, m) for i in range(len(ids) - m + 1))
        assert {gram(ids, i, m) for i in at.tolist()} >= {g for g, f in exact.items() if f >= 10 and 0 not in g}


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "s", 0), (2, "one", "en", "s", 0)], DOCS)).count() == 0


def test_sql_counts_as_the_operator_does(spark):
    import duckdb

    rows = [r for r in corpus(9) if r[1] is None or len(r[1]) < 20_000]
    own = duckdb.connect()
    docs = spark.createDataFrame(rows, DOCS)
    own.register("documents", docs.toPandas())
    assert rows_of(own.execute(queries.COLLOCATION_SQL).df()) == rows_of(phrases.collocations(docs, chunk_bytes=2000).toPandas())
