"""Spelling variants against edit distances by hand."""

from __future__ import annotations

import collections
import random
import re
import zlib

from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from terrazzo.llm import queries, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabcdéÿ×") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = list(base)
    for w in base:
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :])))
    weights = [rng.choice((1, 3, 20, 120)) for _ in words]
    rows = []
    for i in range(250):
        picked = rng.choices(words, weights, k=rng.randint(0, 50))
        rows.append((i % 240, "".join((w.upper() if rng.random() < 0.1 else w) + rng.choice((" ", "-", "2", "ł", "\n", "_")) for w in picked), "xx", "s", 0))
    return rows + [(700, None, "xx", "s", 0), (701, "", "xx", "s", 0), (None, "abacada " * 6, "xx", "s", 0), (702, "y" * 5000 + " " + "Y" * 5000, "xx", "s", 0), (703, ("z" * 3000 + " ") * 7 + ("z" * 3001 + " ") * 40, "xx", "s", 0), (704, "chainaa " * 6 + "chainab " * 40 + "chainabc " * 250, "xx", "s", 0)]


def counts_of(rows) -> dict[str, int]:
    total: collections.Counter = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows) -> list[tuple]:
    n = counts_of(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def test_variants_equal_edit_distances_by_hand(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 10 and any(r[2] not in (r[0], r[1]) for r in want)
    for sizes in ({}, {"shard_letters": 300, "round_bytes": 3000}):
        found = spelling.variants(docs, **sizes).select("word", "form", "root", "n", "n_near", "form_n")
        assert sorted(map(tuple, found.collect()), key=str) == want


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=40), st.text("abcd", min_size=1, max_size=7))
def test_trie_accepts_words_one_edit_away(words, q):
    ordered = sorted(words)
    trie = spelling.Trie([w.encode() for w in ordered], range(len(ordered)))
    assert {ordered[i] for i in trie.near(q.encode())} == {w for w in words if one_edit(w, q)}
    assert all(trie.spelled(i).decode() == w for i, w in enumerate(ordered))


def test_chains_end_at_their_last_form(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(37)] + [("a", "b")]
    ends = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert ends == {w: ("b" if w == "a" else "w037") for w, _ in chain}


def test_held_words_are_passed_on(monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    rows = [(str(i), f"wordaa{c} wordbb{c} wordcc{c}") for i, c in enumerate("abcab")]
    sums: collections.Counter = collections.Counter()
    parts = list(spelling.counted(rows))
    for part in parts:
        sums.update(part)
    monkeypatch.setattr(spelling, "HELD_WORDS", 10**6)
    (whole,) = spelling.counted(rows)
    assert len(parts) > 1 and sums == whole


def test_empty_tables(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "x", "s", 0), (2, "short", "x", "s", 0)], DOCS)).count() == 0


def test_sql_gives_what_the_operator_does(spark):
    import duckdb

    rows = [r for r in corpus(8) if r[0] is not None and len(r[1] or "") < 3000]
    docs = spark.createDataFrame(rows, DOCS)
    own = duckdb.connect()
    own.register("documents", docs.toPandas())
    assert rows_of(own.execute(queries.SPELLING_SQL).df()) == rows_of(spelling.variants(docs).toPandas())
