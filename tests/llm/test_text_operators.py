"""Language ID, near-dedup, substring dedup, decontamination, toxicity, token counts, packing."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from terrazzo.llm import bytededup, decontaminate, langid, neardup, packing, sketch, substring, tokencount, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ri", "sa", "te") for b in ("ton", "ver", "lad", "min", "sko", "pra", "ne", "fu")]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(("", "s", "ed", "ing")) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


def corpus(seed: int = 1) -> list[tuple]:
    """Prose with exact and near copies, shared passages, ties, nulls, empties, odd white space and one long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 160)) for _ in range(24)]
    near = []
    for t in base[:6]:
        for _ in range(5):
            w = t.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            near.append(" ".join(w))
    passage = prose(rng, 60)
    shared = [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(5)]
    odd = [None, "", "   \t\n ", "one", "one two", "One\x0btwo", "12 34 !!", base[0], base[0].upper(), "ab " * 400, passage + " " + passage, "é" * 150, prose(rng, 20_000)]
    return [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(base + near + shared + odd)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def linked(rows, width, percent):
    sets = {r[0]: sets_of(r[1], width) for r in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(docs, rows, width, percent):
    want, size = linked(rows, width, percent)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, width, percent).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == size
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_near_duplicates_over_blocks(spark, monkeypatch):
    """A cluster of many blocks gives the same as one block."""
    rng = random.Random(3)
    base = prose(rng, 120).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w), None, None, 0))
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 7)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()}
    assert got == linked(rows, 3, 85)[0]


@pytest.mark.parametrize("pivots", [0, 2])
def test_leftovers_of_clusters_are_compared(spark, monkeypatch, pivots):
    """Families around a few bases that share most of their words: blocks that pivots don't link up,
    and members that only a document of another block is near to."""
    rng = random.Random(4)
    base = prose(rng, 110).split()
    rows = []
    for family in range(4):
        own = list(base)
        for _ in range(5 * family):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        for _ in range(18):
            w = list(own)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w), None, None, 0))
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 5)
    monkeypatch.setattr(neardup, "PAIR_DOCS", 7)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    for width, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), width, percent).collect()}
        want = linked(rows, width, percent)[0]
        assert got == want and 1 < len(set(want.values())) < len(rows)


def test_near_duplicates_of_odd_tables(spark, none):
    assert neardup.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", None, None, 0)] * 2 + [(None, "a b c d e f", None, None, 0), (None, None, None, None, 0)], DOCS)
    got = sorted(map(tuple, neardup.near_duplicates(twice).collect()), key=str)
    assert got == sorted([(1, 2, 1, True)] * 2 + [(None, 2, None, True), (None, 0, None, True)], key=str)


def test_pipeline_form_keeps_one_row_of_each_group(spark):
    text = prose(random.Random(2), 40)
    rows = [(4, text, "a", "s", 1), (4, text, "a", "s", 1), (4, text, "b", "s", 2), (2, text + " end", "a", "s", 1), (9, "", "a", "s", 0), (9, "", "a", "s", 0), (None, text, "a", "s", 1), (None, text, "a", "s", 1), (7, None, None, None, None)]
    kept = neardup.keep_first(spark.createDataFrame(rows, DOCS).repartition(3))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[3], rows[4], rows[6], rows[7], rows[8]], key=str)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for shared in (0, 400, 800, 1000):
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        s = sketch.sketch([np.unique(a), np.unique(b), np.unique(np.concatenate([a, b]))], 1024)
        assert np.array_equal(np.maximum(s[0], s[1]), s[2])
        true = shared / (2000 - shared)
        found = sketch.joint_estimate([1000], [1000], [(s[0] > s[1]).sum()], [(s[0] < s[1]).sum()], 1024)[0]
        assert found == pytest.approx(true, abs=0.06)


def covered(rows):
    """(kept bytes, spans) of every document by the definition."""
    seen, out = set(), {}
    for key, text in sorted((r[0], r[1]) for r in rows):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[key] = (len(b), len(b) - len(left), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0, hashlib.sha256(left).hexdigest())
    return out


def test_byte_dedup_by_definition(docs, rows):
    got = {r["doc_id"]: tuple(r)[1:5] for r in bytededup.remove_repeated_bytes(docs).collect()}
    assert got == covered(rows)


@pytest.mark.parametrize("most", [1, 3])
def test_byte_dedup_of_hot_grams(docs, rows, most):
    """Grams with many contexts are hashed string by string, with the same result."""
    got = {r["doc_id"]: tuple(r)[1:5] for r in bytededup.remove_repeated_bytes(docs, hot_contexts=most).collect()}
    assert got == covered(rows)


def test_byte_dedup_over_chunks_and_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(bytededup, "CHUNK_BYTES", 700)
    monkeypatch.setattr(bytededup, "BLOCK_BYTES", 500)
    place, first, last, gram, whole = bytededup.anchors(np.frombuffer(b"abc" * 200, np.uint8), np.array([600]))
    assert (last >= first).all() and first[0] == 0 and last[-1] == 500
    parts = list(bytededup._chunks(b"x" * 2000))
    assert {s + k for s, b in parts for k in range(len(b) - 99)} == set(range(1901))
    texts = [b"q" * 150, b"q" * 120 + b"z" * 30]
    doc, start = bytededup.repeated_starts(texts, np.array([3, 5]), np.array([0, 10]))
    assert set(zip(doc.tolist(), start.tolist())) == {(3, s) for s in range(1, 51)} | {(5, s) for s in range(10, 31)}


def test_byte_dedup_of_odd_tables(spark, none):
    assert bytededup.remove_repeated_bytes(none).count() == 0
    text = "x y" * 60
    twice = spark.createDataFrame([(4, text, None, None, 0)] * 2 + [(None, text, None, None, 0), (2, None, None, None, 0)], DOCS)
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in bytededup.remove_repeated_bytes(twice, keep_text=True).collect()}
    alone = covered([(4, text)])[4][1]
    assert got == {(4, 180, alone), (None, 180, 180), (2, 0, 0)}


def test_byte_dedup_tells_contexts_of_near_hashes_apart(spark):
    """Two contexts of one gram whose hashes agree in 32 bits, and no string of 100 bytes that repeats."""
    part = lambda s, n: hashlib.sha256(s.encode()).hexdigest()[:n]
    rows = [(i, part(f"a{i}", 60) + part("g775", 40) + part(f"b{i}", 60), None, None, 160) for i in (18986, 42903)]
    hashes = [bytededup.anchors(np.frombuffer(r[1].encode(), np.uint8), np.array([160]))[4] for r in rows]
    assert hashes[0] != hashes[1] and hashes[0].astype("<u4") == hashes[1].astype("<u4")
    found = bytededup.remove_repeated_bytes(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in found} == covered(rows)


@pytest.mark.parametrize("most", [1, 4096])
def test_byte_dedup_of_ids_with_several_texts(spark, most):
    """Rows of a null id, or of one id, that differ in their texts are documents of their own."""
    rng = random.Random(11)
    shared = [prose(rng, 40) for _ in range(3)]
    texts = [shared[0] + prose(rng, 90), shared[0] + prose(rng, 20) + shared[1], prose(rng, 15), prose(rng, 70) + shared[2] + shared[1], shared[2] + prose(rng, 60)]
    rows = [(1, texts[0]), (7, texts[3]), (7, texts[4]), *((None, t) for t in texts[1:4])]
    table = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)
    hashes = dict(map(tuple, table.selectExpr("text", "xxhash64(text)").distinct().collect()))
    key = lambda k, t: (2**63 - 1 if k is None else k, hashes[t])
    want = covered([(key(k, t), t) for k, t in rows])
    found = bytededup.remove_repeated_bytes(table.repartition(3), hot_contexts=most).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(((k, *want[key(k, t)]) for k, t in rows), key=str)


def test_substring_removal_keeps_the_first(spark, docs, rows):
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    first, want = {}, {}
    spans_of = {}
    for key, text in sorted((r[0], r[1]) for r in rows):
        parts = substring.pieces(text or "")
        words = [p.lower().split() for p in parts]
        spans_of[key] = parts, [(a, b, tuple(map(tuple, words[a:b]))) for a, b in substring.spans(words)]
        for a, b, h in spans_of[key][1]:
            first.setdefault(h, (key, a))
    for key, (parts, spans) in spans_of.items():
        drop = {i for a, b, h in spans if first[h] != (key, a) for i in range(a, b)}
        want[key] = "".join(p for i, p in enumerate(parts) if i not in drop)
    assert {k: r["text"] or "" for k, r in got.items()} == want
    assert sum(r["n_removed"] for r in got.values())


def test_substring_removal_of_odd_tables(spark, none):
    assert substring.remove_repeats(none).count() == 0
    text = prose(random.Random(4), 40)
    rows = [(5, text)] * 2 + [(5, "x " + text), (None, text), (None, None), (7, "")]
    got = sorted(map(tuple, substring.remove_repeats(spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)).select("doc_id", "text", "n_removed").collect()), key=str)
    gone = len(substring.pieces(text))
    hashes = [r[0] for r in spark.createDataFrame([(text,), ("x " + text,)], "text string").selectExpr("xxhash64(text)").collect()]
    if hashes[0] < hashes[1]:  # of one id, the text of the smaller hash is first
        fives = [(5, text, 0)] * 2 + [(5, "x " + text[: len(substring.pieces(text)[0])], gone - 1)]
    else:
        fives = [(5, substring.pieces(text)[0], gone - 1)] * 2 + [(5, "x " + text, 0)]
    assert got == sorted([*fives, (None, "", gone), (None, None, 0), (7, "", 0)], key=str)


def test_passages_of_whole_sentences_are_whole_spans():
    rng = random.Random(5)
    for _ in range(200):
        sentences = [[str(rng.random())] * rng.randint(1, 70) for _ in range(rng.randint(1, 8))]
        if sum(map(len, sentences)) >= 50 and (len(sentences) < 3 or all(len(s) >= 6 for s in sentences)):
            assert {i for a, b in substring.spans(sentences) for i in range(a, b)} == set(range(len(sentences)))


def test_passages_with_ragged_ends_lose_their_whole_units(spark):
    """A passage of over 50 words that begins and ends within units, with some whole ones inside,
    which are sentences, or clauses of one sentence that is never whole."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n))
    for inner, stop in (([24], ". "), ([13, 16], ". "), ([9, 6, 8], ". "), ([7, 5, 11], ", "), ([4, 8, 9, 12], "; "), ([21], ": ")):
        units = [words(n) + stop for n in inner]
        passage = words(15) + stop + "".join(units) + words(16)
        rows = [(i, f"{words(8)} {passage} {words(7)}.", None, None, 0) for i in (1, 2)]
        got = {r["doc_id"]: r["text"] for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == {1: rows[0][1], 2: rows[1][1].replace("".join(units), "")}


def test_spans_make_up_every_run_of_enough_words():
    rng = random.Random(7)
    most = substring.MIN_WORDS
    for _ in range(300):
        words = [["w"] * rng.choice((0, 1, 3, 6, 11, most - 1, most, 30)) for _ in range(rng.randint(0, 9))]
        found = substring.spans(words)
        assert len(found) <= 2 * len(words) and all(sum(map(len, words[a:b])) >= most for a, b in found)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if sum(map(len, words[a:b])) >= most:
                    inside = {i for c, d in found if a <= c and d <= b for i in range(c, d)}
                    assert {i for i in range(a, b) if words[i]} <= inside


def without_repeats(rows):
    """(text left, units, units removed) of every (id, text) by the definition."""
    first, spans_of, out = {}, {}, {}
    for key, text in sorted(set(rows)):
        parts = substring.pieces(text or "")
        words = [substring.words_of(p) for p in parts]
        spans_of[key, text] = parts, [(a, b, tuple(map(tuple, words[a:b]))) for a, b in substring.spans(words)]
        for a, b, h in spans_of[key, text][1]:
            first.setdefault(h, (key, text, a))
    for (key, text), (parts, spans) in spans_of.items():
        drop = {i for a, b, h in spans if first[h] != (key, text, a) for i in range(a, b)}
        out[key, text] = "".join(p for i, p in enumerate(parts) if i not in drop) if drop else text, len(parts), len(drop)
    return out


@pytest.mark.parametrize("chunk", [1, 50, 10**6])
def test_chunks_of_spans_do_not_matter(spark, docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK_SPANS", chunk)
    want = without_repeats([(r[0], r[1] or "") for r in rows])
    got = {(r["doc_id"], rows[r["doc_id"]][1] or ""): (r["text"] or "", r["n_units"], r["n_removed"]) for r in substring.remove_repeats(docs).collect()}
    assert got == want and sum(n for _, _, n in want.values())


def test_pipeline_form_of_substring_removal(spark):
    """Texts and sizes by the definition; repeated rows, null ids and other columns, clashing names too."""
    rng = random.Random(12)
    shared = [prose(rng, 30) for _ in range(3)]
    texts = [prose(rng, 12) + " " + x + " " + prose(rng, 9) for x in shared for _ in range(4)] + [None, ""]
    rows = [(i, t, "xx", None if t is None else len(t), i * 7, f"g{i}") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[1] + " " + shared[2], None, 5, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, th long, gone string")
    want = without_repeats([(2**63 - 1 if r[0] is None else r[0], r[1] or "") for r in rows])
    expected = []
    for key, text, lang, size, th, gone in rows:
        left, _, cut = want[2**63 - 1 if key is None else key, text or ""]
        expected.append((key, left if cut else text, lang, len(left) if cut else size, th, gone))
    found = substring.strip_repeats(table.repartition(3))
    assert found.columns == table.columns and found.dtypes == table.dtypes
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert sum(r[1] != e[1] for r, e in zip(rows, expected)) > 5


@pytest.mark.parametrize(("letters", "stop", "length"), [("天地玄黃宇宙洪荒日月盈昃辰宿列張", "。", 18), ("あいうえおかきくけこさしすせそ", "！", 20), ("กขคงจฉชซญดตถทธนบ", "\n", 60), ("क ख ग घ च छ ज झ ट ठ ड ढ ", "।", 72), ("ا ب ت ث ج ح خ د ذ ر ", "۔", 72)])
def test_passages_in_other_scripts_are_found(spark, letters, stop, length):
    """Two sentences of a script without white space, or with stops of its own, repeat amid others."""
    rng = random.Random(8)
    sentence = lambda: "".join(rng.choice(letters) + rng.choice(letters) for _ in range(length // 2)).strip() + stop
    shared = sentence() + sentence()
    rows = [(i, sentence() + shared + sentence(), None, None, 0) for i in (1, 2)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (rows[0][1], 0), 2: (rows[1][1].replace(shared, ""), 2)}


def test_pieces_are_the_text():
    for text in ("", "a", "a. b\n\nc!? d", "\n\n x", "。一。二", "a.b c"):
        assert "".join(substring.pieces(text)) == text


ITEMS = "item_id long, text string"


def contained(rows, items):
    import regex

    words = lambda t: regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).split()
    out = set()
    for key, text in items:
        w = words(text)
        n = min(5, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for r in rows:
            d = words(r[1])
            held = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)}
            if grams and len(grams & held) * 100 >= 80 * len(grams):
                out.add((r[0], key, len(grams), len(grams & held)))
    return out


def test_contamination_equals_all_pairs(spark, docs, rows):
    long = rows[-1][1].split()
    items = [(0, " ".join(long[700:740])), (1, " ".join(long[9000:9030] + ["zz"] * 4)), (2, "One two"), (3, None), (4, "!!"), (5, prose(random.Random(9), 30)), (6, rows[0][1]), (7, "ONE"), (8, " ".join(long[50:60] + ["q"] * 30))]
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, ITEMS))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found.collect()} == contained(rows, items)


def test_contamination_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(0, rows[3][1]), (1, "one two")]
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, ITEMS))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found.collect()} == contained(rows, items)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_sketches_can_not_miss(spark):
    items = spark.createDataFrame([(i, prose(random.Random(i), 6 + i)) for i in range(60)], ITEMS)
    grams = decontaminate.item_shingles(items)
    size = {r["item_id"]: r["n"] for r in grams.groupBy("item_id").agg({"h": "count"}).withColumnRenamed("count(h)", "n").collect()}
    kept = {r["item_id"]: r["n"] for r in decontaminate.sketches(grams).groupBy("item_id").agg({"h": "count"}).withColumnRenamed("count(h)", "n").collect()}
    for k, n in size.items():
        assert kept[k] >= min(n, n - -(-n * 80 // 100) + 1)


def test_contamination_of_odd_tables(spark, docs, none):
    items = spark.createDataFrame([(0, "a b")], ITEMS)
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_language_of_held_out_texts(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    found = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(found.doc_id, found.held_out))


def language_scores(rows):
    """(language, score) of every text by the definition, learned from the labelled rows."""
    import math

    import regex

    split = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    learned = [(split(t), lang) for key, t, lang in rows if key is not None and lang is not None and t is not None and zlib.crc32(str(key).encode()) % 5]
    langs = sorted({lang for _, lang in learned})
    counts = {(lang, n): collections.Counter() for lang in langs for n in range(6)}
    for words, lang in learned:
        for w in words:
            counts[lang, 0][w] += 1
            for n in range(1, 6):
                counts[lang, n].update(grams(w, n))

    def unit(u, n):
        return [math.log10(counts[k, n][u] / sum(counts[k, n].values())) if counts[k, n][u] else -7.0 for k in langs] if any(counts[k, n][u] for k in langs) else None

    def word(w):
        if known := unit(w, 0):
            return known
        for n in range(5, 0, -1):
            if found := [x for g in grams(w, n) if (x := unit(g, n))]:
                return [sum(x) / len(found) for x in zip(*found)]
        return [-7.0] * len(langs)

    out = []
    for _, text, _ in rows:
        scored = [word(w) for w in split(text)]
        if not scored or not langs:
            out.append(("und", 0.0))
            continue
        mean = [sum(x) / len(scored) for x in zip(*scored)]
        best = max(range(len(langs)), key=lambda k: (mean[k], -k))
        out.append((langs[best], 1 / sum(10 ** ((m - mean[best]) * min(len(scored), 20)) for m in mean)))
    return out


def test_language_equals_brute_force(spark):
    rng = random.Random(13)
    stems = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ka", "re", "so", "nü"], "cc": ["ve", "re", "dé", "tu"]}
    say = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(k, rng.randint(3, 40)), k) for i, k in enumerate(rng.choices(sorted(stems), k=60))]
    rows += [(100 + i, say(rng.choice(sorted(stems)), 12) + " xqz zz KA", None) for i in range(20)]
    rows += [(None, say("aa", 9), "bb"), (200, None, "aa"), (201, "", "bb"), (202, "12 !", None), (203, "ЖШ", None), rows[3]]
    found = langid.identify(spark.createDataFrame([(k, t, lang, None, 0) for k, t, lang in rows], DOCS)).collect()
    want = collections.defaultdict(list)
    for (key, _, _), x in zip(rows, language_scores(rows)):
        want[key].append(x)
    got = collections.defaultdict(list)
    for r in found:
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    for key in want:
        assert [k for k, _ in sorted(want[key])] == [k for k, _ in sorted(got[key])]
        assert [x for _, x in sorted(want[key])] == pytest.approx([x for _, x in sorted(got[key])], abs=1e-4)


def test_units_kept_for_one_language_count_in_all(spark):
    """With room for few units, a word that one language keeps is still known to occur in the other."""
    rows = [(i, " ".join(["both"] * (50 if k == "aa" else 3) + [f"{k}w{j}" for j in range(40) for _ in range(4)]), k, None, 0) for i, k in enumerate(("aa", "bb") * 6)]
    model = langid.train(spark.createDataFrame(rows, DOCS), model_units=1200)
    share = {k: 10.0 ** float(x) for k, x in zip(model["langs"], model["rows"][model["words"]["both"]])}
    assert share == pytest.approx({"aa": 50 / 210, "bb": 3 / 163}, rel=1e-3)


def test_language_backs_off_and_rejects(spark, docs, none):
    rows = [(i, t, k, "s", 0) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 40)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    scorer = langid.Scorer(model)
    assert scorer.scores(["the", "chatte", None, "", "12 ½ !", "chiens"])[0] == ["en", "fr", "und", "und", "und", "fr"]
    empty = langid.train(none)
    assert langid.Scorer(empty).scores(["the"]) == (["und"], [0.0])
    assert langid.identify(none).count() == 0
    kept = langid.reject_unknown(spark.createDataFrame(rows + [(999, "?", None, None, 0), (None, "the", "en", None, 0)], DOCS))
    assert kept.count() == len(rows) + 1 and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_texts_of_no_learned_language_are_rejected(spark):
    rows = [(i, t, k, "s", 0) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 40)]
    junk = [(900, "кошка и собака", None, None, 0), (901, "αβγ", None, None, 0), (902, "the", None, None, 0)]
    kept = langid.reject_unknown(spark.createDataFrame(rows + junk, DOCS)).collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows} | {902}


def test_least_score_is_that_of_all_labelled_rows(spark):
    """Each row of the corpus counts, not only as many as were learned from."""
    texts = {"en": ["the cat and the dog"] * 60 + ["the cat le chat the dog"], "fr": ["le chat et le chien"] * 60}
    docs = spark.createDataFrame([(i, t, k, "s", 0) for i, (t, k) in enumerate((t, k) for k, ts in texts.items() for t in ts)], DOCS)
    model = langid.train(docs)
    model["share"] = {k: 0.0 for k in model["share"]}
    found, scores = langid.Scorer(model).scores([r.text for r in docs.collect()])
    least = min(s for f, s, r in zip(found, scores, docs.collect()) if f == r.lang)
    assert langid.least_score(docs, spark.sparkContext.broadcast(model)) == pytest.approx((0.5 + max(0.5, least)) / 2)


def test_toxic_words_are_learned(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 7 == 0
        text = prose(rng, 60) + (" you scum and moron" if bad else "")
        rows.append((i, text, "en", "s", 0))
        if i % 3:
            labels.append((i, 1, int(bad)))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0)]
    labels = spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert [k for k, r in found.items() if r["predicted"] != int(k < 900 and k % 7 == 0)] == []
    assert found[900]["score"] == found[901]["score"]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items())
    none = toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels.limit(0))
    assert {r["predicted"] for r in none.collect()} == {0}
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), labels).count() == 0


def test_toxicity_equals_brute_force(spark):
    """The scores of a table against a dense version: words by their test, the risk's slope, Adam."""
    rng = random.Random(21)
    rows = [(i, prose(rng, 25) + (" rotten swine" if i % 6 == 0 else " fine " if i % 5 == 0 else ""), None, None, 0) for i in range(240)]
    toxic = {i: int(i % 6 == 0) for i in range(240) if i % 2 == 0}
    labels = spark.createDataFrame([(k, 1, v) for k, v in toxic.items()], "doc_id long, quality int, toxic int")
    learn = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    words = [set(r[1].lower().replace(".", "").split()) for r in rows]
    p = [i for i in toxic if learn(i) and toxic[i]]
    u = [i for i in range(240) if learn(i)]
    prior = len(p) / sum(map(learn, toxic))
    chosen = []
    for w in sorted(set().union(*words)):
        a, b = sum(w in words[i] for i in p), sum(w in words[i] for i in u)
        pooled = (a + b) / (len(p) + len(u))
        if a + b >= 4 and abs(a / len(p) - b / len(u)) / np.sqrt(pooled * (1 - pooled + 1e-9) * (1 / len(p) + 1 / len(u))) > toxicity.MIN_Z:
            chosen.append(w)
    assert {"rotten", "swine"} <= set(chosen)
    dense = lambda some: np.array([[w in words[i] for w in chosen] for i in some], float)
    xp, xu, weight, bias = dense(p), dense(u), np.zeros(len(chosen)), np.log(prior / (1 - prior))
    mean, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, 1001):
        zp, zu = xp @ weight + bias, xu @ weight + bias
        gain = lambda x, slope: np.append(x.T @ slope, slope.sum())
        negative = gain(xu, sigmoid(zu) / len(u)) - gain(xp, prior * sigmoid(zp) / len(p))
        below = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean() < 0
        slope = -negative if below else gain(xp, prior * (sigmoid(zp) - 1) / len(p)) + negative
        slope[:-1] += 2e-5 * weight
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        step = 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
        weight, bias = weight - step[:-1], bias - step[-1]
    want = sigmoid(dense(range(240)) @ weight + bias)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert [got[i] for i in range(240)] == pytest.approx(want.tolist(), abs=1e-5)


def test_non_negative_risk_learns_from_unlabelled():
    rng = np.random.default_rng(0)
    p = [np.array([0, 2 + rng.integers(20)]) for _ in range(200)]
    u = [np.array([0 if rng.uniform() < 0.2 else 1, 2 + rng.integers(20)]) for _ in range(800)]
    w, b = toxicity.fit_nnpu(p, u, 22, 0.2)
    score = lambda i: 1 / (1 + np.exp(-(w[i] + b)))
    assert score(0) > 0.9 and score(1) < 0.1


def test_token_counts_are_greedy(docs, rows):
    import public_tokenizers
    import regex

    vocabulary = set(tokencount.byte_vocabulary())
    longest = max(map(len, vocabulary))

    def greedy(w):
        n = i = 0
        while i < len(w):
            i += next(k for k in range(min(longest, len(w) - i), 0, -1) if w[i : i + k] in vocabulary)
            n += 1
        return n

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(docs).collect()}
    for r in rows:
        w = regex.findall(public_tokenizers.PATTERN, r[1] or "")
        assert got[r[0]] == (len(w), sum(greedy(x.encode()) for x in w))


def test_piece_counter_on_a_small_vocabulary():
    counter = tokencount.PieceCounter([b"a", b"b", b"c", b"ab", b"abcab", b"bca"])
    assert [counter.count(w) for w in (b"", b"abcab", b"abca", b"ababc", b"bcab")] == [0, 1, 3, 3, 2]


def test_packing_holds_every_token_once(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = [(len(rows) + i, x) for i, x in enumerate(("a <|endoftext|> b " * 900, "<|endoftext|>", "x<|endoftext|><|endofText|> é"))]
    want = {k: t.encode(text or "", add_special_tokens=False).ids + [1] for k, text in [*(r[:2] for r in rows), *added]}
    found = packing.pack_documents(docs.union(docs.sparkSession.createDataFrame([(k, x, None, None, 0) for k, x in added], DOCS)), with_ids=True).collect()
    pieces, bins = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in found:
        pieces[r["doc_id"]][r["start"]] = r["ids"]
        bins[r["sequence_id"]][r["offset"]] = r["length"]
        assert r["length"] == len(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert {k: [x for s in sorted(p) for x in p[s]] for k, p in pieces.items()} == want
    for b in bins.values():
        end = 0
        for offset in sorted(b):
            assert offset == end
            end += b[offset]
        assert end <= 2048
    total = sum(map(len, want.values()))
    assert sum(2048 - s for b in bins.values() if (s := sum(b.values())) & (s - 1)) <= 0.02 * total


def test_added_tokens_are_those_of_the_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.byte_bpe_encoder()
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n x", "a<|endoftext|", "é <|endoftext|>é", "", "<|endofText|>"):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids
    assert 50256 in encode("x<|endoftext|>")


def test_first_fit_decreasing_by_tree():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    tree, bins, want = packing.CapacityTree(len(sizes), 100), [], []
    for s in sizes:
        at = next((i for i, free in enumerate(bins) if free >= s), len(bins))
        if at == len(bins):
            bins.append(100)
        bins[at] -= s
        want.append(at)
    assert [tree.first_fit(s) for s in sizes] == want


def test_packing_of_odd_tables(spark, none):
    assert packing.pack_documents(none).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(None, None, None, None, 0)] * 2 + [(7, "<|endoftext|>", None, None, 0)], DOCS)).collect()
    assert sorted(r["doc_tokens"] for r in rows)[:2] == [1, 1] and len(rows) >= 3


def test_splitting_tokens_in_a_group(monkeypatch):
    lengths = [5000, 1, 2047, 2048, 0, 900, 900, 900]
    seen = collections.Counter()
    for pieces in packing.pack_lengths(lengths):
        used = sum(p[2] for p in pieces)
        assert used <= 2048
        for doc, start, n in pieces:
            for x in range(start, start + n):
                seen[doc, x] += 1
    assert seen == {(d, x): 1 for d, n in enumerate(lengths) for x in range(n)}
