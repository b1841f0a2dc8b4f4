"""Collocations: phrases of two to four words that occur together more than their parts explain.

Texts are gathered in chunks of one language, as numbers of their words. A sketch bounds the counts
of phrases from above: each chunk adds up its phrases by a hash, and the sums of all chunks meet by
cell. Only cells that reach the least count go on, each back to the chunks that met it, so that no
task and no driver holds more of the sketch than its own part. One and two words are counted first;
three and four words only where their pairs stay.

What a chunk holds of phrases in such cells are its candidates. They compile into an Aho-Corasick
automaton, each guarded by a blank at either end, so that only whole words match; pieces of a text
are set apart by a line end that no phrase holds. A scan of the chunk counts all matches, also those
that overlap; it skips stretches in which no pair stays. The counts are added up over the chunks and
only then held against the least count: a phrase that reaches it is a candidate wherever it occurs, so
its count is exact, while hashes that collide only make candidates that the sums then drop.

Defined cases: a null or empty text has no words, a null language is `und`. Repeated rows count as
often as they occur, ids don't matter. A text longer than a chunk is cut between its pieces; one piece
is never cut. A language without a phrase of the least count has no rows, as has an empty table.
"""

from __future__ import annotations

import os
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.llm.common import materialise, mix64, n_partitions, small_batches

LEAST = 30
MOST_WORDS = 4
TOP = 2000
#: A candidate goes if a longer phrase around it has this share of its occurrences, in hundredths.
COVERED = 80
SCALE = 2_000_000
CHUNK_BYTES = 8_000_000
#: Entries of the sketch that one task adds up at a time.
PART_ENTRIES = 2_000_000
#: Numbers of words that are counted together; the later ones only where the earlier ones stay.
LEVELS = ((1, 2), (3, 4))

# What ends a piece, and the blanks between words.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes.maketrans(_ENDS + _BLANKS, b"\n" * len(_ENDS) + b" " * len(_BLANKS))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def plain(text: str) -> bytes:
    """A text in lower case (A-Z alone) with a line end for each end of a piece, and blanks."""
    return text.encode().lower().translate(_PLAIN)


def numbered(lines: bytes) -> tuple[list[bytes], np.ndarray]:
    """The different words of plain text and the number of each word in turn; 0 is a line end."""
    words = list(filter(None, lines.replace(b"\n", b" \n ").split(b" ")))
    number = {b"\n": 0}
    for word in dict.fromkeys(words):
        number.setdefault(word, len(number))
    return list(number), np.fromiter(map(number.__getitem__, words), np.uint32, len(words))


def _cut(lines: bytes, most: int):
    """Parts of about `most` bytes that end with a piece."""
    while len(lines) > most:
        at = lines.rfind(b"\n", 0, most) + 1 or lines.find(b"\n", most) + 1 or len(lines)
        yield lines[:at]
        lines = lines[at:]
    yield lines


#: A chunk: a number of its own, its language, its words, and (compressed) the different words and their numbers.
CHUNK = {"chunk": pa.int64(), "lang": pa.string(), "n": pa.int64(), "names": pa.binary(), "ids": pa.binary()}


def _chunks(chunk_bytes: int):
    def gather(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def row(lang: str):
            names, ids = numbered(b"\n".join(held.pop(lang)))
            del size[lang]
            # bytes of equal weight lie together
            values = [int.from_bytes(os.urandom(8), "little", signed=True), lang, int(np.count_nonzero(ids)), pack(b" ".join(names)), pack(ids.view(np.uint8).reshape(-1, 4).T.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, CHUNK.values())], names=list(CHUNK))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in _cut(plain(text), chunk_bytes):
                    if lang in held and size[lang] + len(part) > chunk_bytes:
                        yield row(lang)
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part) + 1
                    if sum(size.values()) > 3 * chunk_bytes:
                        yield row(max(size, key=size.get))
        for lang in list(held):
            yield row(lang)

    return gather


def _read(table) -> tuple[int, str, list[bytes], np.ndarray]:
    """Number, language, different words and words of a chunk."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids = np.frombuffer(unpack(table["ids"][0].as_py()), np.uint8).reshape(4, -1).T
    return table["chunk"][0].as_py(), table["lang"][0].as_py(), unpack(table["names"][0].as_py()).split(b" "), np.ascontiguousarray(ids).view(np.uint32).ravel().astype(np.int64)


class Cells:
    """A set of codes of cells, with a table of bits before the search."""

    BITS = 22

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self._place(codes)] = True

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return (codes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def hold(self, codes: np.ndarray) -> np.ndarray:
        stays = self.seen[self._place(codes)]
        some = codes[stays]
        place = np.searchsorted(self.codes, some)
        stays[stays] = self.codes[np.minimum(place, len(self.codes) - 1)] == some
        return stays


def _code(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of the sketch (upper half) and cell in it (lower half)."""
    return (hashes >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _grams(lang: str, names: list[bytes], ids: np.ndarray, parts: int, most: int, known: Cells | None = None, counted: int = 0):
    """(number of words, first words, codes) of the phrases up to `most` words that may reach the least count.

    known: the cells that do, for phrases of up to `counted` words.
    """
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[ids]
    alive = ids != 0
    held = np.full(len(ids), np.uint64(xxhash.xxh3_64_intdigest(lang)))
    for m in range(1, most + 1):
        at = np.flatnonzero(alive)
        held[at] = mix64(held[at] * _STEP + words[at + m - 1])
        codes = _code(held[at], parts)
        if m <= counted:
            stays = known.hold(codes)
            at, codes = at[stays], codes[stays]
        yield m, at, codes
        alive = np.zeros(len(ids), bool)
        alive[at] = True
        alive[:-1] &= alive[1:]
        alive[-1:] = False


def _known(table) -> Cells:
    """Codes of a chunk's rows (part, cells)."""
    codes = [np.uint64(part << 32) | np.frombuffer(cells, np.uint32).astype(np.uint64) for part, cells in zip(table["part"].to_pylist(), table["cells"].to_pylist())]
    return Cells(np.concatenate([*codes, np.array([2**64 - 1], np.uint64)]))


def _dealt(codes: np.ndarray, parts: int):
    """(part, first, after last) of sorted codes."""
    edges = np.searchsorted(codes >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64)).tolist()
    return [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def _cells(table, parts: int, level: tuple[int, ...], known: Cells | None, counted: int):
    """Rows of ENTRIES: how often a chunk meets each cell of a part of the sketch."""
    chunk, lang, names, ids = _read(table)
    codes = np.concatenate([c for m, _, c in _grams(lang, names, ids, parts, max(level), known, counted) if m in level])
    codes, counts = np.unique(codes, return_counts=True)
    cells, counts = codes.astype(np.uint32), counts.astype(np.uint32)
    rows = [(p, chunk, cells[a:b].tobytes(), counts[a:b].tobytes()) for p, a, b in _dealt(codes, parts)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "chunk", "cells", "counts"])


def _next_cells(parts: int, level: tuple[int, ...]):
    return lambda table, known: _cells(table, parts, level, _known(known), min(level) - 1)


ENTRIES = "part int, chunk long, cells binary, counts binary"


def _reaching(least: int):
    """Of one part of the sketch, for each chunk, the cells whose sum over all chunks reaches `least`."""

    def add(table):
        sizes = [len(c) // 4 for c in table["cells"].to_pylist()]
        cells = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
        order = np.argsort(cells, kind="stable")
        ranked = cells[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        stays = np.empty(len(cells), bool)
        stays[order] = (sums >= least)[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        lists = [cells[e - n : e][stays[e - n : e]].tobytes() for n, e in zip(sizes, ends.tolist())]
        some = [i for i, x in enumerate(lists) if x]
        return pa.table([table["chunk"].take(pa.array(some, pa.int64())), table["part"].take(pa.array(some, pa.int64())), pa.array([lists[i] for i in some], pa.binary())], names=["chunk", "part", "cells"])

    return add


def matches(phrases: list[bytes], text: bytes) -> np.ndarray:
    """How often each phrase occurs in a text of words with one blank before, between and after them."""
    import ahocorasick

    if not phrases:
        return np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase.decode('latin-1')} ", i)  # a character a byte
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text.decode("latin-1"))), np.int64), minlength=len(phrases))


def _scan(parts: int, most: int):
    """Counts of the candidates of a chunk, as lists by part: words as they are numbered, phrases by an automaton."""

    def scan(table, cells):
        _, lang, names, ids = _read(table)
        found, codes, counts = [], [], []
        rank = ids.copy()  # of the phrase that starts at a word, among the different ones
        for m, at, code in _grams(lang, names, ids, parts, most, _known(cells), most):
            key = rank[at] if m == 1 else rank[at] * len(names) + ids[at + m - 1]
            _, first, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            if m > 1:
                rank[at] = inverse
            codes.append(code[first])
            found.append([b" ".join([names[w] for w in ids[i : i + m].tolist()]) for i in at[first].tolist()])
            if m == 1:
                counts.append(times)
            elif m == 2:
                near = np.zeros(len(ids) + 1, bool)
                near[at] = near[at + 1] = True
        read = near[:-1] | np.concatenate([[False], near[:-2]])  # the word after a stretch stands for a line end
        text = b" ".join([b"", *[names[w] for w in np.where(near[:-1], ids, 0)[read].tolist()], b""])
        phrases = [p for group in found[1:] for p in group]
        counts = np.concatenate([*counts, matches(phrases, text)])
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        phrases = found[0] + phrases
        rows = [(p, lang, [phrases[i].decode() for i in order[a:b].tolist()], counts[order[a:b]]) for p, a, b in _dealt(codes[order], parts)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())))], names=["part", "lang", "phrases", "counts"])

    return scan


def _summed(least: int):
    """(lang, phrase, m, f) of one part: sums over all chunks that reach `least`."""

    def add(table):
        lists = table.combine_chunks()
        sizes = pc.list_value_length(lists["phrases"]).to_numpy()
        lang = lists["lang"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        flat = pa.table([lang, pc.list_flatten(lists["phrases"]), pc.list_flatten(lists["counts"])], names=["lang", "phrase", "f"])
        sums = flat.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        sums = sums.filter(pc.greater_equal(sums["f_sum"], least))
        m = pc.add(pc.count_substring(sums["phrase"], " "), 1).cast(pa.int32())
        return pa.table([sums["lang"], sums["phrase"], m, sums["f_sum"]], names=["lang", "phrase", "m", "f"])

    return add


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST_WORDS, chunk_bytes: int = CHUNK_BYTES, part_entries: int = PART_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of up to `most` words (2 at least) that occur `least` times or
    more, and (lang, n) with the number of words of each language."""
    source = small_batches(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where("text is not null")
    chunks = materialise(source.mapInArrow(_chunks(chunk_bytes), "chunk long, lang string, n long, names binary, ids binary"))
    words = chunks.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    parts = max(3 * n_partitions(docs), -(-2 * total // part_entries))
    cells = None
    for level in LEVELS:
        level = tuple(m for m in level if m <= most)
        if not level:
            continue
        if cells is None:

            def entries(batches, level=level):
                for batch in batches:
                    for i in range(batch.num_rows):
                        yield from _cells(batch.slice(i, 1), parts, level, None, 0).to_batches()

            met = chunks.mapInArrow(entries, ENTRIES)
        else:
            met = chunks.groupBy("chunk").cogroup(cells.groupBy("chunk")).applyInArrow(_next_cells(parts, level), ENTRIES)
        reach = materialise(met.groupBy("part").applyInArrow(_reaching(least), "chunk long, part int, cells binary"))
        cells = reach if cells is None else cells.union(reach)
    counts = chunks.groupBy("chunk").cogroup(cells.groupBy("chunk")).applyInArrow(_scan(parts, most), "part int, lang string, phrases array<string>, counts array<long>")
    return materialise(counts.groupBy("part").applyInArrow(_summed(least), "lang string, phrase string, m int, f long")), words


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def _joined(first, size) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def scores(counts: DataFrame) -> DataFrame:
    """lang, phrase, m, a, l, r, score of every phrase of two words or more, at its lowest cut.

    Products are decimals of 38 digits, so no count overflows them.
    """
    whole = counts.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = whole.select("lang", "phrase", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"), "w").select("lang", "phrase", "m", "a", "k", _joined(F.lit(1), F.col("k")).alias("front"), _joined(F.col("k") + 1, F.col("m") - F.col("k")).alias("back"))
    front = counts.select("lang", F.col("phrase").alias("front"), F.col("f").alias("l"))
    back = counts.select("lang", F.col("phrase").alias("back"), F.col("f").alias("r"))
    score = F.expr(f"cast(a as decimal(19,0)) * {SCALE} div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least")
    return cut.join(front, ["lang", "front"]).join(back, ["lang", "back"]).groupBy("lang", "phrase", "m", "a").agg(least).select("lang", "phrase", "m", "a", "least.l", "least.r", "least.score")


def uncovered(scored: DataFrame, percent: int = COVERED) -> DataFrame:
    """Without the phrases whose words lie inside a longer one that has `percent` of their occurrences."""
    longer = scored.where("m > 2").select("lang", F.split("phrase", " ").alias("w"), "m", "a")
    part = longer.select("lang", "w", "m", "a", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size")).select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("at"))
    around = part.groupBy("lang", _joined(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    return scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (_exact("around") * 100 < _exact("a") * percent)).drop("around")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    counts, words = phrase_counts(docs, text, lang, least, **sizes)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = uncovered(scores(counts)).withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
