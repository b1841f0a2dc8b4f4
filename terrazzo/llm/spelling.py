"""Spelling variants: words one edit apart, each joined to a far more frequent form.

The words are runs of Latin letters, counted over all texts; as many as a rule over the document and
the run says lose a letter first (see `word_counts`). The vocabulary, cut by range into shards, becomes
compact tries: nodes in order of their depth, so that a node is a label and the place of its first
child. A bounded round of tries is broadcast. For each word its Levenshtein automaton of distance one
runs through every trie depth-first: along the word itself without an edit, and at each node of that
path into the states with one edit (a letter left out, put in or replaced), which must then follow the
rest of the word. The neighbours that it accepts are reduced to their number and the best of them,
within the tries of a round and then over all rounds.

A word's form is its most frequent neighbour, if that is `factor` times as frequent. Forms grow by
that factor, so a chain of them ends after a few steps; roots are found by doubling the steps.

Defined cases: a null or empty text has no words; a null id counts as an empty one. Repeated rows count
as often as they occur. Words of any length are read whole. Ties of forms go to the word that comes
first by code points. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.common import materialise, n_partitions, slices, small_batches

LEAST_LETTERS = 6
LEAST_COUNT = 5
FACTOR = 5
#: One run of a document in so many, by its hash, loses a letter.
LOSES = 199
#: Letters of the words of one trie (a longer word has one of its own).
SHARD_LETTERS = 500_000
#: Tries that are broadcast together.
ROUND_BYTES = 32_000_000
#: Words that a task counts before it passes their sums on.
HELD_WORDS = 500_000

# The letters of a run (one byte each in Latin-1), in lower case where they are ASCII.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text in Latin-1, which has them all; what it lacks ends a run."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def counted(texts, least_letters: int = LEAST_LETTERS, loses: int = LOSES):
    """Sums (word: occurrences) of (id as text, text) pairs, HELD_WORDS words or so at a time."""
    total: Counter[bytes] = Counter()
    for doc_id, text in texts:
        before = zlib.crc32(f"{doc_id}:".encode())
        for run, n in Counter(runs(text)).items():
            if len(run) < least_letters:
                continue
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
            if h % loses == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least_letters:
                    continue
            total[run] += n
        if len(total) > HELD_WORDS:
            yield total
            total = Counter()
    yield total


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, loses: int = LOSES) -> DataFrame:
    """(word, n) of the words that have `least_letters` and occur `least` times or more.

    With h the crc32 of `<doc_id>:<run>`, a run whose h `loses` divides loses its letter h modulo its length.
    """

    def count(batches):
        pairs = ((i or "", t or "") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for total in counted(pairs, least_letters, loses):
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

    source = small_batches(docs).select(F.col(doc_id).cast("string"), F.col(text).cast("string")).toDF("id", "text")
    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """Words (bytes, sorted, all different) and their counts.

    The children of node v are the nodes first[v] to first[v + 1], in the order of their labels;
    word[v] is the number of the word that ends at v, or -1.
    """

    __slots__ = ("labels", "first", "word", "text", "cut", "n")

    def __init__(self, words: list[bytes], n):
        labels, first, word = bytearray(b"\0"), array("I"), array("i")
        level = [(0, len(words), 0)]
        while level:  # a level of nodes at a time: each is a range of words with one beginning
            below = []
            for low, high, depth in level:
                first.append(len(labels))
                ends = len(words[low]) == depth if high > low else False
                word.append(low if ends else -1)
                low += ends
                while low < high:
                    label, upto = words[low][depth], low + 1
                    while upto < high and words[upto][depth] == label:
                        upto += 1
                    labels.append(label)
                    below.append((low, upto, depth + 1))
                    low = upto
            level = below
        first.append(len(labels))
        self.labels, self.first, self.word, self.n = bytes(labels), first, word, array("q", n)
        self.text = b"".join(words)
        self.cut = array("I", [0])
        for w in words:
            self.cut.append(self.cut[-1] + len(w))

    def __getstate__(self):
        return tuple(getattr(self, k) for k in self.__slots__)

    def __setstate__(self, state):
        for k, v in zip(self.__slots__, state):
            setattr(self, k, v)

    def spelled(self, i: int) -> bytes:
        return self.text[self.cut[i] : self.cut[i + 1]]

    def near(self, q: bytes) -> set[int]:
        """Numbers of the words that differ from `q` by exactly one letter put in, left out or replaced."""
        labels, first, word, size = self.labels, self.first, self.word, len(q)
        find = labels.find
        found: set[int] = set()

        def rest(node: int, at: int) -> None:  # one edit is made: the rest of the word must follow
            while at < size:
                node = find(q[at], first[node], first[node + 1])
                if node < 0:
                    return
                at += 1
            if word[node] >= 0:
                found.add(word[node])

        node = 0
        for at in range(size):
            low, high, letter = first[node], first[node + 1], q[at]
            rest(node, at + 1)  # left out
            after = q[at + 1] if at + 1 < size else -1
            for child in range(low, high):
                a, b = first[child], first[child + 1]
                step = find(letter, a, b)  # put in before this letter
                if step >= 0:
                    rest(step, at + 1)
                if labels[child] != letter:  # replaced
                    if after < 0:
                        if word[child] >= 0:
                            found.add(word[child])
                    elif (step := find(after, a, b)) >= 0:
                        rest(step, at + 2)
            node = find(letter, low, high)
            if node < 0:
                return found
        for child in range(first[node], first[node + 1]):  # put in at the end
            if word[child] >= 0:
                found.add(word[child])
        return found


def _tries(shard_letters: int):
    """Tries of the words of a task, sorted and cut into shards, with their first word as their name."""

    def build(batches):
        rows = sorted((w.encode("latin-1"), n) for b in batches for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for first, last in slices([len(w) for w, _ in rows], shard_letters):
            part = rows[first:last]
            trie = zlib.compress(pickle.dumps(Trie([w for w, _ in part], [n for _, n in part])), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part[0][0].decode("latin-1")]), pa.array([len(trie)], pa.int64()), pa.array([trie], pa.binary())], names=["shard", "size", "trie"])

    return build


def neighbours(words: DataFrame, shard_letters: int = SHARD_LETTERS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n_near, form, form_n of every word of (word, n) that has a neighbour; form is the best one.

    Each round broadcasts tries of `round_bytes` at most (or one, if it is larger).
    """
    sc = words.sparkSession.sparkContext
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    shards = materialise(words.repartitionByRange(max(1, -(-letters // shard_letters)), "word").mapInArrow(_tries(shard_letters), "shard string, size long, trie binary"))
    rounds: list[tuple[int, list[str]]] = []
    for name, size in shards.select("shard", "size").sort("shard").collect():  # a row a shard
        if not rounds or rounds[-1][0] + size > round_bytes:
            rounds.append((0, []))
        rounds[-1] = (rounds[-1][0] + size, rounds[-1][1] + [name])
    spread = words.select("word").repartition(n_partitions(words))
    parts = []
    for _, names in rounds:
        sent = sc.broadcast([row.trie for row in shards.where(F.col("shard").isin(names)).select("trie").toLocalIterator()])

        def meet(batches, sent=sent):
            tries = [pickle.loads(zlib.decompress(t)) for t in sent.value]
            for batch in batches:
                rows = []
                for word in batch.column(0).to_pylist():
                    q, number, best = word.encode("latin-1"), 0, None
                    for trie in tries:
                        near = trie.near(q)
                        number += len(near)
                        for i in near:
                            if best is None or trie.n[i] >= -best[0]:
                                best = min(best or (1, b""), (-trie.n[i], trie.spelled(i)))
                    if best:
                        rows.append((word, number, best[1].decode("latin-1"), -best[0]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "form", "form_n"])

        part = spread.mapInArrow(meet, "word string, n_near long, form string, form_n long")
        if len(rounds) > 1:  # one round's tries at a time, in the driver and in every worker
            part = materialise(part)
            sent.destroy()
        parts.append(part)
    if not parts:
        return words.sparkSession.createDataFrame([], "word string, n_near long, form string, form_n long")
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of (word, form): the last of each word's chain of forms, in rounds that double its steps."""
    at = materialise(links.select("word", F.col("form").alias("root")))
    for _ in range(64):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at
    raise RuntimeError("chains of forms did not end")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", factor: int = FACTOR, shard_letters: int = SHARD_LETTERS, round_bytes: int = ROUND_BYTES, **rules) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that word_counts has by its `rules`."""
    words = materialise(word_counts(docs, text, doc_id, **rules))
    near = neighbours(words, shard_letters, round_bytes)
    far = F.col("form_n").cast("decimal(20,0)") >= F.col("n").cast("decimal(20,0)") * factor
    formed = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")))
    end = roots(formed.where("form is not null"))
    return formed.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
