"""Language identification by words first, then by ever shorter character n-grams.

A word seen in training scores the log relative frequency that it has in each language. A word
never seen backs off to its longest character n-grams of which any is known, and scores their
mean. A text scores the mean of its words.

Defined cases: a null text, an empty text and a text without a letter are `und` with score 0, as
is every text when no labelled text was given. Rows with a null id are scored and never learned
from. Ties go to the first language in alphabetical order. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.llm.common import crc_mod, slices, small_batches

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
#: Negative log10 frequency of a unit that a language never showed.
PENALTY = 7.0
MAX_GRAM = 5
#: Bounds of the model: texts learned from per language, and units kept in all.
SAMPLE_PER_LANG = 1000
MODEL_UNITS = 600_000
CACHE_WORDS = 200_000
#: Characters whose words are looked up together.
SLICE_CHARS = 500_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_units(batches):
    """(lang, n, unit, count): n is 0 for words, else the length of the n-gram."""
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, Counter()).update(words_of(text or ""))
        rows: list[tuple[str, int, str, int]] = []
        for lang, words in by_lang.items():
            units: Counter = Counter()
            for word, count in words.items():
                for n in range(1, MAX_GRAM + 1):
                    for gram in _grams(word, n):
                        units[n, gram] += count
            rows += [(lang, 0, w, c) for w, c in words.items()]
            rows += [(lang, n, g, c) for (n, g), c in units.items()]
        for i in range(0, len(rows), 100_000):
            part = list(zip(*rows[i : i + 100_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.string()), pa.array(part[3], pa.int64())], names=["lang", "n", "unit", "count"])


def _dealt(doc_id: str, seed: int):
    """A number from 0 to 1 by a hash of the id."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1_000_000)) / 1e6


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_per_lang: int = SAMPLE_PER_LANG, model_units: int = MODEL_UNITS) -> dict:
    """Learn from at most about `sample_per_lang` texts a language, chosen by a hash of the id.

    The model holds at most `model_units` units over all languages and orders, so what is sent to
    the executors has a bound that doesn't grow with the corpus. What one language keeps is scored
    by its counts in all: only a unit that a language never showed has the penalty there.
    """
    labelled = small_batches(docs).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    per_lang = {r["l"]: r["c"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("c")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return {"langs": [], "share": {}, "words": {}, "grams": [{} for _ in range(MAX_GRAM + 1)], "rows": np.zeros((0, 0))}
    share = {k: min(1.0, sample_per_lang / per_lang[k]) for k in langs}
    chosen = labelled.where(_dealt("i", 17) < F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("l")])
    counts = chosen.select("t", "l").mapInArrow(_count_units, "lang string, n int, unit string, count long").groupBy("lang", "n", "unit").agg(F.sum("count").alias("count"))
    top = max(50, model_units // (len(langs) * (MAX_GRAM + 1)))
    group = Window.partitionBy("lang", "n")
    ranked = counts.withColumns({"total": F.sum("count").over(group), "r": F.row_number().over(group.orderBy(F.desc("count"), "unit"))})
    # a unit that one language keeps comes with its counts in all of them
    share_of = F.struct(F.col("lang"), F.log10(F.col("count") / F.col("total")).cast("float").alias("score"))
    kept = ranked.groupBy("n", "unit").agg(F.min("r").alias("r"), F.collect_list(share_of).alias("scores")).where(F.col("r") <= top)
    at, scores = {k: i for i, k in enumerate(langs)}, np.full((0, len(langs)), -PENALTY, np.float32)
    words, grams, used = {}, [{} for _ in range(MAX_GRAM + 1)], 0
    for r in kept.select("n", "unit", "scores").toLocalIterator(prefetchPartitions=True):
        (words if r["n"] == 0 else grams[r["n"]])[r["unit"]] = used
        if used == len(scores):
            scores = np.concatenate([scores, np.full((max(1024, used // 2), len(langs)), -PENALTY, np.float32)])
        for lang, score in r["scores"]:
            scores[used, at[lang]] = score
        used += 1
    return {"langs": langs, "share": share, "words": words, "grams": grams, "rows": scores[:used]}


class Scorer:
    """Scores of words by language: rows of a table that new words join when they are first met."""

    def __init__(self, model: dict):
        self.model = model
        self._start()

    def _start(self) -> None:
        self.at, self.table, self.used = dict(self.model["words"]), self.model["rows"], len(self.model["rows"])

    def learn(self, words: list[str]) -> None:
        """Score words that the model doesn't hold: each has the mean of its longest known n-grams."""
        if not words:
            return
        grams, found, sizes = self.model["grams"], [], []
        for word in words:
            known = []
            for n in range(min(MAX_GRAM, len(word) + 2), 0, -1):
                order = grams[n]
                known = [order[g] for g in _grams(word, n) if g in order]
                if known:
                    break
            found += known
            sizes.append(len(known))
        size = np.array(sizes)
        scores = np.full((len(words), self.table.shape[1]), -PENALTY, np.float32)
        starts = (np.cumsum(size) - size)[size > 0]
        if len(starts):
            scores[size > 0] = np.add.reduceat(self.model["rows"][found], starts, axis=0) / size[size > 0, None]
        if self.used + len(words) > len(self.table):
            grown = np.empty((max(self.used + len(words), len(self.table) * 3 // 2), self.table.shape[1]), np.float32)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        self.table[self.used : self.used + len(words)] = scores
        self.at.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, found, score = self.model["langs"], [], []
        for start, stop in slices([len(t or "") for t in texts], SLICE_CHARS):
            listed = [words_of(t) if t and langs else [] for t in texts[start:stop]]
            if self.used - len(self.model["rows"]) > CACHE_WORDS:  # words met in texts are forgotten, so memory stays bounded
                self._start()
            self.learn(list(set().union(*listed).difference(self.at)))
            for words in listed:
                if not words:
                    found.append(UNKNOWN)
                    score.append(0.0)
                    continue
                rows = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
                mean = self.table[rows].mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                # posterior of a text of at most 20 such words, so that long texts are not all at 1
                odds = np.power(10.0, (mean - mean[best]) * min(len(words), 20))
                found.append(langs[best])
                score.append(float(1.0 / odds.sum()))
        return found, score


def predict(docs: DataFrame, model: dict | Broadcast, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score of every row, from the whole text and nothing else."""
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found, sure = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of all ids that is never learned from; false for a null id."""
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from."""
    return docs.where(crc_mod("doc_id", 5) != 0)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Train on the learnable rows of `docs` and predict all of them."""
    model = train(learnable(docs), **bounds)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def least_score(docs: DataFrame, shared: Broadcast) -> float:
    """Half-way from an even score to the least one of all labelled rows told right; 0 where there is
    nothing to tell apart."""
    model = shared.value
    if len(model["langs"]) < 2:
        return 0.0
    labelled = docs.where("text is not null and lang is not null")
    told = predict(labelled.select(F.col("lang").alias("doc_id"), "text"), shared).where("lang_pred = doc_id")
    least, even = told.agg(F.min("score")).first()[0], 1 / len(model["langs"])
    return (even + max(even, least)) / 2 if least is not None else 0.0


def reject_unknown(docs: DataFrame, at_least: float | None = None) -> DataFrame:
    """Pipeline form: rows of `docs`, without those whose language can't be told: texts without a
    letter, and those that score under `at_least`, or else under least_score() of the learnable rows.

    The decision is taken in the same pass as the score, so no join is needed and repeated ids
    are judged row by row. Without `at_least`, a pass over the labelled rows goes before. Columns stay
    as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(learnable(docs)))
    if at_least is None:
        at_least = least_score(learnable(docs), shared)
    at = docs.columns.index("text")

    def keep(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found, sure = scorer.scores(batch.column(at).to_pylist())
            yield batch.filter(pa.array([f != UNKNOWN and s >= at_least for f, s in zip(found, sure)], pa.bool_()))

    return small_batches(docs).mapInArrow(keep, docs.schema)
