"""Toxicity by non-negative positive-unlabelled learning.

The classifier is logistic in the presence of words. It sees confirmed toxic texts (P) and texts
of unknown kind (U), and minimises the class-prior-corrected risk
    prior * risk_P(+1) + max(0, risk_U(-1) - prior * risk_P(-1)),
stepping back up the second term whenever it falls below zero. The prior is the share of toxic
rows among the labels that may be learned from. The words are those whose document frequency
differs between P and U by more than MIN_Z standard errors.

Only the fit is on a sample, at most MAX_POSITIVE and about MAX_UNLABELLED texts; the least hashes
of the ids choose them. Every row is scored, from its whole text and nothing else.

Defined cases: null and empty texts score as a text without any word of the model; without a
single toxic label all scores are 0. A null id is scored, not learned from. Repeated labels count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.common import crc_mod, materialise, small_batches
from terrazzo.llm.langid import words_of

MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
MAX_WORDS = 20_000
MIN_Z = 5.0
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id"):
    """True for the third of all ids whose labels are never learned from; false for a null id."""
    return F.coalesce(crc_mod(doc_id, 3) == 1, F.lit(False))


def fit_nnpu(p: list[np.ndarray], u: list[np.ndarray], n_features: int, prior: float, steps: int = 1000, rate: float = 0.05, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier, by Adam on the non-negative risk.

    p, u: for each text the numbers of the features that it has.
    """
    rows = [*p, *u]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    feature = np.concatenate(rows).astype(np.int64)
    positive = np.arange(len(rows)) < len(p)
    weight, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, weight[feature], len(rows)) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        risk_u = np.logaddexp(0, z[~positive]).mean()
        risk_p = np.logaddexp(0, z[positive]).mean()
        negative = np.where(positive, -prior * s / len(p), s / max(1, len(u)))
        slope = np.where(positive, prior * (s - 1) / len(p), 0) + negative
        if risk_u - prior * risk_p < 0:
            slope = -negative
        grad = np.append(np.bincount(feature, slope[owner], n_features) + l2 * weight, slope.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
        weight, bias = weight - step[:-1], bias - step[-1]
    return weight, bias


def _distinct_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(words_of(t or ""))) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["positive", "words"])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from the labels that may be learned from; its size is bounded by MAX_WORDS."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("toxic")).where((crc_mod("id", 3) != 1) & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not counts["p"]:
        return {"weights": {}, "bias": -40.0}
    prior = min(0.5, max(0.001, counts["p"] / counts["n"]))
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("id", F.lit(4)), "id").limit(MAX_POSITIVE).select("id")
    slim = small_batches(docs).select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    free = slim.where(crc_mod("id", 3) != 1)
    share = min(1.0, MAX_UNLABELLED / max(1, free.count()))
    # at most MAX_POSITIVE ids are broadcast
    p = slim.join(F.broadcast(chosen), "id").select(F.lit(True).alias("positive"), "text")
    u = free.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < share * 1e6).select(F.lit(False).alias("positive"), "text")
    sample = materialise(p.union(u).mapInArrow(_distinct_words, "positive boolean, words array<string>"))
    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = n.get(True, 0), n.get(False, 0)
    if not n_p or not n_u:
        return {"weights": {}, "bias": -40.0}
    df = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("u")).where("p + u >= 4")
    pooled = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / n_p + 1 / n_u))
    words = [r["word"] for r in df.withColumn("z", F.abs(z)).where(F.col("z") > MIN_Z).orderBy(F.desc("z"), "word").limit(MAX_WORDS).collect()]
    at = {w: i for i, w in enumerate(words)}
    shared = docs.sparkSession.sparkContext.broadcast(at)

    def index(batches):
        at = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[at[w] for w in x if w in at] for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["positive", "features"])

    rows = {True: [], False: []}
    for r in sample.mapInArrow(index, "positive boolean, features array<int>").toLocalIterator(prefetchPartitions=True):
        rows[r["positive"]].append(np.array(r["features"], np.int64))
    weight, bias = fit_nnpu(rows[True], rows[False], len(words), prior)
    return {"weights": dict(zip(words, weight.tolist())), "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        weights, bias = shared.value["weights"], shared.value["bias"]
        known = weights.keys()
        for batch in batches:
            z = [bias + sum(map(weights.__getitem__, sorted(known & set(words_of(t))))) if t else bias for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -40, 40))), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scored, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
