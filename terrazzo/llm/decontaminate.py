"""Benchmark decontamination: which documents contain which test items.

Only DataFrame functions run here. A text's words are its runs of letters and digits in lower
case; its shingles are its runs of five words. An item of fewer words is one shingle, looked for
among the documents' runs of that length. A document contains an item if it holds at least 80 of
100 of the item's distinct shingles.

Search: every item has a MinHash sketch, its shingles of least hash. Items are partitioned by
size, and a partition's sketches are as long as its largest item needs: an item of u shingles
that is contained has at most u - ceil(0.8 u) shingles missing, so one more than that, taken by
hash order, can't all be missing. Documents therefore need no sketch, their length doesn't
matter, and no containment is lost. Documents' shingle hashes meet the sketches in a hash join.
Verification: only documents that met a sketch are shingled again, and their shingles are
compared as text with those of the item.

The items' side is broadcast only up to BROADCAST_ROWS rows, counted first; beyond that both joins
shuffle by hash, and a shingle of very many documents is split by adaptive execution.

A document has no sketch of its own and no containment is estimated: the sketch of the item decides
which documents are verified, and verification is exact.

Defined cases: null or empty texts, and items without a word, match nothing. Repeated documents
are told apart by id alone; repeated item ids pool their shingles; rows without an id match
nothing. Equal hashes of an item are ordered by the shingle's text. Very long texts are shingled
whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from terrazzo.llm.common import materialise

WIDTH = 5
PERCENT = 80
BROADCAST_ROWS = 200_000


def words(text: str | Column) -> Column:
    """Array of words; empty for a null text or one without a word."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(F.length(plain), F.lit(0)) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def _runs(n: int, of) -> Column:
    """of(start) for each run of n words in the column `words`."""
    return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), of)).otherwise(F.array())


def _hashes(n: int) -> Column:
    return _runs(n, lambda i: F.xxhash64(F.slice("words", i, n))).cast("array<bigint>")


def _texts(n: int) -> Column:
    return _runs(n, lambda i: F.array_join(F.slice("words", i, n), " ")).cast("array<string>")


def item_shingles(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, shingle, h, width, n_shingles: the distinct shingles of every item."""
    split = items.select(F.col(item_id).alias("item_id"), words(text).alias("words")).where("item_id is not null and size(words) > 0")
    short = split.where(f"size(words) < {WIDTH}").select("item_id", F.array_join("words", " ").alias("shingle"), F.xxhash64("words").alias("h"), F.size("words").alias("width"))
    long = split.where(f"size(words) >= {WIDTH}").select("item_id", F.explode(F.arrays_zip(_texts(WIDTH).alias("shingle"), _hashes(WIDTH).alias("h"))).alias("z")).select("item_id", "z.shingle", "z.h", F.lit(WIDTH).alias("width"))
    return short.union(long).distinct().withColumn("n_shingles", F.count(F.lit(1)).over(Window.partitionBy("item_id")))


def sketches(shingles: DataFrame) -> DataFrame:
    """The rows of `shingles` that make the sketches of their items.

    Size partitions end at powers of two; a sketch has what the partition's largest size needs.
    """
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_shingles"))) + 1) - 1
    needed = largest - F.ceil(largest * PERCENT / 100) + 1
    return shingles.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle"))).where(F.col("rank") <= needed).drop("rank")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every contained item."""
    grams = materialise(item_shingles(items))
    widths = sorted({WIDTH} | {r["width"] for r in grams.select("width").distinct().collect()})
    small = grams.count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)
    split = docs.select(F.col(doc_id).alias("doc_id"), words(text).alias("words")).where("doc_id is not null")
    hashes = F.concat(*[_hashes(n) for n in widths]) if len(widths) > 1 else _hashes(WIDTH)
    # the words' array stays with its scan: the hashes are exploded in the same stage and nothing else is kept
    met = split.select("doc_id", F.explode(hashes).alias("h")).join(side(sketches(grams).select("h", "item_id")), "h")
    candidates = materialise(met.select("doc_id", "item_id").distinct())
    asked = candidates.select(F.col("doc_id").alias("candidate")).distinct()
    again = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(asked, F.col("doc_id") == F.col("candidate"), "left_semi").select("doc_id", words("text").alias("words"))
    texts = F.concat(*[_texts(n) for n in widths]) if len(widths) > 1 else _texts(WIDTH)
    held = again.select("doc_id", F.explode(F.array_distinct(texts)).alias("shingle")).join(side(grams.select("shingle", "item_id", "n_shingles")), "shingle")
    held = held.join(candidates, ["doc_id", "item_id"], "left_semi")
    counted = held.select("doc_id", "item_id", "shingle", "n_shingles").distinct().groupBy("doc_id", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_shingles") * PERCENT).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline form: the rows of `docs` that contain no item; columns stay as they are.

    A row without an id can't be named by a match and stays.
    """
    bad = contaminated(docs, items).select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("__bad_id"), "left_anti")
