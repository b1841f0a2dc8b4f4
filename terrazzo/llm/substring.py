"""Removal of repeated passages by sliding sentence spans.

The units are sentences, lines and the clauses of a sentence: a passage that repeats seldom begins
and ends with a sentence, and its clauses let it lose more than its whole sentences. A span is a
run of consecutive units that holds MIN_WORDS words: at each unit the shortest that ends there and
the shortest that starts there. Each run of MIN_WORDS words or more made of whole units is made of
such spans, so a repeated passage loses all its whole units if they hold MIN_WORDS words, wherever
its ends fall; units that it holds in part stay. Every span is hashed (128 bits of its words in
lower case) and joined over all documents; a unit goes if any span over it also occurs earlier,
that is in a document of smaller id or further up in the same one. The first occurrence stays.

Spans are hashed once. A chunk of at most about CHUNK_SPANS of them is settled where it is: of the
spans that repeat in it only the first goes on, and what the others cover is removed. The firsts
of all chunks meet by hash, where all but the first of a hash remove what they cover. So a span
that millions of documents share costs its task one row a chunk.

Words are cut at white space. In scripts without it, each Chinese character, kana or bopomofo
letter counts as a word, and so do four characters of Thai, Lao, Tibetan, Burmese or Khmer.

Defined cases: null and empty texts have no units and come back as they were. Rows of equal id
and text are one document and are treated alike; rows of equal id and different texts are told
apart by a hash of the text. Null ids come last in the order. Without a repeated span a text comes
back byte for byte. Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.llm.common import mix64, slices, small_batches

MIN_WORDS = 20
CHUNK_SPANS = 1_000_000
#: Stops that need white space after them, and those that don't: of Chinese and Japanese, Indic
#: scripts, Arabic and Urdu, Armenian, Ethiopic, Tibetan, Burmese and Khmer.
_END = re.compile(r"[.!?,;:]+\s+|[。！？｡、，；：।॥؟۔،؛։።፧፣፤༎།၊။៕។]+\s*|\n\s*")
_DENSE = re.compile(r"[\u3005-\u3007\u3041-\u30ff\u3105-\u312f\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]|[\u0e01-\u0eff\u0f40-\u0fbc\u1000-\u1049\u1050-\u109f\u1780-\u17d3]{1,4}")
_LAST = 2**63 - 1


def pieces(text: str) -> list[str]:
    """The units of a text, cut after each sentence, clause and line; joined they are the text again."""
    cuts = [m.end() for m in _END.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    found, start = [], 0
    for cut in cuts:
        part = text[start:cut]
        if found and not part.strip():
            found[-1] += part
        elif part:
            found.append(part)
        start = cut
    return found


def words_of(part: str) -> list[str]:
    """Words in lower case."""
    part = part.lower()
    return (part if part.isascii() else _DENSE.sub(r" \g<0> ", part)).split()


def _spans(total: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First unit of every span and the one after its last, for texts that lie one after the other.

    total: words before each unit, and in all; ends: for each unit, where its text's units end.
    """
    at = np.arange(len(ends))
    stop = np.searchsorted(total, total[:-1] + MIN_WORDS)
    start = np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1
    begins = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1]) if len(ends) else at
    begin = np.repeat(begins, np.diff(np.append(begins, len(ends))))
    forth, back = stop <= ends, start >= begin
    pairs = np.unique(np.concatenate([at[forth] * (len(ends) + 1) + stop[forth], start[back] * (len(ends) + 1) + at[back] + 1]))
    return pairs // (len(ends) + 1), pairs % (len(ends) + 1)


def spans(words: list[list[str]]) -> list[tuple[int, int]]:
    """(first unit, unit after the last) of every span of a text."""
    total = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    return list(zip(*(x.tolist() for x in _spans(total, np.full(len(words), len(words))))))


#: Odd factors of the two halves of a span's hash.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _hashes(units: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the sequence of units of each span, from running sums; units: a column a half."""
    found = []
    for half, factor in enumerate(_FACTORS):
        up = np.cumprod(np.full(len(units) + 1, np.uint64(factor)))
        down = np.cumprod(np.full(len(units) + 1, np.uint64(pow(factor, -1, 2**64))))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(units[:, half] * up[:-1])])
        found.append(mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)).view(np.int64))
    return found


#: One span, or (gone) a run of units that a document loses; at and th name the document.
FOUND = {"h1": np.int64, "h2": np.int64, "at": np.int64, "th": np.int64, "start": np.int32, "stop": np.int32}


def _settled(columns: list[np.ndarray]):
    """The spans of a chunk that are the first of their hash, and the runs that the others cover."""

    def batch(fields, gone: bool):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, t)) for c, t in zip(fields, FOUND.values())] + [pa.array(np.full(len(fields[0]), gone))], names=[*FOUND, "gone"])

    h1, h2, at, th, start, stop = columns
    order = np.lexsort((start, th, at, h2, h1))
    h1, h2, at, th, start, stop = (c[order] for c in (h1, h2, at, th, start, stop))
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    yield batch([c[new] for c in (h1, h2, at, th, start, stop)], False)
    gone = ~new & ((at != at[head]) | (th != th[head]) | (start != start[head]))
    at, th, start, stop = at[gone], th[gone], start[gone].astype(np.int64), stop[gone].astype(np.int64)
    order = np.lexsort((start, th, at))
    at, th, start, stop = at[order], th[order], start[order], stop[order]
    other = np.ones(len(at), bool)
    other[1:] = (at[1:] != at[:-1]) | (th[1:] != th[:-1])
    shift = np.cumsum(other) << 32  # documents lie one after the other
    reach = np.maximum.accumulate(stop + shift)
    other[1:] |= start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(other)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    yield batch([at[first], th[first], at[first], th[first], start[first], reach[last] - shift[last]], True)


def _found(batches):
    """Rows of FOUND and gone. A span that is gone carries its document in place of its hash."""
    held, count = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
        for first, last in slices(lengths, 2_000_000):
            part = batch.slice(first, last - first)
            sizes, counts, digests = [], [], []
            for text in part.column(2):
                units = [words_of(p) for p in pieces(text.as_py() or "")]
                counts += map(len, units)
                digests += [xxhash.xxh3_128_digest(" ".join(w)) for w in units]
                sizes.append(len(units))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes)
            start, stop = _spans(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), ends[owner])
            if not len(start):
                continue
            h1, h2 = _hashes(np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2), start, stop)
            doc = owner[start]
            begin = ends[doc] - np.array(sizes)[doc]
            held.append([h1, h2, part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc], (start - begin).astype(np.int32), (stop - begin).astype(np.int32)])
            count += len(start)
            if count >= CHUNK_SPANS:
                yield from _settled([np.concatenate(c) for c in zip(*held)])
                held, count = [], 0
    if held:
        yield from _settled([np.concatenate(c) for c in zip(*held)])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: bool = False) -> DataFrame:
    """doc_id, text (what is left), n_units, n_removed (units) of every row and, if `carry`, row: a
    struct of the other columns, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)] if carry else []
    row = [F.struct(*others).alias("row")] if others else []
    carried = len(row)  # functions for executors can't hold columns
    named = small_batches(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("at"), F.xxhash64(F.col(text)).alias("th"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    found = named.select("at", "th", "text").mapInArrow(_found, "h1 long, h2 long, at long, th long, start int, stop int, gone boolean")
    # repeated rows of a document share the first place
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("at", "th", "start"))
    later = found.withColumn("place", place).where("gone or place > 1")
    gone = later.groupBy("at", "th").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    both = named.join(gone.select(F.col("at").alias("at2"), F.col("th").alias("th2"), "gone"), (F.col("at") == F.col("at2")) & (F.col("th") == F.col("th2")), "left")
    kept = both.select("doc_id", "text", "gone", *["row"] * carried)

    def cut(batches):
        for batch in batches:
            texts, total, removed = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = pieces(text or "")
                total.append(len(parts))
                drop = {i for r in ranges or () for i in range(r["start"], r["stop"])}
                removed.append(len(drop))
                texts.append("".join(p for i, p in enumerate(parts) if i not in drop) if drop else text)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), *([batch.column(3)] if carried else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_units", "n_removed"] + ["row"] * carried)

    schema = T.StructType([kept.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType())] + ([kept.schema["row"]] if carried else []))
    return kept.mapInArrow(cut, schema)


def strip_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline form: `docs` with repeated passages gone and n_chars made to fit; no row goes."""
    out = remove_repeats(docs, carry=True)
    columns = []
    for field in docs.schema:
        if field.name in ("doc_id", "text"):
            column = F.col(field.name)
        elif field.name == "n_chars":
            column = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row").getField("n_chars")).cast(field.dataType)
        else:
            column = F.col("row").getField(field.name)
        columns.append(column.alias(field.name))
    return out.select(columns)
