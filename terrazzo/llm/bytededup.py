"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of SPAN bytes that also starts earlier: in a document of smaller
id (of smaller text hash, where ids are equal), or further up in the same one. Matches never cross documents; strings are judged on the input.

1. Anchors. Each string of SPAN bytes owns the least of its GRAM-byte hashes (the leftmost, if
   tied), so equal strings own equal grams at equal places. The strings of consecutive starts that
   own one gram make a context. Anchors go to shards by the gram's hash, packed into arrays.
2. Contexts that are equal as a whole (96 bits of two hashes of all their bytes, besides the gram) are one: all but the
   first are removed at once, in the chunk of anchors that a task reads and then in the gram's
   shard, so a passage that very many documents share costs its shard one row a chunk. A gram that
   is left with one context is settled. What is left are grams with several different contexts, at
   the borders of what repeats.
3. The texts of those contexts meet by gram, in blocks of bounded size. Each block's suffix array is
   induced, and permuted common prefixes of SPAN or more join its suffixes into classes; in each
   class the earliest start stays and every other start removes its string.
4. Removed ranges meet their documents once more, and are cut.

A block of step 3 ends only between grams. A gram with more than HOT_CONTEXTS different contexts
(the border of a passage that very many documents share) would make a block without bound, so its
strings take an exact way of their own: each is hashed where its text is, repeats within a batch
are settled there, and the firsts of the batches meet in shards by hash.

Defined cases: a null text is empty; empty texts and those under SPAN bytes lose nothing. Rows of
equal id and equal text are one document, each row with its result; rows of equal id and different
texts are different documents. Null ids are equal ids and come last.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.common import materialise, mix64, n_partitions, slices, small_batches
from terrazzo.llm.suffix import permuted_lcp, suffix_array

SPAN = 100
GRAM = 40
#: Bytes of text whose anchors share a shard, on average, and bytes of contexts in one suffix array.
SHARD_BYTES = 24_000_000
BLOCK_BYTES = 1_000_000
CHUNK_BYTES = 1_000_000
#: Anchors that a task settles among themselves before it sends them.
CHUNK_RECORDS = 500_000
#: More different contexts than this don't go into one suffix array.
HOT_CONTEXTS = 1024
_LAST = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, mod 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            _POWERS[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, CHUNK_BYTES + 4096), np.uint64(base)))])
    return _POWERS["up"][:n], _POWERS["down"][:n]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie one after the other in `data` and end at `ends`.

    Returns, for each context: place of the anchor, first and last start that own it, hash of the
    gram, hash of the whole context.
    """
    n = len(data)
    starts = n - SPAN + 1
    nothing = np.zeros(0, np.int64)
    if starts <= 0:
        return nothing, nothing, nothing, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
    gram = mix64((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    # the hash above, the place below: the least is the leftmost of the least hashes
    key = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    width, least = 1, key
    window = SPAN - GRAM + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(key) - window + 1], least[window - width :])
    owner = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    at = np.arange(starts)
    valid = at + SPAN <= np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:starts]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(begins)
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | (owner[1:] != owner[:-1])
    last = np.flatnonzero(closes)
    place = owner[first]
    whole = mix64((total[last + SPAN] - total[first]) * down[first] + (place - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (last - first).astype(np.uint64))
    return place, first, last, gram[place], whole


def _chunks(raw: bytes):
    """(start, bytes) of parts that share SPAN - 1 bytes, so no string is lost between them."""
    start = 0
    while True:
        yield start, raw[start : start + CHUNK_BYTES]
        if start + CHUNK_BYTES >= len(raw):
            return
        start += CHUNK_BYTES - SPAN + 1


#: A record an anchor; a text has under 2^31 bytes. Records of one batch and shard travel as one value.
PACKED = np.dtype([("doc", "<i8"), ("th", "<i8"), ("place", "<u4"), ("before", "u1"), ("after", "u1"), ("gram", "<u8"), ("whole", "<u8"), ("digest", "<u4")])

#: Bytes of a document that go.
RANGES = np.dtype([("doc", "<i8"), ("th", "<i8"), ("start", "<i8"), ("stop", "<i8")])


def _records(kind: np.dtype, **fields) -> np.ndarray:
    out = np.empty(len(next(iter(fields.values()))), kind)
    for name, values in fields.items():
        out[name] = values
    return out


def _by_shard(records: np.ndarray, shard: np.ndarray):
    """(shard, bytes of its records) of every shard that has any."""
    order = np.argsort(shard, kind="stable")
    shard, records = shard[order], records[order]
    start = np.flatnonzero(np.diff(shard, prepend=-1))
    return shard[start], [records[i:j].tobytes() for i, j in zip(start, [*start[1:], len(shard)])]


def _anchored(batches, shards: int):
    """Rows (shard, records): records of PACKED, as bytes, once a chunk and shard; and RANGES that the
    chunk's own repeats remove, with a shard below 0."""
    held, count = [], 0

    def settled():
        records, gone = _settled(np.concatenate(held))
        shard, packed = _by_shard(records, (records["gram"] % np.uint64(shards)).astype(np.int64))
        return _batch(shard, packed, gone, shards)

    for batch in batches:
        docs, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        parts = [(d, at, b, th) for d, th, t in zip(docs, hashes, texts) if t for raw in [t.encode()] if len(raw) >= SPAN for at, b in _chunks(raw)]
        for start, stop in slices([len(p[2]) for p in parts], CHUNK_BYTES):
            some = parts[start:stop]
            raw = b"".join(p[2] for p in some)
            data = np.frombuffer(raw, np.uint8)
            size = np.array([len(p[2]) for p in some])
            ends = np.cumsum(size)
            place, first, last, gram, whole = anchors(data, ends)
            digest = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) & 0xFFFFFFFF for i, j in zip(first.tolist(), (last + SPAN).tolist())], np.uint32)
            part = np.searchsorted(ends, place, side="right")
            shift = np.array([p[1] for p in some]) - (ends - size)
            held.append(_records(PACKED, doc=np.array([p[0] for p in some])[part], th=np.array([p[3] for p in some])[part], place=place + shift[part], before=place - first, after=last - first, gram=gram, whole=whole, digest=digest))
            count += len(place)
            if count >= CHUNK_RECORDS:
                yield settled()
                held, count = [], 0
    if held:
        yield settled()


SAME = ["gram", "before", "after", "whole", "digest"]
PLACE = ["doc", "th", "place"]


def _settled(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records without those whose context is equal as a whole to an earlier one's, and the RANGES
    that these remove; of repeated rows one is left."""
    order = np.argsort(records["whole"])
    mark = records["whole"][order]
    same = mark[1:] == mark[:-1]
    several = np.zeros(len(order), bool)
    several[1:] |= same
    several[:-1] |= same
    alone, f = records[order[~several]], records[order[several]]
    f = f[np.lexsort([f[k] for k in PLACE[::-1] + SAME[::-1]])]
    new = _fresh(f, SAME)
    gone = f[~new & _elsewhere(f, new)]
    start = gone["place"].astype(np.int64) - gone["before"]
    doc, th, start, stop = _merged(gone["doc"], gone["th"], start, start + gone["after"] + SPAN)
    return np.concatenate([alone, f[new]]), _records(RANGES, doc=doc, th=th, start=start, stop=stop)


def _fresh(f: np.ndarray, names: list[str]) -> np.ndarray:
    """Where sorted records differ from the one before in any of these fields."""
    new = np.ones(len(f), bool)
    new[1:] = False
    for name in names:
        new[1:] |= f[name][1:] != f[name][:-1]
    return new


def _elsewhere(f: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Where a record's place isn't that of the first of its kind."""
    head = f[np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))] if len(f) else f
    return (f["doc"] != head["doc"]) | (f["th"] != head["th"]) | (f["place"] != head["place"])


def _batch(shard: np.ndarray, packed: list[bytes], gone: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows (shard, records), and one of RANGES, if any, with a shard below 0."""
    shard = shard.tolist()
    if len(gone):
        shard.append(-1 - int(gone["th"][0]) % shards)
        packed = [*packed, gone.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(packed, pa.binary())], names=["shard", "records"])


def _met(batches, hot_contexts: int):
    """Rows sorted by shard. Yields (doc, th, start, stop, gram, hot): a removed range where gram is
    null, else a context whose text is wanted in step 3; hot if its gram has too many."""

    def rows(doc, th, start, stop, gram=None, hot=None):
        for i in range(0, len(doc), 100_000):
            k = slice(i, i + 100_000)
            n = len(doc[k])
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c[k], np.int64)) for c in (doc, th, start, stop)), pa.nulls(n, pa.int64()) if gram is None else pa.array(gram[k].view(np.int64)), pa.array(np.zeros(n, bool) if hot is None else hot[k])], names=["doc", "th", "start", "stop", "gram", "hot"])

    for shard, packed in _shards(batches):
        if shard < 0:
            gone = np.frombuffer(b"".join(packed), RANGES)
            yield from rows(*(gone[k] for k in RANGES.names))
            continue
        records = np.frombuffer(b"".join(packed), PACKED)
        order = np.argsort(records["gram"])
        gram = records["gram"][order]
        same = gram[1:] == gram[:-1]
        several = np.zeros(len(order), bool)
        several[1:] |= same
        several[:-1] |= same
        # a gram with one context is settled; one with several goes on with the first of each
        left, gone = _settled(records[order[several]])
        yield from rows(*(gone[k] for k in RANGES.names))
        left = left[np.argsort(left["gram"])]
        new = _fresh(left, ["gram"])
        number = np.cumsum(new) - 1
        contexts = np.bincount(number)[number] if len(left) else number
        left, contexts = left[contexts > 1], contexts[contexts > 1]
        start = left["place"].astype(np.int64) - left["before"]
        yield from rows(left["doc"], left["th"], start, start + left["after"] + SPAN, np.ascontiguousarray(left["gram"]), contexts > hot_contexts)


def _shards(batches):
    """(shard, values of its rows) of rows sorted by shard."""
    rows = ((shard, value) for batch in batches for shard, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for shard, group in itertools.groupby(rows, key=lambda row: row[0]):
        yield shard, [value for _, value in group]


def _contexts(batches):
    """(doc, th, text, wanted contexts) -> (gram, doc, th, start, bytes)."""
    for batch in batches:
        grams, docs, hashes, starts, texts = [], [], [], [], []
        for doc, th, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = (text or "").encode()
            for w in wanted:
                grams.append(w["gram"])
                docs.append(doc)
                hashes.append(th)
                starts.append(w["start"])
                texts.append(raw[w["start"] : w["stop"]])
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], names=["gram", "doc", "th", "start", "text"])


#: A string of a hot gram.
HASHED = np.dtype([("key", "<u8"), ("gram", "<i8"), ("doc", "<i8"), ("th", "<i8"), ("start", "<i8")])


def _firsts(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first string of each hash and gram, and the other strings with that hash (repeated rows left out)."""
    f = records[np.lexsort((records["start"], records["th"], records["doc"], records["gram"], records["key"]))]
    new = np.ones(len(f), bool)
    new[1:] = (f["key"][1:] != f["key"][:-1]) | (f["gram"][1:] != f["gram"][:-1])
    head = f[np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))] if len(f) else f
    again = ~new & ((f["doc"] != head["doc"]) | (f["th"] != head["th"]) | (f["start"] != head["start"]))
    return f[new], f[again]


def _covered(strings: np.ndarray) -> np.ndarray:
    """RANGES that strings cover."""
    doc, th, start, stop = _merged(strings["doc"], strings["th"], strings["start"], strings["start"] + SPAN)
    return _records(RANGES, doc=doc, th=th, start=start, stop=stop)


def _hot_hashed(batches, shards: int):
    """(doc, th, text, wanted contexts) of hot grams -> (shard, HASHED as bytes) of each batch's first
    strings, and with a shard below 0 the removed RANGES of the others."""
    for batch in batches:
        parts = []
        for doc, th, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            for w in wanted:
                part = raw[w["start"] : w["stop"]].astype(np.uint64) + np.uint64(1)
                up, down = _powers(len(part) + 1)
                total = np.concatenate([[np.uint64(0)], np.cumsum(part * up[:-1])])
                n = len(part) - SPAN + 1
                key = mix64((total[SPAN:] - total[:-SPAN]) * down[:n])
                parts.append(_records(HASHED, key=key, gram=w["gram"], doc=doc, th=th, start=w["start"] + np.arange(n)))
        if parts:
            first, again = _firsts(np.concatenate(parts))
            yield _batch(*_by_shard(first, (first["key"] % np.uint64(shards)).astype(np.int64)), _covered(again), shards)


def _hot_met(batches):
    """Rows sorted by shard -> removed ranges (doc, th, start, stop)."""
    for shard, packed in _shards(batches):
        if shard < 0:
            found = np.frombuffer(b"".join(packed), RANGES)
        else:
            found = _covered(_firsts(np.frombuffer(b"".join(packed), HASHED))[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in RANGES.names], names=list(RANGES.names))


def repeated_starts(texts: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every string of SPAN bytes in these contexts that starts earlier in another.

    One suffix array is induced over all contexts, 1 between them and bytes from 2 on.
    """
    size = np.array([len(x) for x in texts])
    t = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.uint16) + np.uint16(2)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    t[begin[1:] - 1] = 1
    sa = suffix_array(t, SPAN)
    lcp = permuted_lcp(t, sa, 2 * SPAN + 2 * (SPAN - GRAM) + 8, begin)
    owned = np.zeros(len(t), bool)
    context = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([begin, [len(t) + 1]])))[: len(t)]
    inside = np.arange(len(t)) - begin[context]
    owned = inside + SPAN <= size[context]
    klass = np.cumsum(lcp[sa] < SPAN)
    keep = owned[sa]
    at, klass = sa[keep], klass[keep]
    doc, start = docs[context[at]], starts[context[at]] + inside[at]
    order = np.lexsort((start, doc, klass))
    klass, doc, start = klass[order], doc[order], start[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], klass[1:] != klass[:-1]]), np.arange(len(klass)), 0)) if len(klass) else np.zeros(0, np.int64)
    gone = (doc != doc[head]) | (start != start[head])
    return doc[gone], start[gone]


def _joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that lie in or next to each other made one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    shift = doc << 32  # documents lie one after the other
    reach = np.maximum.accumulate(stop + shift) if len(doc) else stop
    first = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])[: len(doc)])
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], start[first], reach[last] - shift[last]


def _numbered(doc: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's document in the order of (doc, th), and doc and th of every number."""
    order = np.lexsort((th, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (th[order][1:] != th[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, doc[order][new], th[order][new]


def _merged(doc: np.ndarray, th: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """_joined, of documents by two columns."""
    number, docs, hashes = _numbered(doc, th)
    at, start, stop = _joined(number, start, stop)
    return docs[at], hashes[at], start, stop


def _induced(batches):
    """Rows sorted by gram -> removed ranges (doc, th, start, stop)."""
    held, total, here = [], 0, None

    def ranges():
        number, docs, hashes = _numbered(np.array([r[1] for r in held]), np.array([r[2] for r in held]))
        at, start = repeated_starts([r[4] for r in held], number, np.array([r[3] for r in held]))
        at, start, stop = _joined(at, start, start + SPAN)
        return pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(hashes[at]), pa.array(start), pa.array(stop)], names=["doc", "th", "start", "stop"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if row[0] != here and total >= BLOCK_BYTES:
                yield ranges()
                held, total = [], 0
            here = row[0]
            held.append(row)
            total += len(row[4]) + 1
    if held:
        yield ranges()


def _cut(batches, keep_text: bool):
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (text or "").encode()
            kept, end, spans = [], 0, 0
            for start, stop in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if start > end or not spans:
                    kept.append(raw[end:start])
                    spans += 1
                end = max(end, stop)
            kept.append(raw[end:])
            left = b"".join(kept)
            for column, value in zip(out, (len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left)):
                column.append(value)
        arrays = [batch.column(0)] + [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.string())] + ([pa.array(out[4], pa.binary())] if keep_text else [])
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)


def remove_repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes left, of every row."""
    slim = small_batches(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(n_partitions(docs), -(-total // SHARD_BYTES))
    packed = slim.mapInArrow(lambda batches: _anchored(batches, shards), "shard long, records binary")
    met = materialise(packed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lambda batches: _met(batches, hot_contexts), "doc long, th long, start long, stop long, gram long, hot boolean"))
    listed = F.collect_set(F.struct("start", "stop", "gram")).alias("wanted")
    texts = lambda which: slim.join(met.where(which).groupBy("doc", "th").agg(listed), ["doc", "th"]).select("doc", "th", "text", "wanted")
    parts = max(n_partitions(docs), shards)
    contexts = texts("gram is not null and not hot").mapInArrow(_contexts, "gram long, doc long, th long, start long, text binary")
    induced = contexts.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_induced, "doc long, th long, start long, stop long")
    removed = met.where("gram is null").select("doc", "th", "start", "stop").union(induced)
    if not met.where("hot and gram is not null").isEmpty():
        hashed = texts("gram is not null and hot").mapInArrow(lambda batches: _hot_hashed(batches, shards), "shard long, records binary")
        removed = removed.union(hashed.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_hot_met, "doc long, th long, start long, stop long"))
    gone = removed.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    kind = docs.schema[doc_id].dataType.simpleString()
    # the same columns by the same key as in the join above, so the texts are shuffled once for both
    rows = slim.join(gone, ["doc", "th"], "left").select(F.when(F.col("doc") != _LAST, F.col("doc")).cast(kind).alias("doc_id"), "text", "gone")
    return rows.mapInArrow(lambda batches: _cut(batches, keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
