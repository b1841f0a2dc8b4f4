"""Packing of tokenised documents into sequences of a fixed length.

Documents are dealt into groups at random (by a hash of the row, so independently of their order)
and each group is packed on its own by first-fit decreasing; the first bin with room is found in a
tournament tree of bin capacities. A document longer than a sequence is cut into full sequences
and one rest. Bins that stay under-filled are joined, cut at the sequence length, and their last
tokens are cut at powers of two, where a sequence needs no padding.

Memory: a task holds the tokens of one group, at most GROUP_TOKENS (or one document).

Defined cases: a null or empty text is a document of the end token alone. A null id is kept as
null. Repeated rows are packed as often as they occur. An empty table gives no rows. Documents of
equal length are ordered by the hash of their row. No texts are cut short.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.common import n_partitions, small_batches, tokenizer_file

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 4096
GROUP_TOKENS = 8_000_000
#: A bin with no more free tokens than this stays as it is.
SLACK = 8
#: Tokens that the vocabulary adds to its merges.
ADDED = {"<|endoftext|>": 50256}


class CapacityTree:
    """Tournament tree over bins: each node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1
        while self.width < max(1, bins):
            self.width *= 2
        self.best = [capacity] * (2 * self.width)

    def first_fit(self, size: int) -> int:
        """Take `size` from the leftmost bin that has room for it; its number."""
        best, node = self.best, 1
        while node < self.width:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        found = node - self.width
        while node > 1:
            node //= 2
            most = max(best[2 * node], best[2 * node + 1])
            if best[node] == most:
                break
            best[node] = most
        return found


def pack_lengths(lengths: list[int], capacity: int = SEQUENCE, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold documents of these lengths."""
    sequences, rests = [], []
    for doc, n in enumerate(lengths):
        full = n // capacity
        sequences += [[(doc, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            rests.append((doc, full * capacity, n % capacity))
    rests.sort(key=lambda piece: (-piece[2], piece[0]))
    tree, bins = CapacityTree(len(rests), capacity), []
    for piece in rests:
        at = tree.first_fit(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    loose = []
    for pieces in bins:
        used = sum(p[2] for p in pieces)
        if capacity - used <= slack or used & (used - 1) == 0:
            sequences.append(pieces)
        else:
            loose += pieces
    left = sum(p[2] for p in loose)
    pieces = iter(loose)
    doc, start, n = next(pieces, (0, 0, 0))
    while left:
        room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            take = min(room, n)
            sequence.append((doc, start, take))
            start, n, room = start + take, n - take, room - take
            if not n:
                doc, start, n = next(pieces, (0, 0, 0))
        sequences.append(sequence)
    return sequences


def byte_bpe_encoder(directory: str | None = None):
    """text -> ids of the byte-level vocabulary of 50k, in which an added token has its own id."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(tokenizer_file("byte_bpe_50k.tiktoken", directory), "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return lambda text: encoding.encode(text, allowed_special="all") if any(t in text for t in ADDED) else encoding.encode_ordinary(text)


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = SEQUENCE, end_id: int = END_ID, tokenizer_dir: str | None = None, with_ids: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids."""
    kind = docs.schema[doc_id].dataType
    arrow_kind = pa.from_numpy_dtype(np.int64) if kind.simpleString() == "bigint" else None

    def pack(batches):
        encode = byte_bpe_encoder(tokenizer_dir)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        keys, tokens, total = [], [], 0

        def flush():
            nonlocal sequence
            out: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for pieces in pack_lengths([len(t) for t in tokens], capacity):
                offset = 0
                for doc, start, n in pieces:
                    ids = tokens[doc][start : start + n]
                    row = [keys[doc], start, n, zlib.crc32(ids.tobytes()), len(tokens[doc]), sequence, offset]
                    for column, value in zip(out, row + [ids] if with_ids else row):
                        column.append(value)
                    offset += n
                sequence += 1
            arrays = [pa.array(out[0], arrow_kind) if arrow_kind else pa.array(out[0])] + [pa.array(c, pa.int64()) for c in out[1:7]]
            if with_ids:
                arrays.append(pa.array(out[7], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(value.as_py() or "")
                ids.append(end_id)
                if tokens and (len(tokens) >= GROUP_DOCS or total + len(ids) > GROUP_TOKENS):
                    yield flush()
                    keys, tokens, total = [], [], 0
                keys.append(key)
                tokens.append(np.array(ids, "<u4"))
                total += len(ids)
        if tokens:
            yield flush()

    dealt = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("doc_id", "text", F.lit(6)))
    dealt = dealt.repartition(partitions or n_partitions(docs), "h").sortWithinPartitions("h", "doc_id").select("doc_id", "text")
    return dealt.mapInArrow(pack, f"doc_id {kind.simpleString()}, {SCHEMA}" + ", ids array<int>" * with_ids)
