"""Numbers of greedy word pieces, by one linear pass over an automaton.

The vocabulary is a trie over bytes. A node whose string is a piece fails to the root and pops one
piece; any other node fails to the node of what the longest pieces at its start leave over, and
holds how many they are. Reading a word therefore adds counts and never builds a piece.

Words are the pre-tokens of the byte-level tokenizer; every byte is a piece, so each word has one
greedy longest-match split. Defined cases: null and empty texts have 0 words and 0 pieces. Long
words are read whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.common import small_batches, tokenizer_file

CACHE_WORDS = 500_000


class PieceCounter:
    """Greedy longest-match piece counts of words over a vocabulary that has every byte."""

    def __init__(self, vocabulary):
        child: dict[int, int] = {}
        parent, last, piece = [0], [0], [False]
        for token in vocabulary:
            node = 0
            for c in token:
                key = node << 8 | c
                if key not in child:
                    child[key] = len(parent)
                    parent.append(node)
                    last.append(c)
                    piece.append(False)
                node = child[key]
            piece[node] = True
        fail, popped = [-1] * len(parent), [0] * len(parent)
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if piece[v]:
                fail[v], popped[v] = 0, 1
                continue
            z, count = fail[parent[v]], popped[parent[v]]
            while z >= 0 and z << 8 | last[v] not in child:
                count += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = child[z << 8 | last[v]], count
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for c in word:
            while (step := child.get(node << 8 | c)) is None:
                total += popped[node]
                node = fail[node]
            node = step
        while node:
            total += popped[node]
            node = fail[node]
        return total


def byte_vocabulary(directory: str | None = None) -> list[bytes]:
    with open(tokenizer_file("byte_bpe_50k.tiktoken", directory), "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer_dir: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every row."""

    def count(batches):
        import public_tokenizers

        split = regex.compile(public_tokenizers.PATTERN).findall
        pieces = PieceCounter(byte_vocabulary(tokenizer_dir))
        cache: dict[str, int] = {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                words = split(text) if text else []
                cache.update([(w, pieces.count(w.encode())) for w in set(words) if w not in cache])
                n_words.append(len(words))
                n_tokens.append(sum(map(cache.__getitem__, words)))
                if len(cache) > CACHE_WORDS:
                    cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
