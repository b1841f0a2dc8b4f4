"""Secrets in texts: fixed patterns, and windows of high Shannon entropy in strings of few characters.

Patterns (kinds assign, access, hex) are matched from the left without overlap; a match that is too
short is dropped. The entropy kinds look at candidate strings, maximal runs of the characters of a
class. A window of the class's size slides over a candidate. Its counts change by the character that
enters and the one that leaves, and with them the sum of c*log2(c), kept in whole numbers, from which
the entropy follows. A window is a find if its entropy reaches the class's bits and each required
sort of character (digit, upper, lower) is in it; finds that overlap or touch are one span.

An allow-list suppresses entropy spans: candidates that hold a placeholder or a series, identifiers in
the form of a UUID, and candidates after a word that says digest (sha256, checksum, commit and so
on). Patterns are never suppressed. An entropy span inside a span of a pattern, or inside one of an
earlier class, says nothing new and is left out.

Places are code points from 0, ends exclusive. Letters are matched in ASCII alone, so neither the
Kelvin sign nor the long s is one. Defined cases: null and empty texts have no spans. Repeated rows
give repeated results. Long texts are read whole, in linear time. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.common import slices, small_batches

# Patterns of the kinds, the group whose length counts, and the least length.
PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),  # what [0-9a-f]+ matches, without its many short ones
}


class Entropy(NamedTuple):
    """Characters of a candidate, size of the window, least bits, and the sorts that a window must hold."""

    chars: str
    window: int
    bits: float
    sorts: str


#: In order: a span inside one of an earlier class is left out.
CLASSES = {
    "entropy_hex": Entropy("0-9A-Fa-f", 16, 2.9, "da"),
    "entropy_upper": Entropy("A-Z0-9", 16, 3.1, "da"),
    "entropy_base64": Entropy("A-Za-z0-9+/_-", 20, 3.8, "dul"),
}
KINDS = (*PATTERNS, *CLASSES)
#: Searched in candidates, and (then at the end) in the CONTEXT code points before them, both in lower case.
ALLOWED = r"example|sample|dummy|placeholder|changeme|redacted|xxxx|0123456789|abcdefgh|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOWED_BEFORE = r"""(sha-?(1|224|256|384|512)|md5|crc32|checksum|integrity|digest|commit|revision|etag|uuid)["'\x20\x09:=@/-]*"""
CONTEXT = 24
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Sorts of a character: d digit, a letter, u upper, l lower.
_SORTS = {c: "d" for c in string.digits} | {c: "al" for c in string.ascii_lowercase} | {c: "au" for c in string.ascii_uppercase}


def _weights(window: int) -> list[int]:
    return [round(c * math.log2(c) * 2**32) if c else 0 for c in range(window + 2)]


def dense_spans(run: str, size: int, bits: float, sorts: str, weights: list[int] | None = None) -> list[tuple[int, int]]:
    """Joined windows of a candidate that reach the entropy and hold all sorts."""
    weights = weights or _weights(size)
    most = math.floor(size * (math.log2(size) - bits) * 2**32)
    counts = dict.fromkeys(run, 0)
    held = dict.fromkeys("daul", 0)
    total, spans = 0, []
    for end, new in enumerate(run, 1):
        n = counts[new]
        total += weights[n + 1] - weights[n]
        counts[new] = n + 1
        for s in _SORTS.get(new, ""):
            held[s] += 1
        if end > size:
            old = run[end - size - 1]
            n = counts[old]
            total += weights[n - 1] - weights[n]
            counts[old] = n - 1
            for s in _SORTS.get(old, ""):
                held[s] -= 1
        if end >= size and total <= most and all(held[s] for s in sorts):
            if spans and end - size <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([end - size, end])
    return [(a, b) for a, b in spans]


class Scanner:
    """Spans of texts: (kind, start, end), by start and then as KINDS lists the kinds."""

    def __init__(self, patterns=PATTERNS, classes=CLASSES, allowed: str = ALLOWED, allowed_before: str = ALLOWED_BEFORE):
        self.patterns = [(kind, re.compile(p, re.ASCII | re.IGNORECASE if kind == "assign" else re.ASCII), group, least) for kind, (p, group, least) in patterns.items()]
        self.classes = [(kind, re.compile(f"(?<![{c.chars}])[{c.chars}]{{{c.window},}}"), c, _weights(c.window)) for kind, c in classes.items()]
        self.allowed = re.compile(allowed)
        self.before = re.compile(f"(?:{allowed_before})\\Z")

    def _patterns(self, text: str):
        for kind, pattern, group, least in self.patterns:
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    yield kind, m.start(), m.end()

    def _entropy(self, text: str):
        for kind, pattern, c, weights in self.classes:
            for m in pattern.finditer(text):
                run = m[0]
                held = {s for x in set(run) for s in _SORTS.get(x, "")}
                if not held.issuperset(c.sorts) or not (spans := dense_spans(run, c.window, c.bits, c.sorts, weights)):
                    continue
                at = m.start()
                if self.allowed.search(run.translate(_LOWER)) or self.before.search(text[max(0, at - CONTEXT) : at].translate(_LOWER)):
                    continue
                for a, b in spans:
                    yield kind, at + a, at + b

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        found = list(self._patterns(text))
        earlier = list(found)
        added = list(self._entropy(text))
        for kind in dict.fromkeys(s[0] for s in added):
            own = [s for s in added if s[0] == kind]
            earlier.sort(key=lambda s: s[1])
            starts, reach = [s[1] for s in earlier], list(accumulate((s[2] for s in earlier), max))
            found += [s for s in own if not ((i := bisect_right(starts, s[1])) and reach[i - 1] >= s[2])]
            earlier += own
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, found: every span of a row as (kind, start, end, secret), by start and then by kind.

    `options` are those of Scanner: the patterns, the classes, and what is allowed.
    """

    def scan(batches):
        scanner = Scanner(**options)
        for batch in batches:
            texts = batch.column(1)
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for first, last in slices(lengths, 4_000_000):
                rows = [t or "" for t in texts.slice(first, last - first).to_pylist()]
                found = [[{"kind": k, "start": a, "end": b, "secret": t[a:b]} for k, a, b in scanner.scan(t)] for t in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(found, FOUND)], names=["doc_id", "found"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, found array<struct<kind: string, start: long, end: long, secret: string>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the kinds, the hash of the patterns' spans and all spans, of what find_secrets gives."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda *kinds: F.size(F.filter("found", lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*PATTERNS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in PATTERNS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count(*CLASSES).alias("n_entropy"))
