"""Secret scans: spans against plain versions, and the SQL on planted ones."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import string

import pytest
from conftest import rows_of

from terrazzo.llm import queries, secretscan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed: int = 3) -> list:
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64, word = string.ascii_letters + string.digits + "+/", "the river of lands é and stone ".split()
    texts = [None, "", " ", "ſecret=abcdefgh", "password == abcdef", "Api_Key':  \"" + some(b64, 12), "token: short", "AKIA" + some(string.ascii_uppercase, 15), "xAKIA" + some("A0Z", 16) + "a",
             "é" * 5 + some("0123456789abcdef", 40) + "g" + some("0123456789abcdef", 23), "sha256: " + some("0123456789abcdef", 20) + " " + some("0123456789ABCDEF", 20), some(b64, 400), "EXAMPLE" + some(b64, 30),
             "token=token=token=abcdefgh", "apikey\n=abcdefgh", "SECRET  =  'a.b=c-d_e/f+g'", "0" * 30 + some("0123456789abcdef", 30), "AKIAAKIA" + "Q7" * 9 + "AKIA", some("ABCDEF0123", 18), "commit " + some("0123456789abcdef", 18), "a" * 50_000 + some(b64, 30) + "b" * 50_000]
    for _ in range(60):
        parts = [rng.choice(word) if rng.random() < 0.7 else some(rng.choice((b64, "0123456789abcdef", "ABCDEF0123456789", string.ascii_uppercase + "0123456789")), rng.randint(10, 45)) for _ in range(rng.randint(1, 12))]
        texts.append("".join(p + rng.choice((" ", "\n", "-", "=", ": ", ", ")) for p in parts))
    return texts + texts[3:6]


def windows(run: str, size: int, bits: float, sorts: str) -> list[tuple[int, int]]:
    """Windows one by one, with their entropy from the definition."""
    is_a = {"d": str.isdigit, "a": str.isalpha, "u": str.isupper, "l": str.islower}
    hits = []
    for i in range(len(run) - size + 1):
        w = run[i : i + size]
        h = -sum(n / size * math.log2(n / size) for n in collections.Counter(w).values())
        if h >= bits and all(any(map(is_a[s], w)) for s in sorts):
            hits.append(i)
    covered = {x for i in hits for x in range(i, i + size)}
    spans = []
    for x in sorted(covered):
        if spans and spans[-1][1] == x:
            spans[-1][1] = x + 1
        else:
            spans.append([x, x + 1])
    return [tuple(s) for s in spans]


def plain(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    added = []
    for kind, c in secretscan.CLASSES.items():
        for m in re.finditer(f"[{c.chars}]+", text):
            before = text[max(0, m.start() - secretscan.CONTEXT) : m.start()]
            if re.search(secretscan.ALLOWED, m[0].lower()) or re.search(f"({secretscan.ALLOWED_BEFORE})\\Z", before.lower()):
                continue
            added += [(kind, m.start() + a, m.start() + b) for a, b in windows(m[0], c.window, c.bits, c.sorts)]
    order = list(secretscan.KINDS)
    kept = base + [s for s in added if not any(order.index(o[0]) < order.index(s[0]) and o[1] <= s[1] and s[2] <= o[2] for o in base + added)]
    return sorted(kept, key=lambda s: (s[1], order.index(s[0])))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in enumerate(planted())], DOCS).repartition(3).cache()


def test_spans_equal_the_plain_scan(docs):
    texts = planted()
    found = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.found] for r in secretscan.find_secrets(docs).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}
    assert {k for spans in found.values() for k, _, _ in spans} == set(secretscan.KINDS)


def test_secrets_are_the_text_of_their_spans(docs):
    texts = planted()
    assert all(s["secret"] == texts[r.doc_id][s["start"] : s["end"]] for r in secretscan.find_secrets(docs).collect() for s in r.found)


def test_digests_and_sql_on_planted_secrets(spark, docs, duck):
    rows = {r.doc_id: r for r in secretscan.digests(secretscan.find_secrets(docs)).collect()}
    for i, t in enumerate(planted()):
        base = [f"{k}:{a}:{b}" for k, a, b in plain(t) if k in secretscan.PATTERNS]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and rows[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t))
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(b.startswith(k) for b in base) for k in secretscan.PATTERNS]
    import duckdb

    own, documents = duckdb.connect(), docs.toPandas()
    own.register("documents", documents)
    assert rows_of(own.execute(queries.SECRET_SQL).df()) == rows_of(secretscan.digests(secretscan.find_secrets(docs)).toPandas())


def test_known_cases():
    scan = secretscan.Scanner().scan
    assert scan('x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == [("assign", 2, 51), ("hex", 11, 51)]
    assert scan("ſecret=abcdefgh toKen=abcdefgh") == [] and scan("password == abcdef") == []
    assert scan("key aB3dE5fG7hI9jK1lM2nO4pQ6 end") == [("entropy_base64", 4, 28)]
    assert scan("sha256: 9f86d081884c7d65") == [] and scan("n 9f86d081884c7d65") == [("entropy_hex", 2, 18)]
    assert secretscan.Scanner(allowed="9f86", allowed_before="never").scan("n 9f86d081884c7d65") == []


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], DOCS)
    assert secretscan.digests(secretscan.find_secrets(none)).count() == 0
    odd = spark.createDataFrame([("a", "secret=abcdef", [1], "x")], "doc_id string, text string, found array<int>, kind string")
    assert secretscan.digests(secretscan.find_secrets(odd)).first().spans == "assign:0:13"
