"""The queries opN_<name>: thin contracts over the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm import bytededup, decontaminate, htmltext, langid, neardup, packing, phrases, secretscan, spelling, substring, tokencount, topk, toxicity
from terrazzo.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents contain which benchmark items. A null or empty text or item matches nothing."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies (three words, 0.85). A null or empty text is linked with nothing and kept."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of repeated strings of 100 bytes. A null text is empty; a text under 100 bytes loses nothing."""
    return bytededup.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents. A null or empty text scores as one without any known word."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy piece counts. A null or empty text has 0 words and 0 tokens."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. A null or empty text is a document of the end token alone."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest inner products of every 20th vector. Null, empty and non-finite vectors take no part."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages. A null or empty page gives an empty text."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated passages. A null or empty text stays as it is."""
    return substring.remove_repeats(table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents. A null text or one without a letter is und with score 0."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents. A null or empty text has none."""
    return secretscan.digests(secretscan.find_secrets(table(spark, sf_dir, "documents")))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language. A null or empty text has no words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, their near words and forms. A null or empty text has no words."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


TOP_K_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


DECONTAMINATION_SQL = r"""
WITH item AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE regexp_matches(text, '[\p{L}\p{N}]')),
doc AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')),
grams AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM item),
sized AS (SELECT item_id, shingle, count(*) OVER (PARTITION BY item_id) AS n_shingles FROM grams),
widths AS (SELECT DISTINCT width FROM grams),
held AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - width + 1, 0) + 1), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS shingle FROM doc, widths)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment FROM held JOIN sized USING (shingle)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 100 >= n_shingles * 80
"""


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM l UNION SELECT node, b FROM reach JOIN l ON a = seen),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
BYTE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
e AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z, b FROM spans),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front, max(b) AS last, count(*) AS n_spans, sum(b - a) AS n_removed FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""



#: Units, spans and their first places as the operator defines them; for scripts with white space.
SUBSTRING_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents), cut AS (SELECT doc_id, text, unnest(p) AS part, generate_subscripts(p, 1) AS n FROM (SELECT *, regexp_extract_all(text, '(?s).*?(?:[.!?,;:]+\s+|\n\s*|\z)') AS p FROM d)),
said AS (SELECT *, sum(CASE WHEN n = 1 OR trim(part, E' \t\n\r\f\x0B') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, text ORDER BY n) AS i FROM cut WHERE part <> ''),
unit AS (SELECT doc_id, text, i, string_agg(part, '' ORDER BY n) AS part FROM said GROUP BY doc_id, text, i),
word AS (SELECT *, list_filter(regexp_split_to_array(lower(part), '[\s\x0B]+'), lambda w: w <> '') AS w FROM unit),
led AS (SELECT doc_id, text, i, array_to_string(w, ' ') AS line, sum(len(w)) OVER o AS upto, sum(len(w)) OVER o - len(w) AS before FROM word WINDOW o AS (PARTITION BY doc_id, text ORDER BY i)),
pair AS (SELECT a.doc_id, a.text, a.i AS first, b.i AS last FROM led a JOIN led b ON b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.text = a.text AND b.i >= a.i AND b.upto - a.before >= 20 WHERE b.before - a.before < 20 OR b.upto - a.upto < 20),
span AS (SELECT p.doc_id, p.text, p.first, p.last, md5(string_agg(line, chr(10) ORDER BY i)) AS h FROM pair p JOIN led l ON l.doc_id IS NOT DISTINCT FROM p.doc_id AND l.text = p.text AND l.i BETWEEN p.first AND p.last GROUP BY ALL),
gone AS (SELECT doc_id, text, first, last FROM span QUALIFY rank() OVER (PARTITION BY h ORDER BY doc_id, first) > 1),
drops AS (SELECT DISTINCT doc_id, text, unnest(range(CAST(first AS BIGINT), CAST(last AS BIGINT) + 1)) AS i FROM gone),
left_over AS (SELECT u.doc_id, u.text, string_agg(CASE WHEN g.i IS NULL THEN part ELSE '' END, '' ORDER BY u.i) AS kept, count(*) AS n_units, count(g.i) AS n_removed FROM unit u LEFT JOIN drops g ON g.doc_id = u.doc_id AND g.text = u.text AND g.i = u.i GROUP BY u.doc_id, u.text)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN kept ELSE d.text END AS text, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(length(CASE WHEN n_removed > 0 THEN kept ELSE d.text END) AS INTEGER) AS n_chars
FROM documents d LEFT JOIN left_over l ON l.doc_id = d.doc_id AND l.text = d.text
"""


#: Patterns of the kinds, with the letters of `assign` in both cases, as RE2 would fold others too.
_ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_RUNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}"} | {k: f"[{c.chars}]{{{c.window},}}" for k, c in secretscan.CLASSES.items()}
_CUTS = " UNION ALL ".join(f"SELECT doc_id, {i} AS r, '{k}' AS kind, text, regexp_extract_all(text, '{p}') AS runs, regexp_split_to_array(text, '{p}') AS gaps FROM d" for i, (k, p) in enumerate(_RUNS.items()))
_HELD = {"d": "[0-9]", "a": "[A-Za-z]", "u": "[A-Z]", "l": "[a-z]"}
_DENSE = " OR ".join(f"kind = '{k}' AND list_entropy(string_split(w, '')) >= {c.bits} AND " + " AND ".join(f"regexp_matches(w, '{_HELD[s]}')" for s in c.sorts) for k, c in secretscan.CLASSES.items())
_SIZE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {c.window}" for k, c in secretscan.CLASSES.items()) + " END"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SECRET_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS ({_CUTS}),
run AS (SELECT doc_id, r, kind, text, unnest(runs) AS run, unnest(list_transform(range(1, len(runs) + 1), lambda i: CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(runs[1:i - 1], lambda g: length(g))), 0) AS BIGINT))) AS a FROM cut WHERE len(runs) > 0),
base AS (SELECT doc_id, r, kind, a, a + length(run) AS b FROM run WHERE kind = 'assign' AND length(regexp_extract(run, '{_ASSIGN}', 2)) >= 6 OR kind = 'access' AND length(run) >= 20 OR kind = 'hex' AND length(run) >= 24),
cand AS (SELECT doc_id, r, kind, run, a, {_SIZE} AS size FROM run WHERE r > 2 AND length(run) >= {_SIZE}
  AND NOT regexp_matches({_LOWERED.format("run")}, '{secretscan.ALLOWED}') AND NOT regexp_matches({_LOWERED.format(f"substr(text, greatest(a - {secretscan.CONTEXT}, 0) + 1, least(a, {secretscan.CONTEXT}))")}, '(?:{secretscan.ALLOWED_BEFORE.replace("'", "''")})\z')),
win AS (SELECT doc_id, r, kind, a, size, i, substr(run, i + 1, size) AS w FROM (SELECT *, unnest(range(0, length(run) - size + 1)) AS i FROM cand)),
hit AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, r, a ORDER BY i) + size THEN 0 ELSE 1 END AS fresh FROM win WHERE {_DENSE}),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, r, a ORDER BY i) AS g FROM hit),
dense AS (SELECT doc_id, r, kind, a + min(i) AS a, a + max(i) + size AS b FROM isle GROUP BY doc_id, r, kind, size, isle.a, g),
either AS (SELECT * FROM base UNION ALL SELECT * FROM dense),
kept AS (SELECT * FROM base UNION ALL SELECT * FROM dense e WHERE NOT EXISTS (SELECT 1 FROM either o WHERE o.doc_id = e.doc_id AND o.r < e.r AND o.a <= e.a AND o.b >= e.b)),
told AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (r > 2) AS n_entropy,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) FILTER (r <= 2), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM documents LEFT JOIN told USING (doc_id)
"""


COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
words AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
k AS (SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(k.a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score FROM k
  JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + z - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2))),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.lang = low.lang AND part.phrase = low.phrase AND 100 * CAST(part.a AS HUGEINT) >= 80 * CAST(low.a AS HUGEINT)))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""


#: crc32 bit by bit over the bytes of UTF-8, which the letters of runs have one or two of.
SPELLING_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) AS h FROM b),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS z FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, z, i, left(word, i) || substr(word, i + 2) AS less, word[i + 1] AS letter FROM (SELECT *, unnest(range(0, z)) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.letter <> b.letter
  UNION SELECT a.word, b.word FROM v a JOIN x b ON a.word = b.less UNION SELECT b.word, a.word FROM v a JOIN x b ON a.word = b.less),
best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, encode(other)) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * CAST(v.n AS HUGEINT) THEN form END AS form, CASE WHEN form_n >= 5 * CAST(v.n AS HUGEINT) THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN f ON f.word = root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_spelling_variants": SPELLING_SQL, "op12_phrase_collocations": COLLOCATION_SQL, "op11_secret_scan": SECRET_SQL, "op9_substring_dedup": SUBSTRING_SQL, "op2_minhash_near_dedup": NEAR_DEDUP_SQL, "op3_suffix_array_dedup": BYTE_DEDUP_SQL, "op1_decontamination": DECONTAMINATION_SQL, "op7_exact_top_k": TOP_K_SQL}
