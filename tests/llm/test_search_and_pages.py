"""Top-k search, HTML extraction, suffix arrays, components, the pipeline and its registry."""

from __future__ import annotations

import os

import numpy as np
import pytest

from terrazzo.llm import boost, dom, graph, htmltext, suffix, topk

TEXT = "The quick brown fox jumps over the lazy dog, and then it rests under the old tree. It was a long day for everyone in the matter."


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(300):
        t = rng.integers(1, rng.integers(2, 6) + 1, rng.integers(1, 60))
        t = np.ones(len(t), int) if trial % 5 == 0 else np.tile(t, 3) if trial % 7 == 0 else t
        s = t.tolist()
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = suffix.permuted_lcp(t.astype(np.uint16), sa, 1000)
        for a, b in zip(sa[:-1], sa[1:]):
            want = 0
            while want < len(s) - max(a, b) and s[a + want] == s[b + want]:
                want += 1
            assert lcp[b] == want


def test_truncated_suffix_arrays_sort_the_depth():
    t = np.tile(np.random.default_rng(2).integers(1, 4, 50), 40)
    s = t.tolist()
    sa = suffix.suffix_array(t, 20)
    keys = [tuple(s[i : i + 20]) for i in sa]
    assert keys == sorted(keys) and sorted(sa) == list(range(len(s)))


@pytest.mark.parametrize("in_task", [0, 10**6])
def test_components_of_a_star_and_a_path(spark, in_task):
    edges = [(0, i) for i in range(1, 50)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3), (0, 1)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), in_task=in_task).collect()}
    assert got == {i: 0 for i in range(50)} | {i: 100 for i in range(100, 141)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), in_task=in_task).count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(8)
    for trial in range(3):
        edges = rng.integers(0, 80, (60, 2)).tolist()
        label = list(range(80))
        for _ in range(80):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        want = {x: label[x] for e in edges if e[0] != e[1] for x in e}
        for in_task in (0, 10**6):
            got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4), in_task=in_task).collect()
            assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


VECTORS = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    ok = {}
    for key, v in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        if all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(key, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int))
    out = set()
    for q, v in ok.items():
        if q % every == 0:
            scored = sorted((-int(v @ w), i) for i, w in ok.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shard", [40, 100_000])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in (rng.normal(size=6) if i % 5 else np.round(rng.normal(size=6)))]) for i in range(300)]
    rows += [(300, [0.0] * 6), (320, [0.0] * 6), (340, None), (360, [float("nan")] * 6), (380, [None, 1.0]), (400, []), (None, [1.0] * 6), (420, [1.0, 2.0]), (421, [1.0, 0.5])]
    found = topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), 20, 20)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()} == brute(rows, 20, 20)


def test_top_k_of_few_rows(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    rows = topk.top_k(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (3, [2.0])], VECTORS)).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 1, 3, 64 * 128), (0, 2, 3, 64 * 128)]  # either row of id 0 asks


def test_balls_hold_their_rows():
    tree = topk.BallTree(np.random.default_rng(0).integers(-50, 50, (500, 5)), 16)
    for centre, radius, children, members in tree.nodes:
        if children is None:
            assert np.sqrt(((tree.rows[members] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
    assert sorted(i for n in tree.nodes for i in n[3]) == list(range(500))


def test_boosted_trees_learn_a_product():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = boost.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.logit(x[1500:]) > 0) == y[1500:]).mean() > 0.9


def test_trees_split_where_the_gain_is_greatest():
    """The first tree of depth 1 against every cut of every feature; leaves by Newton's step."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    y[x[:, 1] > 4] = 1
    model = boost.BoostedTrees(trees=1, depth=1, rate=1.0, l2=1.0).fit(x, y)
    mean = y.mean()
    g, h = mean - y, np.full(200, mean * (1 - mean))
    value = lambda side: g[side].sum() ** 2 / (h[side].sum() + 1)
    best = max((value(x[:, j] <= cut) + value(x[:, j] > cut), j, cut) for j in range(3) for cut in range(8))
    side = x[:, best[1]] <= best[2]
    leaf = lambda s: -g[s].sum() / (h[s].sum() + 1)
    assert model.logit(x) == pytest.approx(np.log(mean / (1 - mean)) + np.where(side, leaf(side), leaf(~side)))


def test_dom_tolerates_broken_pages():
    cases = {
        "<p>a<p>b <b>c</b>d": "a b cd",
        "a &amp; &lt;b&gt; &#8364;&nbsp;x": "a & <b> € x",
        "<ul><li>1<li>2</ul>3": "1 2 3",
        "<script>var a='<p>no</p>'</script>yes<style>x{}</style>": "yes",
        "<div title='a>b'>x</div></div></span>y": "x y",
        "<!-- <p>no</p> -->z<br>w": "z w",
        "1 < 2 <3": "1 < 2 <3",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
        "<TITLE>t</TITLE><P CLASS=x>P</P>": "P",
        "<script>never closed": "",
    }
    for page, text in cases.items():
        assert dom.render(dom.parse(page), lambda v: True) == text, page


@pytest.fixture(scope="module")
def model(spark, data):
    return htmltext.train(spark.read.parquet(f"{data}/pages.parquet"))


def test_main_text_of_several_layouts(model):
    pages = [
        f"<body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{TEXT}</p><aside>Related things</aside><p>{TEXT}</p></article><footer>Imprint</footer></body>",
        f"<body><div class=topbar>Site</div><div id=sidebar><h3>Popular</h3><ul><li><a href=x>one</a></ul></div><div class=entry><h1>Head</h1><p>{TEXT}<p>{TEXT}</div><div class=comments><p>Nice post indeed.</p><p>{TEXT}</p></div></body>",
        f"<body><main><h1>Head</h1><p>{TEXT}</p><form><label>Mail</label><button>Send</button></form><p>{TEXT}</p></main><div class='cookie-notice'>We use cookies.</div></body>",
    ]
    assert htmltext.main_texts(pages, model) == [f"Head {TEXT} {TEXT}"] * 3


def test_given_pages_are_extracted_whole(spark, data, model):
    import html
    import re

    found = htmltext.extract(spark.read.parquet(f"{data}/pages.parquet"), model=model).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{data}/pages.parquet").toPandas().set_index("page_id")
    for i, page in pages.html.items():
        inner = re.search(r"<article>(.*?)(</article>|<footer)", page, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)>", " ", inner))).split())
        assert found.text[i] == text and found.n_chars[i] == len(text)


def test_decoding_equals_the_best_of_all_choices():
    """Against every choice of nodes in which no kept node lies in a dropped one and no kept block is empty."""
    rng = np.random.default_rng(0)
    for page in ("<div><p>a</p><div><p>b</p><p>c</p></div></div>", "a<p>b</p>c", "<p>a</p><ul><li>b<li>c</ul>"):
        nodes = dom.walk(dom.parse(page))
        up = {i: nodes.index(v.parent) for i, v in enumerate(nodes) if v.parent is not None}
        for _ in range(40):
            logit = rng.normal(size=len(nodes)) * 3
            best, runs = 0.0, set()
            for bits in range(1, 2 ** len(nodes)):
                kept = {i for i in range(len(nodes)) if bits >> i & 1}
                blocks = {i for i in kept if nodes[i].tag != "#text"}
                if all(up[i] in kept for i in kept if i) and blocks <= {up[i] for i in kept if i} and logit[list(kept)].sum() > best:
                    best, runs = logit[list(kept)].sum(), {id(nodes[i]) for i in kept - blocks}
            assert htmltext.decode(nodes, logit) == runs


def test_formulas_and_plain_text_elements_are_kept():
    text = lambda page: dom.render(dom.parse(page), lambda v: True)
    assert text("<p>Energy is <math><mi>E</mi></math> and <svg><desc>no</desc><text>label</text></svg> done</p>") == "Energy is E and label done"
    assert text("a<xmp><b>&amp;</b></xmp>c <object data=x>d</object>") == "a <b>&amp;</b> c d"
    assert text("<p><math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>tex</annotation></math>.</p>") == "E=m."


def test_reading_time_grows_with_the_page():
    """Pages of stray and unclosed tags: ten times the page takes far less than a hundred times the time."""
    import time

    def seconds(n):
        pages = ["<div>" * n + "</p>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<div>" * n + "<p></p>" * n, '<a "' * n, "<li>" * n + "</ul>" * n, "<a '\">" * n]
        began = time.process_time()
        for page in pages:
            dom.parse(page)
        return time.process_time() - began

    seconds(500)
    assert seconds(20_000) < 40 * seconds(2000) + 0.5


def test_labels_come_from_elements_and_recurrence():
    """A token that no list knows becomes a mark, as its texts recur; in an article it then marks others."""
    own = lambda i: f"<article><p>Text number {i} of its own.</p><div class=qqx>Offer {i}.</div></article>"
    pages = [f"<body><div class=qqx>Buy our things now.</div><div>Site {i}</div>{own(i)}<nav>Menu {i}</nav></body>" for i in range(60)]
    nodes = [dom.walk(dom.parse(p)) for p in pages]
    known = htmltext.Known(nodes)
    assert known.marks == set() and known.repeated == {"Buy our things now."}  # it marks as many main texts
    nodes = [dom.walk(dom.parse(p if i < 3 else p.replace(f"<div class=qqx>Offer {i}.</div>", ""))) for i, p in enumerate(pages)]
    known = htmltext.Known(nodes)
    assert known.marks == {"qqx"}
    assert [known.label(v) for v in nodes[0] if v.tag == "#text"] == [0, None, 1, 0, 0]


def test_tables_without_any_known_part(spark):
    """Pages that say nothing of their parts, and none at all, still give a model."""
    words = TEXT.split()
    texts = [" ".join(words[(7 * i + j * (i + 2)) % len(words)] for j in range(60)) for i in range(3)]
    rows = [(i, "u", f"<html><body><p>{t}</p><p>{i} {t}</p></body></html>") for i, t in enumerate(texts)]
    rows += [(10 + i, "u", rows[0][2]) for i in range(5)]  # copies of a page say nothing
    found = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: f"{t} {i} {t}" for i, t in enumerate(texts)} | {10 + i: f"{texts[0]} 0 {texts[0]}" for i in range(5)}
    model = htmltext.fit([])
    assert htmltext.main_texts([rows[0][2], f"<nav><a href=x>Home</a></nav><article><p>{TEXT}</p></article><footer>Imprint</footer>"], model) == [f"{texts[0]} 0 {texts[0]}", TEXT]


def test_extraction_of_odd_tables(spark, model):
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<p></p>")], "page_id long, url string, html string")
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(rows, model=model).collect()} == {(1, "", 0), (2, "", 0), (None, "", 0)}
    assert htmltext.extract(rows.limit(0)).count() == 0


def test_queries_and_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(k[2:].split("_")[0]) for k in names if k.startswith("op") and k[2].isdigit()} == set(range(1, 14)) and "pipeline" in names


STAGE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, at string, th int, gone string, n_removed long, kept_id long, bad_id long, h long, row string"


def test_pipeline_stages_keep_columns_and_clean_documents(spark, data, tmp_path):
    import corpus_pipeline

    base = spark.read.parquet(f"{data}/documents.parquet").toPandas()[["doc_id", "text", "lang", "source", "n_chars"]]
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars), 1, "a", 2, "g", 3, 4, 5, 6, "r") for r in base.itertuples()]
    rows += [(10**6, None, None, None, None, *[None] * 9), (10**6 + 1, "", None, None, 0, *[None] * 9), (None, base.text[3] + " more", None, None, 0, *[None] * 9), rows[5]]
    docs = spark.createDataFrame(rows, STAGE_DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        path = str(tmp_path / name)
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        docs = spark.read.parquet(path)
    assert docs.count() > 100
    empty = spark.createDataFrame([], STAGE_DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_pipeline_decisions_equal_brute_force(spark, data):
    """Each stage against its definition on what the stage before kept."""
    import corpus_pipeline
    import public_tokenizers
    from test_text_operators import contained, linked, without_repeats
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    listed = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, data)
    before = listed(known)
    assert {r[0] for r in before} == {r[0] for r in listed(docs) if any(c.isalpha() for c in r[1] or "")}
    lone = listed(stages["near_dedup"](spark, known, data))
    assert {r[0] for r in lone} == set(linked(before, 5, 80)[0].values())
    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    cut = listed(stages["substring_dedup"](spark, spark.createDataFrame(lone, schema), data))
    want = without_repeats([(r[0], r[1] or "") for r in lone])
    assert sorted(cut) == sorted((r[0], want[r[0], r[1] or ""][0] if r[1] else r[1], r[2], r[3], len(want[r[0], r[1]][0]) if r[1] and want[r[0], r[1]][2] else r[4]) for r in lone)
    assert any(r[1] != s[1] for r, s in zip(sorted(lone), sorted(cut)))
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    clean = listed(stages["decontamination"](spark, spark.createDataFrame(cut, schema), data))
    assert {r[0] for r in clean} == {r[0] for r in cut} - {k for k, *_ in contained(cut, items)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in stages["packing"](spark, spark.createDataFrame(clean, schema), data).collect():
        pieces.setdefault(r["doc_id"], {})[r["start"]] = list(r["ids"])
        sequences.setdefault(r["sequence_id"], {})[r["offset"]] = r["length"]
    assert {k: [i for s in sorted(p) for i in p[s]] for k, p in pieces.items()} == {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in clean}
    assert all(sum(s.values()) <= 2048 and all(sum(n for o, n in s.items() if o < at) == at for at in s) for s in sequences.values())


def test_llm_is_not_imported_elsewhere():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "terrazzo")):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    assert "terrazzo.llm" not in open(os.path.join(folder, name)).read()
