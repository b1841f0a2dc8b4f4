"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

Every block and text run of a page gets features of its subtree (length, density, links,
punctuation), its tags and attribute tokens, those above it, its depth and its siblings. The trees
give each node the log-odds that its subtree holds main text. Decoding maximises the sum over
nodes under two constraints, so choices can't contradict each other: below a dropped node all is
dropped, and a kept block keeps something below it.

Training is on a bounded sample: about TRAIN_PAGES pages, the least hashes of their ids. No list
of words labels a text. A text is main text if its page puts it into an <article> or <main>, and
isn't if it lies in an element for navigation, forms, asides and the like, is hidden, or recurs on
REPEATED_PAGES pages of the sample outside of any main part. Attribute tokens that mark such texts,
and hardly ever main text, are marks of what isn't main text inside an article too. The texts so
known are laid out anew in the skeletons below (of each LAID_OUT_CHARS characters at most), so that
parts are also known by place and shape. Main text there holds lists, tables, quotes, captions and code
too, and some pages are nothing but main text. The skeletons' parts carry words that are features (such
as sidebar), so what those words mostly mark is taught by hand to that extent.

Defined cases: null and empty pages give an empty text. A table that says nothing of its pages is
read by what the skeletons teach, filled with the pages' texts or, without any, with made-up words.
Repeated rows give repeated results. Pages are read whole.
"""

from __future__ import annotations

import html as entities
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.boost import BoostedTrees
from terrazzo.llm.common import slices, small_batches
from terrazzo.llm.dom import Node, parse, render, walk

TRAIN_PAGES = 300
TRAIN_CHARS = 200_000
#: A text on so many pages of the sample recurs; a token on so many of them can be a mark.
REPEATED_PAGES = 3
MARK_PAGES = 5
#: Pages laid out anew, where the sample has fewer.
LEAST_LAID_OUT = 100
#: Characters of pages that are read together (a longer page alone).
SLICE_CHARS = 1_500_000
#: Characters of a text that is laid out anew, for training alone.
LAID_OUT_CHARS = 2000

#: Attribute tokens by what they usually mark.
TOKENS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc",
    "head": "header masthead topbar logo",
    "foot": "footer foot copyright legal",
    "side": "sidebar aside side rail widget related recommended recommendations trending popular",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup gdpr banner",
    "form": "form search login register contact",
    "comment": "comment comments reply replies respond discussion disqus feedback",
    "social": "share sharing social follow",
    "good": "article content post entry story main body text",
}
#: Groups of tokens are features; they label nothing.
GROUP_OF = {t: i for i, words in enumerate(TOKENS.values()) for t in words.split()}
N_GROUPS = len(TOKENS)
BOILER_TAGS = frozenset("nav aside footer form menu dialog button fieldset label".split())
MAIN_TAGS = frozenset(("article", "main"))
TAG_KIND = {t: i for i, tags in enumerate(("#text", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd", "div section span figure figcaption center", "table tbody thead tr td th", "article main", "nav aside footer header form menu dialog button fieldset")) for t in tags.split()}
N_KINDS = 9

SKELETONS = (
    "<body><div class='header {0}'>{b}</div><div class='menu {0}'><ul>{li}</ul></div><div id='content' class='{1}'>{h}{p}</div><div class='sidebar {0}'>{b}</div><div class='comments {0}'>{c}</div><div class='footer {0}'>{b}</div></body>",
    "<body><header class='{0}'>{b}</header><main class='{1}'>{h}{p}</main><aside class='{0}'>{b}<ul>{li}</ul></aside><form class='{0}'>{b}</form><section class='comments {0}'>{c}</section><footer class='{0}'>{b}</footer></body>",
    "<body><div class='cookie-notice {0}'>{b}</div><nav class='{0}'>{li}</nav><div class='post {1}'>{h}{p}<div class='ad {0}'>{b}</div>{p}</div><div class='related {0}'>{li}</div><footer class='{0}'>{b}</footer></body>",
    "<body><div class='{0}'><ul>{li}</ul></div><div class='{1}'>{h}{p}</div><div class='{0}'><ul>{li}</ul></div><div class='{0}'>{b}</div></body>",
    "<body><nav class='{0}'><ul>{li}</ul></nav><article class='{1}'>{h}{p}<div class='share {0}'>{li}</div><aside class='{0}'>{b}</aside>{p}<div class='newsletter-signup {0}'><form>{b}</form></div></article><div id='comments' class='{0}'>{c}</div><footer class='{0}'>{b}</footer></body>",
    "<body><table><tr><td class='{0}'>{li}</td><td class='{1}'>{h}{p}</td></tr></table><div class='{0}'>{b}</div></body>",
    "<body><div class='topbar {0}'>{b}</div><div id='sidebar' class='{0}'><h3>{t2}</h3><ul>{li}</ul><h3>{t2}</h3>{b}</div><div class='entry {1}'>{h}{p}</div><div class='comments {0}'><h2>{t2}</h2>{c}</div></body>",
    "<body><article class='{1}'><header>{h}</header>{p}<section>{p}</section><footer class='{0}'>{b}</footer></article><section class='{0} comments'>{c}</section><div class='popup {0}'>{b}</div></body>",
    "<body><article class='{1}'>{h}{p}<div class='ad {0}'>{b}</div>{p}<div class='promo {0}'>{b}</div></article><footer class='{0}'>{b}</footer></body>",
)
#: Pages that are nothing but main text.
BARE = ("<html><body>{h}{p}</body></html>", "{p}", "<div>{p}</div>", "{t}", "<body>{t}</body>", "<div>{d}</div>", "<body><div>{d}{l}</div></body>", "<body><section>{h}{d}</section><section>{l}{p}</section></body>")
#: What main text holds besides paragraphs: lists, tables, quotes, captions, code and headings; {} is a text, {s} a short one.
RICH = ("<ul>{li}</ul>", "<ol>{li}</ol>", "<dl><dt>{s}</dt><dd>{}</dd></dl>", "<table><tr><td>{s}</td><td>{s}</td></tr><tr><td>{s}</td><td>{s}</td></tr></table>", "<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<figure><img src='#'><figcaption>{s}</figcaption></figure>", "<pre>{s}</pre>", "<pre><code>{s}\n{s}</code></pre>", "<h2>{s}</h2><p>{}</p>", "<div>{}</div>", "<div>{s}</div>")
#: Share of runs of paragraphs with some of these among them.
RICH_SHARE = 0.4
#: Tokens that no feature looks at; they carry the labels of the skeletons.
DROP, KEEP = "zzdrop", "zzkeep"


class Known:
    """What a sample of pages tells about its texts: which recur, and which tokens mark them."""

    def __init__(self, pages: list[list[Node]]):
        self.repeated: set[str] = set()
        self.marks: set[str] = set()
        seen, kept, lost = Counter(), Counter(), Counter()
        for nodes in pages:
            texts = {_plain(v) for v in nodes if v.tag == "#text"}
            if sum(len(t) for t in texts if seen[t]) * 2 < sum(map(len, texts)):  # copies of a page count once
                seen.update(texts)
        self.repeated = {t for t, n in seen.items() if n >= REPEATED_PAGES}
        for nodes in pages:
            tokens: tuple[set, set] = set(), set()
            for v in nodes:
                if v.tag == "#text" and (y := self.label(v)) is not None:
                    tokens[y].update(*(u.tokens for u in _above(v)))
            lost.update(tokens[0])
            kept.update(tokens[1])
        self.marks = {t for t, n in lost.items() if n >= MARK_PAGES and kept[t] * 10 <= n}

    def label(self, run: Node, otherwise: int | None = None) -> int | None:
        """1 or 0 where it is known whether a text run is main text, else `otherwise`."""
        above = list(_above(run))
        main = [v.tag in MAIN_TAGS for v in above]
        for i, v in enumerate(above):
            if KEEP in v.tokens or DROP in v.tokens:
                return int(KEEP in v.tokens)
            if v.tag in BOILER_TAGS or v.hidden or not self.marks.isdisjoint(v.tokens) or v.tag == "header" and not any(main[i:]):
                return 0
        return 1 if any(main) else 0 if _plain(run) in self.repeated else otherwise


def _plain(run: Node) -> str:
    return " ".join(run.text.split())


def _above(node: Node):
    """The elements around a node, the innermost first."""
    while (node := node.parent) is not None:
        yield node


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for every node of a page, in the order of walk()."""
    n = len(nodes)
    at = {id(v): i for i, v in enumerate(nodes)}
    own = np.zeros((n, 5))  # chars, link chars, words, punctuation, runs
    tags = np.ones(n)
    headings = np.zeros(n)
    for i, v in enumerate(nodes):
        if v.tag == "#text":
            own[i] = len(v.text), v.link_chars, len(v.text.split()), sum(map(v.text.count, ".,;:!?")), 1
        headings[i] = v.tag in ("h1", "h2", "h3")
    before = np.concatenate([[0], np.cumsum(own[:, 0])[:-1]])
    for i in range(n - 1, 0, -1):
        up = at[id(nodes[i].parent)]
        own[up] += own[i]
        tags[up] += tags[i]
        headings[up] += headings[i]
    page = max(1.0, own[0, 0])
    depth = np.zeros(n)
    above = np.zeros((n, N_GROUPS + 4))  # token groups; main, boiler, header, hidden
    out = np.zeros((n, 18 + 2 * N_KINDS + N_GROUPS + above.shape[1]), np.float32)
    for i, v in enumerate(nodes):
        up = at[id(v.parent)] if v.parent is not None else i
        if i:
            depth[i] = depth[up] + 1
            above[i] = above[up]
        mine = np.zeros(N_GROUPS)
        for t in v.tokens:
            if t in GROUP_OF:
                mine[GROUP_OF[t]] = 1
        above[i, :N_GROUPS] = np.maximum(above[i, :N_GROUPS], mine)
        above[i, N_GROUPS] += v.tag in MAIN_TAGS
        above[i, N_GROUPS + 1] += v.tag in BOILER_TAGS
        above[i, N_GROUPS + 2] += v.tag == "header"
        above[i, N_GROUPS + 3] += v.hidden
        chars, links, words, marks, runs = own[i]
        row = out[i]
        row[:10] = depth[i], math.log1p(chars), links / max(1, chars), chars / tags[i], marks / max(1, words), math.log1p(words), chars / page, before[i] / page, chars / max(1, runs), headings[i] > 0
        row[10], row[11] = chars / max(1, own[up, 0]), math.log1p(runs)
        row[18 + TAG_KIND.get(v.tag, N_KINDS - 1)] = 1
        row[18 + N_KINDS + TAG_KIND.get(v.parent.tag if v.parent is not None else "", N_KINDS - 1)] = 1
        row[18 + 2 * N_KINDS : 18 + 2 * N_KINDS + N_GROUPS] = mine
        kin = [at[id(c)] for c in v.children]
        for k, j in enumerate(kin):
            out[j, 12:18] = k, len(kin), math.log1p(own[kin[k - 1], 0]) if k else -1, math.log1p(own[kin[k + 1], 0]) if k + 1 < len(kin) else -1, sum(nodes[x].tag == nodes[j].tag for x in (kin[max(0, k - 5) : k + 6])) / min(11, len(kin)), k / len(kin)
    out[:, 18 + 2 * N_KINDS + N_GROUPS :] = above
    return out


def labels(nodes: list[Node], known: Known, otherwise: int | None = None) -> np.ndarray:
    """1, 0 or -1 (unknown) for every node: a block holds main text if any run below it does."""
    at = {id(v): i for i, v in enumerate(nodes)}
    out = np.full(len(nodes), -1)
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].tag == "#text":
            label = known.label(nodes[i], otherwise)
            out[i] = -1 if label is None else label
        if i and out[i] >= 0:
            up = at[id(nodes[i].parent)]
            out[up] = max(out[up], out[i])
    return out


def _made_up(rng: random.Random, words: int) -> str:
    text = " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(words))
    return f"{text.capitalize()}."


def _clean(text: str) -> str:
    """Text without the brackets of the skeletons."""
    return text.replace("{", "(").replace("}", ")")


def _laid_out(pages: list[list[Node]], known: Known, count: int, seed: int, skeletons: tuple[str, ...] = SKELETONS) -> list[str]:
    """`count` pages with the parts of the given ones in other skeletons: their known main and other
    texts; without any, their longer and shorter texts; without any, made-up words."""
    rng = random.Random(seed)
    runs = [(_plain(v), known.label(v)) for nodes in pages for v in nodes if v.tag == "#text"]
    main, rest = ([t for t, y in runs if y == want] for want in (1, 0))
    main = main or [t for t, _ in runs if len(t) >= 80] or [" ".join(_made_up(rng, rng.randint(4, 25)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rest = rest or [t for t, _ in runs if len(t) < 80] or [_made_up(rng, rng.randint(1, 8)) for _ in range(60)]
    main, rest = ([entities.escape(t, quote=False)[:LAID_OUT_CHARS] for t in side] for side in (main, rest))

    def some(source, low, high, wrap):
        return "".join(wrap.format(rng.choice(source)) for _ in range(rng.randint(low, high)))

    def short(source):
        return [" ".join(x.split()[: rng.randint(2, 25)]) for x in source]

    made, brief = [], short(rng.sample(main, min(len(main), 400)))

    def rich(block: str) -> str:
        block = block.replace("{li}", "<li>{s}</li>" * rng.randint(1, 5) + "<li>{}</li>" * rng.randint(0, 2))
        while "{s}" in block:
            block = block.replace("{s}", _clean(" ".join(rng.choice(brief).split()[: rng.randint(1, 9)])), 1)
        while "{}" in block:
            block = block.replace("{}", _clean(rng.choice(main)), 1)
        return block

    def prose() -> str:
        parts = [f"<p>{rng.choice(main)}</p>" for _ in range(rng.randint(1, 9))]
        if rng.random() < RICH_SHARE:
            for _ in range(rng.randint(1, 3)):
                parts.insert(rng.randint(0, len(parts)), rich(rng.choice(RICH)))
        return "".join(parts)

    for _ in range(count):
        skeleton = rng.choice(skeletons)
        while "{" in skeleton:
            for key, text in (("{0}", DROP), ("{1}", KEEP)):
                skeleton = skeleton.replace(key, text)
            for key in ("{h}", "{p}", "{d}", "{l}", "{b}", "{li}", "{c}", "{t}", "{t2}"):
                if key in skeleton:
                    part = {"{t}": lambda: rng.choice(main), "{t2}": lambda: " ".join(rng.choice(rest).split()[:3]), "{h}": lambda: some(brief, 1, 1, "<h1>{}</h1>"), "{p}": prose, "{d}": lambda: some(main, 1, 4, "<div>{}</div>") + some(brief, 0, 3, "<div>{}</div>"), "{l}": lambda: rich(rng.choice(RICH[:2])), "{b}": lambda: some(rest + brief[:40], 1, 3, rng.choice(["<p>{}</p>", "<div>{}</div>", "{} "])), "{li}": lambda: some(short(rest[:200]), 3, 9, "<li><a href='#'>{}</a></li>"), "{c}": lambda: some(brief, 1, 6, rng.choice(["<div class='comment'><p>{}</p></div>", "<p>{}</p>", "<li>{}</li>"]))}[key]()
                    skeleton = skeleton.replace(key, _clean(part), 1)
        made.append(skeleton)
    return made


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> BoostedTrees:
    """Boosted trees from about TRAIN_PAGES pages of at most TRAIN_CHARS characters each."""
    usable = pages.select(F.col(page_id).alias("i"), F.col(html).alias("h")).where(F.length("h") > 0)
    total = usable.count()
    share = min(1.0, 1.3 * TRAIN_PAGES / max(1, total))
    sample = usable.where((F.pmod(F.xxhash64("i", F.lit(8)), F.lit(1_000_000)) < share * 1e6) & (F.length("h") <= TRAIN_CHARS)).orderBy(F.xxhash64("i", F.lit(8)), "i", "h").limit(TRAIN_PAGES)
    return fit([r["h"] for r in sample.select("h", "i").toLocalIterator()])


def fit(pages: list[str]) -> BoostedTrees:
    """Boosted trees from these pages and their parts in other layouts."""
    trees = [walk(parse(h)) for h in pages]
    known, count = Known(trees), max(len(trees), LEAST_LAID_OUT)
    learned = [(t, None) for t in trees] + [(walk(parse(h)), None) for h in _laid_out(trees, known, count, 8)]
    learned += [(walk(parse(h)), 1) for h in _laid_out(trees, known, count // 3 + 1, 9, BARE)]
    x, y = [], []
    for nodes, otherwise in learned:
        label = labels(nodes, known, otherwise)
        if (label >= 0).any():
            x.append(features(nodes)[label >= 0])
            y.append(label[label >= 0])
    return BoostedTrees().fit(np.concatenate(x).astype(np.float64), np.concatenate(y).astype(np.float64))


def decode(nodes: list[Node], logit: np.ndarray) -> set[int]:
    """ids of the text runs of the best consistent choice."""
    at = {id(v): i for i, v in enumerate(nodes)}
    gain = logit.copy()
    top = np.full(len(nodes), -np.inf)
    for i in range(len(nodes) - 1, -1, -1):
        v = nodes[i]
        if v.tag == "#space" or v.tag != "#text" and top[i] == -np.inf:
            gain[i] = -np.inf
        elif v.tag != "#text" and top[i] < 0:
            gain[i] += top[i]  # a kept block keeps its best child at least
        if i:
            up = at[id(v.parent)]
            top[up] = max(top[up], gain[i])
            if gain[i] > 0:
                gain[up] += gain[i]
    kept, todo = set(), [0] if gain[0] > 0 else []
    while todo:
        i = todo.pop()
        if nodes[i].tag == "#text":
            kept.add(id(nodes[i]))
            continue
        kin = [at[id(c)] for c in nodes[i].children]
        chosen = [j for j in kin if gain[j] > 0] or [max(kin, key=lambda j: gain[j])]
        todo += chosen
    return kept


def main_texts(pages: list[str | None], model: BoostedTrees) -> list[str]:
    trees = [walk(parse(p)) if p else [] for p in pages]
    full = [t for t in trees if len(t) > 1]
    if not full:
        return [""] * len(pages)
    logit = model.logit(np.concatenate([features(t) for t in full]).astype(np.float64))
    out, start = [], 0
    for nodes in trees:
        if len(nodes) < 2:
            out.append("")
            continue
        kept = decode(nodes, logit[start : start + len(nodes)])
        start += len(nodes)
        out.append(render(nodes[0], lambda v: id(v) in kept))
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages, page_id, html))

    def extracted(batches):
        model = shared.value
        for batch in batches:
            texts: list[str] = []
            lengths = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            for first, last in slices(lengths, SLICE_CHARS):
                texts += main_texts(batch.column(2).slice(first, last - first).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    return small_batches(pages).select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")
