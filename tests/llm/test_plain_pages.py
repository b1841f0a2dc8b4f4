"""Main text in plain layouts: lists, tables, quotes, captions and code."""

from __future__ import annotations

import pytest

from terrazzo.llm import htmltext

TEXT = "First paragraph of the story, long enough to be told apart from a menu, with commas and more words in it."
BARE = f"<div><div>{TEXT}</div><div>Second one; short.</div><ol><li>step one</li><li>step two</li><li>step three, the last</li></ol></div>"
FULL = f"<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article><h1>Head</h1><p>{TEXT}</p><ul><li>first point</li><li>second point</li></ul><figure><img src=a><figcaption>A caption here.</figcaption></figure><pre>code = 1</pre><blockquote>Quoted words.</blockquote><table><tr><td>a</td><td>12</td></tr></table></article><footer>Imprint</footer>"
WANT = [f"{TEXT} Second one; short. step one step two step three, the last", f"Head {TEXT} first point second point A caption here. code = 1 Quoted words. a 12"]


@pytest.fixture(scope="module")
def model(spark, data):
    return htmltext.train(spark.read.parquet(f"{data}/pages.parquet"))


def test_plain_pages_come_back_whole(model):
    assert htmltext.main_texts([BARE, FULL], model) == WANT


def test_pages_are_read_together_by_their_characters(spark, model, monkeypatch):
    monkeypatch.setattr(htmltext, "SLICE_CHARS", 50)
    rows = [(i, "u", p) for i, p in enumerate([BARE, None, FULL, "", BARE])]
    found = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model=model).collect()}
    assert found == {0: WANT[0], 1: "", 2: WANT[1], 3: "", 4: WANT[0]}


def test_skeletons_have_no_holes_left():
    pages = htmltext._laid_out([], htmltext.Known([]), 60, 1) + htmltext._laid_out([], htmltext.Known([]), 60, 2, htmltext.BARE)
    assert not any("{" in p or "}" in p for p in pages)
    assert all(any(tag in p for p in pages) for tag in ("<ol>", "<table>", "<blockquote>", "<figcaption>", "<pre>", "<dl>"))
