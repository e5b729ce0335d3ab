"""HTML extraction: blocks by hand, the network's slopes by differences, held-out layouts, and the driver's pages."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from panelyard.llm import html_model, oracles
from panelyard.llm.html_blocks import Paths, blocks
from panelyard.llm.html_model import BlockLabeller, Vectors, labelled_layouts, main_texts, padded

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string"
VOCABULARY = ["alpha", "beta", "gamma", "delta", "word", "some", "Other", "thing", "the", "and", "of", "to"]


@pytest.fixture(scope="module")
def labeller():
    return BlockLabeller().fit(labelled_layouts(VOCABULARY))


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("", []),
        ("plain words", ["plain words"]),
        ("<p>a<b>b</b>c<p>second<br>line", ["abc", "second line"]),
        ("<p>x &amp; y &lt;z&gt; &eacute;&#233;&#xe9; &am &unknown;", ["x & y <z> ééé &am &unknown;"]),
        ("<p>a\n\t b \xa0 c</p> \n <p> </p>", ["a b c"]),
        ("<p>a<!-- <p>no</p> -->b<script>if (a<b) '<p>';</script>c<style>p{}</style></p>", ["abc"]),
        ("<head><title>T</title></head><body><div>one<div>two</div>three", ["one", "two", "three"]),
        ("<ul><li>1<li>2<ul><li>2a</ul><li>3</ul>", ["1", "2", "2a", "3"]),
        ("<p title=\"a > b\" data-x='</p>'>kept</p>", ["kept"]),
        ("a < b and 1<2 <p>c</p", ["a < b and 1<2", "c"]),
        ("<p>cut off <a href=", ["cut off"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ("<textarea>typed <b>x</b></textarea>after", ["typed <b>x</b>", "after"]),
        ("<svg/>seen<svg><text>no</text></svg>", ["seen"]),
        ("<!-- never closed <p>x", []),
        ("<p>" + "<b>" * 50_000 + "deep", ["deep"]),
        ("<div>" * 20_000 + "deep" + "</div>" * 20_000 + "after", ["deep", "after"]),
    ],
)
def test_blocks(html, texts):
    assert [b.text for b in blocks(html, Paths())] == texts


def test_paths_and_links():
    paths = Paths()
    found = blocks('<div class="main" id=x><p>See <a href="/">this link</a></p></div><nav>Menu</nav>', paths)
    chain = lambda i: [] if i <= 0 else [*chain(paths.parent[i]), paths.label[i]]
    assert [(chain(b.path), b.links) for b in found] == [(["div main x", "p"], 9), (["nav"], 0)]


def test_slopes_are_derivatives():
    r = np.random.default_rng(4)
    group = [r.normal(size=(n, html_model.WIDTH)).astype(np.float32) for n in (1, 5, 3)]
    x, mask = padded(group)
    y = (r.random(mask.shape) < 0.5).astype(np.float32)
    net = BlockLabeller()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        z, _ = net.logits(x.astype(np.float64), mask)
        return float((np.logaddexp(0, z) - y * z)[mask].mean())

    slopes = net.slopes(x.astype(np.float64), mask, y)
    assert slopes.keys() == net.w.keys()
    for name, w in net.w.items():
        for at in r.integers(0, w.size, 6):
            place = np.unravel_index(at, w.shape)
            old = w[place]
            w[place] = old + 1e-4
            up = loss()
            w[place] = old - 1e-4
            down = loss()
            w[place] = old
            assert np.asarray(slopes[name])[place] == pytest.approx((up - down) / 2e-4, abs=2e-4), name


def test_padding_changes_nothing(labeller):
    """A page's labels don't depend on the pages beside it."""
    pages = labelled_layouts(VOCABULARY, 40, 77)
    flat, lengths = np.concatenate([v for v, _ in pages]), [len(v) for v, _ in pages]
    together = labeller.chosen(flat, lengths)
    alone = np.concatenate([labeller.chosen(v, [len(v)]) for v, _ in pages])
    assert (together == alone).all()


def test_held_out_layouts(labeller):
    """Layouts that training didn't see, with words that it didn't see."""
    pages = labelled_layouts([f"zz{i}" for i in range(300)], 300, 1234)
    truth = np.concatenate([y for _, y in pages]) > 0.5
    got = labeller.chosen(np.concatenate([v for v, _ in pages]), [len(v) for v, _ in pages])
    assert (got == truth).mean() >= 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href="/">My site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="wrapper"><aside class="sidebar"><h3>Related</h3><a href="/c">Another one</a></aside>{0}<h1>A title</h1><p>First <em>paragraph</em> of it, long enough to be read.
<p>Second paragraph &amp; more, with some words in it.</p><div class="ad">Buy now, special offer</div><ul><li>One point of the article<li>Another point of the article</ul>{1}
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I think this is a great read and I agree with all of it.</p></div></section>
<form class="search"><label>Search</label><button>Go</button></form></div><footer>&copy; 2024 All rights reserved</footer></body></html>"""


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry-content">', "</div>")])
def test_a_page_with_everything_around(labeller, around):
    expected = "A title\nFirst paragraph of it, long enough to be read.\nSecond paragraph & more, with some words in it.\nOne point of the article\nAnother point of the article"
    assert main_texts([PAGE.format(*around), ""], labeller, Vectors()) == [expected, ""]


def test_odd_and_empty_tables(spark, labeller):
    long = "<html><body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>Paragraph number {i} of a very long page.</p>" for i in range(6000)) + "<p>" + "word " * 300_000 + "</p></article></body></html>"
    short = PAGE.format("<article>", "</article>")
    rows = [(1, None, None), (None, "u", short), (2, "u", ""), (3, "u", long), (3, "u", long), (4, "u", "<nav><a href='/'>Home</a></nav>"), (5, "u", " \n ")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = html_model.extract(table, labeller)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert Counter((r["page_id"], r["url"]) for r in found) == Counter((a, b) for a, b, _ in rows)
    by = {r["page_id"]: r["text"] for r in found}
    assert by[1] == by[2] == by[5] == by[4] == "" and by[None].startswith("A title\nFirst")
    assert by[3].count("\n") == 6000 and by[3].endswith("word word") and all(r["n_chars"] == len(r["text"]) for r in found)
    none = table.limit(0)
    assert html_model.extract(none, html_model.train(none)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_the_articles_of_the_pages(spark):
    import duckdb

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_model.extract(pages, html_model.train(pages)).collect()
    duckdb.sql(f"create or replace view pages as select * from '{SF}/pages.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(duckdb.sql(oracles.main_texts()).fetchall())
