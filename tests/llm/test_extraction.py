"""Text extraction: blocks by hand, decoding against all label sequences,
accuracy on pages and layouts that gave no training, odd inputs."""

import re
from html import unescape
from itertools import product

import numpy as np
import pytest

import __spark_entry__ as entry
from tablesight.llm.extraction import Field, extract, leaf_blocks, text_features, train
from tablesight.llm.page_layouts import labelled_pages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field():
    return train(labelled_pages())


def texts(html):
    return [b[0] for b in leaf_blocks(html)]


def test_blocks():
    assert texts("<p>a&amp;b  c\n<b>d</b>e<br>f<p>g&nbsp;&lt;p&gt;</p>h") == ["a&b c de f", "g <p>", "h"]
    assert texts("<script>var t='</p>';</script>x<style>p{}</style>y<!-- <p>no</p> -->z") == ["xyz"]
    assert texts("<head><title>no</title><meta x></head><body><ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>1<td>2<tr><th>3</table>4") == ["1", "2", "3", "4"]
    assert texts("a < b > c <div cla") == ["a < b > c"] and texts("<p>a<script>never closed <p>b") == ["a"]
    assert texts('<a title="x > y" href=z\'w>l</a><p title="open>q') == ["l", "q"] and texts("") == texts("<p></p> <br>") == []
    assert texts("&#x41;&#0;&bogus;&eacute;&amp<i>amp;</i>") == ["A�&bogus;é&amp;"]
    path = leaf_blocks("<div class='Main x'><p>a</p><aside ID=s><p>b</aside><p>c")
    assert [b[1].split("\n")[2:] for b in path] == [["div main x", "p"], ["div main x", "aside s", "p"], ["div main x", "p"]]
    assert path[0][2] == path[2][2] != path[1][2]
    assert [b[3] for b in leaf_blocks("<p><a>ab</a>cd<p><a>x</a>")] == [0.5, 1.0]
    assert [b[4] for b in leaf_blocks("<p>a<div data-main=1>b<div data-main=0>c</div>d</div>e")] == [0, 1, 0, 1, 0]
    assert len(texts("<p>a" * 3000 + "<div>b" * 3000)) == 6000


def test_decoding_is_the_best_sequence():
    rng = np.random.default_rng(5)
    for _ in range(30):
        blocks = [(w, "\n#page\np", int(k), 0.0, 0) for w, k in zip(rng.choice(list("abcd"), 7), rng.integers(0, 2, 7))]
        pairs, first = rng.normal(size=(2, 2, 2)), float(rng.normal())
        weights = {f"word {w}": float(rng.normal()) for w in "abcd"}
        def value(y):
            v = sum(weights[f"word {b[0]}"] for b, k in zip(blocks, y) if k) + first * y[0]
            return v + sum(pairs[int(blocks[i][2] == blocks[i - 1][2])][y[i - 1]][y[i]] for i in range(1, 7))
        assert value(Field(weights, pairs, first).decode(blocks)) == pytest.approx(max(map(value, product((0, 1), repeat=7))))


def test_training_fits_likelihood():
    """One kind of block and alternating labels: the weights must tell the chain."""
    pages = ["".join(f"<div data-main={i % 2}>x</div>" for i in range(10))] * 8
    field = train(pages)
    blocks = leaf_blocks(pages[0])
    assert field.decode(blocks) == [0, 1] * 5
    assert text_features("x", 0.0)


def test_unseen_layouts(field):
    wrong = total = exact = 0
    for page in labelled_pages(300, seed=77):
        blocks = leaf_blocks(page)
        missed = sum(y != b[4] for b, y in zip(blocks, field.decode(blocks)))
        wrong, total, exact = wrong + missed, total + len(blocks), exact + (missed == 0)
    assert wrong < 0.01 * total and exact > 270


def test_written_by_hand(field):
    page = """<html><body><div class="cookie-bar">We use cookies.</div><div id=top-menu><a href=/>Home</a> | <a href=/n>News</a></div>
    <div class="content"><h1>A day at sea</h1><p>It was early, and the boats had not come in.</p><div class=ads>Buy a boat today!</div>
    <p>By noon the harbour was full of them, <a href=x>they say</a>.</p><ul><li>One red boat.</li><li>Two blue boats.</li></ul></div>
    <div id=comments><h2>Comments</h2><p>Great story, I was there too.</p><p>So was I, it rained.</p></div>
    <div class=sidebar><p>Weather: rain, then more rain.</p></div><div class=footer>&copy; 2020 Harbour Times</div>"""
    blocks = leaf_blocks(page)
    assert [b[0] for b, y in zip(blocks, field.decode(blocks)) if y] == [
        "A day at sea", "It was early, and the boats had not come in.", "By noon the harbour was full of them, they say.", "One red boat.", "Two blue boats."]


def article(html):
    """The test tables' pages keep their main text in one article element."""
    inner = html[html.index("<article>") + 9:html.index("</article>")]
    blocks = (" ".join(unescape(re.sub(r"<(?:b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query(spark, sf):
    sf = f"/root/testdata/{sf}"
    want = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = entry.queries()["op11_html_extraction"](spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", None, None), (None, "<article><p>Some text of a page.</p></article>", "x", 2), (2, "", None, None),
            (3, "<article>" + "<p>Much text here.</p>" * 20_000, "x", 3), (4, "<nav>a</nav>", "x", 4)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_main int")
    got = sorted(extract(df, ["page_id"]).collect(), key=str)
    assert [(r.page_id, r.n_chars) for r in got if r.page_id != 3] == [(1, 0), (2, 0), (2, 0), (4, 0), (None, 20)]
    assert next(r for r in got if r.page_id == 3).text == "\n".join(["Much text here."] * 20_000)
    assert extract(df.limit(0), ["page_id"]).collect() == []
    with pytest.raises(ValueError):
        extract(df, ["text"])
    broken = spark.sql("select 1L as page_id, cast(X'3C61727469636C653E3C703E61FF622E' as string) as html")
    assert extract(broken, ["page_id"]).first().text in ("a�b.", "")
