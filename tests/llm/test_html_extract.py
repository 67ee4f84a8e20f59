import html
import itertools
import random
import re

import numpy as np
import pytest

from cellarbook.llm import html_extract as H
from cellarbook.llm.queries import op6_html_extract

FOLDER = "/root/testdata/sf0.01"
FRAMED = """<html><head><title>T</title><style>p{}</style></head><body><header class="top"><p>Site name and a slogan for it.</p></header>
<div id="cookie-notice"><p>We use cookies to make this site better for everyone.</p></div><form><label>Mail</label><input><button>Send</button></form>
<div class="sidebar"><ul><li><a href="x">One</a></li><li><a href="y">Two</a></li></ul></div><main><h1>A &amp; B</h1>
<p>First   paragraph with <b>bold</b> and <a href="z">a link</a>.<p>Second&nbsp;one &lt;3.<ul><li>Item of the article.</li></ul>
<script>var x = "<p>no</p>";</script><aside>Related: other things to read now.</aside></main>
<section class="comments"><p>Reader says this is a very long comment, with many words in it.</p></section><footer>&copy; Somebody</footer></body></html>"""


def article_by_hand(page):
    """The generated pages hold all of their text in one article of h1 and p."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)
    out = []
    for part in re.split(r"</?(?:h1|p)>", inside[1] if inside else ""):
        text = " ".join(html.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in part else "", part)).split())
        if text:
            out.append(text)
    return "\n\n".join(out)


def test_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = op6_html_extract(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text.split() == article_by_hand(pages[r.page_id].html).split(), r.page_id


@pytest.mark.parametrize("weights", [H.PRIOR, None])
def test_frames_of_many_kinds(spark, weights):
    if weights is None:
        weights = H.fit(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    want = ["A & B", "First paragraph with bold and a link.", "Second one <3.", "Item of the article."]
    assert H.extract(FRAMED, weights).split("\n\n") == want
    plain = "<div class=menu><a href=a>Home</a> <a href=b>More</a></div><div><p>A page without any semantic element still has long prose, and it is kept.</p>"
    plain += "<p>Its second paragraph follows, which is about as long as the first one was.</p></div>"
    assert len(H.extract(plain, weights).split("\n\n")) == 2


def test_broken_pages():
    for page in (None, "", " \n", "<", "<p", "<!-- open", "<script>never closed", "</p></div>", "<p a='", "&amp;&am &#65;", "<b>" * 3000 + "x"):
        assert isinstance(H.extract(page, H.PRIOR), str)
    assert [b.text for b in H.blocks_of("<p>a<p>b<br>c<div>d</div>e &eacute;&#8211;")] == ["a", "b c", "d", "e é–"]
    assert [b.text for b in H.blocks_of("<p>" + "word " * 100_000)][0].count("word") == 100_000


def test_cut_against_all_labellings():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random() * 2) for _ in range(rng.randrange(12))]

        def cost(side):
            own = sum(max(0, o) * (not s) + max(0, -o) * s for o, s in zip(odds, side))
            return own + sum(w * (side[a] != side[b]) for a, b, w in edges)

        best = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert cost(H.minimum_cut(odds, edges)) == pytest.approx(best)


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (1, None, None, "a"), (None, "u", "", "b"), (3, "v", "<article><p>é x</p></article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in H.main_text(pages, H.fit(pages)).collect()), key=str)
    assert got == sorted([(1, None, ""), (1, None, ""), (None, "u", ""), (3, "v", "é x")], key=str)
    assert np.array_equal(H.fit(pages.limit(0)), H.PRIOR)
    assert H.main_text(pages.limit(0), H.PRIOR).collect() == []
