"""Names of wrappers do not cost a page its article, and frames of any size go."""

import numpy as np
import pytest

from cellarbook.llm import html_extract as H

ONE = "The harbour was quiet on the first morning of the year, and only two boats had left before the sun came up over the hills."
TWO = "By noon the wind had turned, so that the others stayed where they were; nobody in the village thought that this was strange."
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All articles</a></li></ul></nav>'
COMMENT = "I read this with great pleasure, and I would like to know what became of the boats that had left so early that day."
COMMENTS = f'<section id="comments"><h2>Comments</h2><div class="comment-body"><p>{COMMENT}</p></div><div class="comment-body"><p>{COMMENT} Thanks!</p></div></section>'
FOOTER = "<footer><p>Copyright 2024 by the village paper. All rights reserved.</p></footer>"
WRAPPERS = (
    '<div class="site has-sidebar">{}</div>', '<div class="commentary">{}</div>', '<div class="article unrelated">{}</div>',
    '<div class="page footer-widgets-on">{}</div>', '<div class="col right-sidebar-layout">{}</div>', '<form id="aspnetForm" method="post">{}</form>',
    '<div id="sidebar-wrap">{}</div>', '<div class="widget">{}</div>', '<section class="promo"><div>{}</div></section>', '<div class="comments-open">{}</div>',
)


@pytest.fixture(scope="module")
def fitted(spark):
    return H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("title", ["", "<h1>A quiet morning</h1>"])
def test_wrappers_keep_their_prose(fitted, wrapper, inside, title):
    prose = f"<div>{title}<p>{ONE}</p><p>{TWO}</p></div>"
    page = wrapper.format(MENU + prose + COMMENTS + FOOTER) if inside else MENU + wrapper.format(prose) + FOOTER
    want = ["A quiet morning"] * bool(title) + [ONE, TWO]
    for weights in (H.PRIOR, fitted):
        assert H.extract(f"<html><body>{page}</body></html>", weights).split("\n\n") == want


@pytest.mark.parametrize("frame", [COMMENTS, COMMENTS * 2, f'<div class="newsletter"><p>{COMMENT}</p></div>', f'<div class="sidebarLeft"><p>{COMMENT}</p></div>',
                                   f'<form action="x"><p>{COMMENT}</p></form>', f'<div id="cookie-notice"><p>{COMMENT}</p></div>', f'<aside><p>{COMMENT}</p></aside>'])
@pytest.mark.parametrize("article", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", '<div class="post has-sidebar">{}</div>'])
def test_frames_go(fitted, frame, article):
    page = MENU + article.format(f"<h1>A quiet morning</h1><p>{ONE}</p><p>{TWO}</p>") + frame + FOOTER
    for weights in (H.PRIOR, fitted):
        assert H.extract(page, weights).split("\n\n") == ["A quiet morning", ONE, TWO]


def test_a_site_header_with_the_title_of_the_site_goes(fitted):
    page = f'<header class="site-header"><h1>Village paper</h1></header>{MENU}<div class="post"><h2>A quiet morning</h2><p>{ONE}</p><p>{TWO}</p></div>'
    assert H.extract(page, fitted).split("\n\n")[-2:] == [ONE, TWO] and "Village paper" not in H.extract(page, fitted)


def test_the_fit_learns_from_text_and_layout_alone():
    rng = np.random.default_rng(3)
    x = rng.random((400, len(H.FEATURES)))
    y = (x[:, len(H.MARKUP) + 2] > 0.5).astype(float)
    shuffled = x.copy()
    shuffled[:, : len(H.MARKUP)] = rng.random((400, len(H.MARKUP)))
    w = H.fit_rows(x, y)
    assert np.array_equal(w, H.fit_rows(shuffled, y)) and np.array_equal(w[: len(H.MARKUP)], H.PRIOR[: len(H.MARKUP)])
    assert w[len(H.MARKUP) + 2] > H.PRIOR[len(H.MARKUP) + 2] + 0.5


def test_held_out_blocks_from_text_and_layout(spark):
    """Without any markup feature the fitted part alone tells most blocks of other pages."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    x = [H.features(H.blocks_of(p or "")) for p in pages]
    seen, other = np.concatenate(x[::2]), np.concatenate(x[1::2])
    y, z = H.weak_labels(seen), H.weak_labels(other)
    w = H.fit_rows(seen[y >= 0], y[y >= 0].astype(float))
    n = len(H.MARKUP)
    told = (other[z >= 0][:, n:] @ w[n:] > 0) == (z[z >= 0] == 1)
    assert told.mean() >= 0.9


def test_deep_pages_take_linear_time():
    deep = '<div class="has-sidebar">' * 20_000 + ONE + "</div>" * 20_000
    assert H.extract(deep, H.PRIOR) == ONE
