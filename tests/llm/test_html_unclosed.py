"""Elements that nothing closes, or that close themselves, hide no text behind them."""

import pytest

from cellarbook.llm import html_extract as H

PROSE = "This is a paragraph of the article, and it is long enough to be kept."
NEXT = "Here is the second paragraph of it, which is as long as the first one."


def texts(page):
    return [b.text for b in H.blocks_of(page)]


def test_head_that_nothing_closes():
    page = f"<!doctype html><html><head><meta charset=utf-8><title>T</title><style>p{{}}</style><body><article><p>{PROSE}<p>{NEXT}</article>"
    assert texts(page) == [PROSE, NEXT]
    assert H.extract(page.replace("<body>", ""), H.PRIOR).split("\n\n") == [PROSE, NEXT]
    assert texts(f"<head><title>T</title>{PROSE}") == [PROSE]


@pytest.mark.parametrize(
    "inside",
    ["<svg viewBox='0 0 1 1'/>", "<iframe src=x />", "<button>Send", "<select><option>A<option>B", "<svg><path d='M0'/>", "<canvas>", "<object data=x>", "<svg><title/></svg>", "<noscript><img src=x>"],
)
def test_the_rest_of_the_article_stays(inside):
    assert texts(f"<article><p>{PROSE}</p>{inside}<p>{NEXT}</p></article>") == [PROSE, NEXT]
    assert texts(f"<article><p>{PROSE} {inside}</p>{NEXT}</article>") == [PROSE, NEXT]


def test_closed_elements_stay_unseen():
    inside = "<button><div>Menu</div></button><svg><g><text>t</text></g><svg>u</svg>v</svg><select><option>A</select><iframe>f</iframe><template><p>x</p></template>"
    assert texts(f"<p>a {inside}b</p>") == ["a b"]


def test_formulas_are_text():
    math = "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>x=2</annotation></math>"
    assert texts(f"<p>Let {math} hold.</p>") == ["Let x=2 hold."]


def test_many_open_elements():
    assert len(texts("<svg><button>" * 3000 + "<p>x</p>" * 3000)) == 3000
