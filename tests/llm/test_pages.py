"""Pages whose names lie, and hosts where only the wrapper can tell."""

from __future__ import annotations

import pytest

from stagewise.llm import html

from .conftest import words

LONG = " ".join(words(1, 40))
MORE = " ".join(words(2, 30))


@pytest.mark.parametrize("name", ["page with-sidebar", "has-sidebar", "no-sidebar", "sidebar-open layout", "comments-open", "sidebar"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_layout_names_round_the_content(name, tag):
    page = f"<body><div class='{name}'><{tag}><p>{LONG}</p></{tag}></div><div class='site-footer'>foot</div></body>"
    assert html.main_text(page, None) == LONG


@pytest.mark.parametrize("part", [f"<div class=share-price-table><p>{MORE}</div>", f"<section class=legal><h2>Law</h2><p>{MORE}</section>",
                                  f"<section id=related><h2>Related work</h2><p>{MORE}</section>", f"<div class=cookie-recipe>{MORE}</div>",
                                  f"<div id=menu-of-the-day>{MORE}</div>"])
def test_names_that_only_sound_like_chrome_inside_the_content(part):
    got = html.main_text(f"<article><p>{LONG}</p>{part}</article>", None)
    assert got.startswith(LONG) and got.endswith(MORE)


@pytest.mark.parametrize("part", ["<div class=ad-slot>Buy</div>", "<div id='left-sidebar'>menu</div>", "<ul class='site-nav'><li>a</ul>", "<div class='comment-list'><p>nice</div>",
                                  "<div class=related-posts><a href=x>Other page of ours</a></div>", "<p class=copyright>(c) us</p>", "<div class='newsletter-signup'>Join</div>",
                                  "<div hidden class=article-body>x</div>", "<div class='cookie-banner'>ok</div>"])
def test_chrome_inside_the_content_goes(part):
    assert html.main_text(f"<article><p>{LONG}</p>{part}</article>", None) == LONG


def test_a_form_round_the_page_and_one_inside_it():
    inner = f"<div><p>{LONG}</p><input name=q><select><option>a</select><p>{MORE}</p></div>"
    assert html.main_text(f"<body><form id=all>{inner}</form></body>", None) == f"{LONG}\n\n{MORE}"
    assert html.main_text(f"<body><form id=all><article><p>{LONG}</p></article></form></body>", None) == LONG
    assert html.main_text(f"<body><p>{LONG}</p><form>Search <input></form></body>", None) == LONG


def test_a_list_of_links_in_the_text_stays_and_a_menu_goes():
    listed = "<ul><li><a href=1>first source</a><li><a href=2>second source</a></ul>"
    page = f"<body><div class=top><ul><li><a href=/>Home</a><li><a href=/x>Shop</a></ul></div><div><h1>Head</h1><p>{LONG}</p>{listed}</div></body>"
    assert html.main_text(page, None) == f"Head\n\n{LONG}\n\nfirst source\n\nsecond source"
    assert html.main_text(f"<article><p>{LONG}</p>{listed}</article>", None).endswith("first source\n\nsecond source")


def _extract(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    return [r.text for r in sorted(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_only_the_host_can_tell_a_constant_note_from_text(shipped):
    """One class on three parts of each article: constant, varying and short, varying and made of links."""
    def page(i, host):
        return (f"http://{host}/{i}", f"<article><p>{' '.join(words(10 + i, 30))}</p><div class=promo><p>Join our readers and never miss a story of this site again</p></div>"
                f"<div class=promo><p>{' '.join(words(50 + i, 5))}</p></div><div class=promo><a href=x>{' '.join(words(80 + i, 9))}</a></div></article>")

    got = _extract(shipped, [page(i, "many.org") for i in range(6)] + [page(0, "one.org")])
    assert got[:6] == [f"{' '.join(words(10 + i, 30))}\n\n{' '.join(words(50 + i, 5))}" for i in range(6)]
    # alone on its host, the long sentence can not be known as constant and the short part says too little
    assert got[6] == f"{' '.join(words(10, 30))}\n\nJoin our readers and never miss a story of this site again"


def test_plain_boxes_by_the_wrapper_alone(shipped):
    """No telling element or name at all: the slots' node is read, lists of links in it too, and the rest is template."""
    def page(i):
        links = f"<ul><li><a href=1>{' '.join(words(200 + i, 3))}</a></ul>"
        return (f"http://h.org/{i}", f"<body><div class=a><ul><li><a href=/>Home</a><li><a href=/s>Shop</a></ul></div><div class=b><div class=c><p>{' '.join(words(i, 40))}</p>{links}"
                f"<p>Written by our staff</p></div></div><div class=d><p>All rights are kept by the owners</p></div></body>")

    for i, text in enumerate(_extract(shipped, [page(i) for i in range(7)])):
        assert text == f"{' '.join(words(i, 40))}\n\n{' '.join(words(200 + i, 3))}"


def test_pages_that_are_nearly_copies_prove_nothing(shipped):
    same = "".join(f"<p>{' '.join(words(700 + j, 12 + j))}" for j in range(9))
    pages = [(f"http://near.org/{i}", f"<article>{same}<p>end {i}</article>") for i in range(8)]
    assert all(t.count("\n\n") == 9 for t in _extract(shipped, pages))
    # the same part on pages of their own is template, however much of a page it is
    own = [(f"http://own.org/{i}", f"<article>{same}<p>{' '.join(words(900 + i, 60))}</article>") for i in range(8)]
    assert _extract(shipped, own) == [" ".join(words(900 + i, 60)) for i in range(8)]
