"""Main text of pages whose markup the test tables do not hold."""

from __future__ import annotations

import pytest

from listingmart.llm import html_text

TREE = html_text.trained()
BODY = "A long line of the article with many plain words that nobody would take for a menu entry at all. " * 3


def text(page: str) -> str:
    return html_text.main_text(page, TREE)


SHOWN = ['style="overflow:hidden"', 'class="hidden-gems"', 'data-title="hidden costs"', 'aria-hidden="false"', "hidden=until-found", 'title=" hidden "', 'style="display:none;display:block"', 'style="--x:display none"', "data-hidden"]
HIDDEN = ["hidden", 'hidden=""', "HIDDEN=hidden", "class=a hidden id=b", 'aria-hidden="true"', "aria-hidden=TRUE", 'style="color:red; DISPLAY : none"', "style='visibility:hidden'", "style=display:none", 'style="display:none!important;display:block"']


@pytest.mark.parametrize("attributes", SHOWN)
def test_shown_containers_keep_their_text(attributes):
    assert text(f"<article {attributes}><p>{BODY}</p></article>") == BODY.strip()


@pytest.mark.parametrize("attributes", HIDDEN)
def test_hidden_containers_lose_their_text(attributes):
    assert text(f"<article><p>{BODY}</p><div {attributes}><p>Not seen {BODY}</p></div></article>") == BODY.strip()


MENUS = {
    "li": "<ul>" + "<li>Item" * 200 + "</ul>",
    "li without the list's end": "<ul>" + "<li><a href=/>Item</a>" * 200,
    "dt": "<dl>" + "<dt>Word<dd>Sense" * 100 + "</dl>",
    "td": "<table>" + "<tr><td>a<td>b" * 100 + "</table>",
    "parts": "<table>" + "<tbody><tr><th>a<td>b" * 100,
    "div": "<div>" * 200,
}


@pytest.mark.parametrize("menu", MENUS.values(), ids=list(MENUS))
@pytest.mark.parametrize("tag", ["nav", "aside"])
def test_a_menu_of_unclosed_items_ends(menu, tag):
    assert text(f"<{tag}>{menu}</{tag}><article><p>{BODY}</p></article>") == BODY.strip()


@pytest.mark.parametrize("menu", MENUS.values(), ids=list(MENUS))
def test_an_article_with_unclosed_items_ends(menu):
    found = html_text.blocks(f"<article><p>{BODY}</p>{menu}</article><div><p>Behind it</p></div>")
    assert found[0][4] and found[-1] == ("Behind it", 2, 0, False, False)


def test_items_close_only_their_own_siblings():
    found = {b[0]: b[3] for b in html_text.blocks('<ul><li class="share">a<ul><li>b<li>c</ul>d<li>e</ul>')}
    assert found == {"a": True, "b": True, "c": True, "d": True, "e": False}
    found = {b[0]: b[3] for b in html_text.blocks('<table><tr><td class="share">a<table><tr><td>b<td>c<tr><td>d</table>e<td>f<tr><td>g</table>h')}
    assert found == {"a": True, "b": True, "c": True, "d": True, "e": True, "f": False, "g": False, "h": False}
    found = {b[0]: b[3] for b in html_text.blocks('<dl><dt class="share">a<dd>b<dt>c</dl><div class="share"><table><tr><td>d</div>e</table>f</div>g')}
    assert found == {"a": True, "b": False, "c": False, "d": True, "e": True, "f": True, "g": False}


def test_deep_pages_take_linear_time():
    import time

    begin = time.monotonic()
    assert text("<nav>" + "<div>" * 100_000 + "<ul>" + "<li>x</i></b></h1>" * 50_000 + f"</nav><article><p>{BODY}</p></article>") == BODY.strip()
    assert time.monotonic() - begin < 20


@pytest.mark.parametrize("tag", sorted("button select object video audio canvas svg math template noscript".split()))
def test_a_mute_element_without_its_end_ends_with_what_encloses_it(tag):
    for page in (f"<article><div><{tag}>Not seen</div><p>{BODY}</p></article>", f"<article><p>Start <{tag}>Not seen</p><p>{BODY}</p></article>", f"<nav><{tag}>Not seen</nav><article><p>{BODY}</p></article>"):
        assert text(page).removeprefix("Start ") == BODY.strip()
    found = html_text.blocks(f'<table><tr><td>a<{tag} class="share"><div class="ad"><p>x</p></div>x</td><td>b</table>')
    assert [(b[0], b[3]) for b in found] == [("a", False), ("b", False)]
    # With its end it neither cuts a block nor shows anything, whatever it holds.
    found = html_text.blocks(f"<div><p>a <a href=/>b</a> <{tag} hidden><ul><li>x<li>y</ul><p>x</p><a href=/>z</a><{tag}>x</{tag}></{tag}>c d</p></div>")
    assert [b[:3] for b in found] == [("a b c d", 4, 1)] if tag not in ("button", "select") else found[0][0].startswith("a b")


def test_raw_text_without_its_end_runs_to_the_end_of_the_page():
    assert text(f"<article><p>{BODY}</p><script>if (a < b) '</p>'<p>Not seen</article>") == BODY.strip()


def test_a_second_button_closes_the_first():
    assert text(f"<article><button>One<button>Two</button><p>{BODY}</p></article>") == BODY.strip()


@pytest.mark.parametrize("unit", ["<a '\"", "<a ", "<a", "<", "< ", "<a \"x> ", "<a '\"> ", '<a x="', "<!", "</", "<a '\"x>", "<p ", "<!--", "<b/", "<a b='"])
@pytest.mark.parametrize("end", ["", ">", "'", '"'])
def test_broken_tags_take_linear_time(unit, end):
    import time

    begin = time.monotonic()
    html_text.blocks(unit * (1_000_000 // len(unit)) + end)
    assert time.monotonic() - begin < 10


def test_tags_end_where_their_quotes_allow():
    found = html_text.blocks("<p title='a > b'>one</p><img alt=\"x>y\">two<p class='>three</p><!-- <p> -->four <5 > 6 <!doctype x><br")
    assert [b[0] for b in found] == ["one", "two", "three", "four <5 > 6 <br"]
