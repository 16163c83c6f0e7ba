import time

import pytest

from assaylake.llm import html_text

LONG = "This is the first paragraph of the page, and it is long enough to be decided on its own."
MORE = "Here is what the second one has to say about it, which is not less than the first has."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("no markup at all", "no markup at all"),
        (f"<article><h1>Head</h1><p>{LONG}<p>Yes.</article>", f"Head\n\n{LONG}\n\nYes."),
        (f"<p>{LONG}</p><p>Short.</p><p>{MORE}</p>", f"{LONG}\n\nShort.\n\n{MORE}"),
        (f"<nav><a href=x>{LONG}</a></nav><article><p>{MORE}</p></article>", MORE),
        (f"<article><p>{LONG}</p><aside>{MORE}</aside></article>", LONG),
        (f'<article><p>{LONG}</p><div class="share-bar">Share</div></article>', LONG),
        (f'<article><p>{LONG}</p></article><div id="comments"><p>{MORE}</p></div>', LONG),
        (f'<div id="comments"><article><p>{MORE}</p></article></div><article>{LONG}</article>', LONG),
        (f'<div class="cookie-notice">{MORE}</div><main><p>{LONG}</p></main>', LONG),
        (f"<article><header><h1>Head</h1></header>{LONG}</article>", f"Head\n\n{LONG}"),
        (f"<header>{MORE}</header><div><p>{LONG}</p></div><footer>{MORE}</footer>", LONG),
        (f"<article>{LONG}<form><label>{MORE}</label><input></form></article>", LONG),
        ("<article>a &amp; b&nbsp;&lt;c&gt; &eacute;&#x41;</article>", "a & b <c> éA"),
        ("<article>x<b>y</b>z <i>w</i><br>v\n\t u</article>", "xyz w v u"),
        ("<article><p>one<br><br>two</p></article>", "one\n\ntwo"),
        ("<article>a<script>var t='</p>';</script>b<style>p{}</style><!-- c --></article>", "ab"),
        ("<article><p>Of.</p><p>Sh is.</p></article>", "Of.\n\nSh is."),
        ("<article><p>ye | olde | table</p></article>", "ye | olde | table"),
        (f'<article><p>{LONG}</p><p hidden>{MORE}</p></article>', LONG),
        (f'<p>{LONG}</p><ul><li><a href="1">One of these</a></li></ul>', LONG),
        (f"<article><p>{LONG} <a href=x>with a link</a></p></article>", f"{LONG} with a link"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text
    assert html_text.main_text(page(html)) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a</p><button-bar>b</button-bar><p>c</p>", "a\n\nb\n\nc"),
        (f"<article><video-js src=x></video-js><p>{LONG}</p></article>", LONG),
        (f"<article><title-bar>T</title-bar><p>{LONG}</p></article>", f"T\n\n{LONG}"),
        (f"<html><head><title>T</title><meta charset=utf-8><p>{LONG}</p><p>{MORE}</p>", f"{LONG}\n\n{MORE}"),
        (f"<head><title>T</title><script>'<p>'</script><article>{LONG}</article>", LONG),
        *[(f"<article><{x}><p>{LONG}</p><p>{MORE}</p></article>", f"{LONG}\n\n{MORE}") for x in ("video", "object data=x", "button", "select", "audio", "svg")],
        (f"<article><button><p>{LONG}</p><button>Go</button><p>{MORE}</p></article>", f"{LONG}\n\n{MORE}"),
        (f"<article><p>{LONG}</p><select><option>A<option>B</option><p>{MORE}</p></article>", f"{LONG}\n\n{MORE}"),
        (f"<article><p>{LONG}</p><SELECT><option>A</SELECT><Video>no</video ></article>", LONG),
        (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>", f"{LONG} x=1"),
        (f'<article><p title="a > b" id=\'c>d\'>{LONG}</p></article>', LONG),
        (f'<article><img alt="if a<b and b>c"><img alt="{"a" * 5000}>b"><p>{LONG}</p></article>', LONG),
        (f'<article><p class="x>{LONG}</p><p class="y">{MORE}</p></article>', f"{LONG}\n\n{MORE}"),
        (f"<article><p>{LONG}</p><script>a</article><p>{MORE}</p>", LONG),
        (f"<article><p>{LONG}</p><button>Go</button><svg/><p>{MORE}</p></article>", f"{LONG}\n\n{MORE}"),
    ],
)
def test_nothing_is_lost_after_a_tag(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article class='post social-science'><p>{LONG}</p></article>", LONG),
        (f"<main class='has-sidebar'><p>{LONG}</p></main>", LONG),
        (f"<main class=content id=search><p>{LONG}</p><article class=related>Yes.</article></main>", f"{LONG}\n\nYes."),
        (f"<body class='single comments-open'><article><p>{LONG}</p></article></body>", LONG),
        (f"<body class='comments'><p>{LONG}</p></body>", LONG),
        (f"<article><p>{LONG}</p><div class='social-science'>Yes.</div></article>", f"{LONG}\n\nYes."),
        (f"<div class='widget'><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p><p>Yes.</p></div>", f"{LONG}\n\n{MORE}\n\n{LONG}\n\nYes."),
        (f"<article><p>{LONG}</p><div class='ad'><p>{MORE}</p></div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='x ad-slot-2'>A</div><div id=ad_728x90>B</div></article>", LONG),
        (f"<article>{LONG}<div class=comments>{f'<p>{MORE}</p>' * 4}</div></article>", LONG),
        (f"<article>{LONG}<div class=widget><div class=ad>Buy</div>{'<p>Go</p>' * 3}{f'<p>{MORE}</p>' * 4}</div></article>", LONG),
        (f"<article>{LONG}<div class=widget><div class=ad>Buy</div>{f'<p>{MORE}</p>' * 3}</div></article>", "\n\n".join([LONG, MORE, MORE, MORE])),
        (f"<article>{LONG}<div class=widget><nav>{MORE}</nav>{f'<p>{MORE}</p>' * 3}</div></article>", "\n\n".join([LONG, MORE, MORE, MORE])),
    ],
)
def test_names_are_whole_tokens_and_can_be_overruled(html, text):
    assert html_text.main_text(html) == text


OTHER = "Kaupungin vanhin silta rakennettiin uudelleen, koska talven tulvat veivät sen mukanaan."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<nav>{MORE}</nav><p>{OTHER}</p><p>Lyhyt.</p>", f"{OTHER}\n\nLyhyt."),
        (f"<nav>{MORE}</nav><pre>{'x = f(y); ' * 10}</pre>", ("x = f(y); " * 10).strip()),
        (f"<p>{OTHER}</p><p><a href=x>{OTHER}</a></p>", OTHER),
        (f"<p>{LONG}</p><p>{OTHER}</p>", LONG),
    ],
)
def test_pages_without_known_stop_words_go_by_length_and_links(html, text):
    assert html_text.main_text(html) == text


FOUR = f"<p>{LONG}</p><p>{MORE}</p>" * 2
FOUR_TEXT = "\n\n".join([LONG, MORE] * 2)
LINKED = "See <a href=x>this long link text that is most of it</a> now."
LINKED_TEXT = "See this long link text that is most of it now."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div id=content>{FOUR}</div><aside><article><p>Teaser</p></article></aside>", FOUR_TEXT),
        (f"<div id=content>{FOUR}</div><footer><article><p>{LONG}</p></article></footer>", FOUR_TEXT),
        (f"<div>{FOUR}</div><div class=related><article><p>{MORE}</p></article></div>", FOUR_TEXT),
        (f"<div>{FOUR}</div><div><article><p>Teaser.</p></article></div>", f"{FOUR_TEXT}\n\nTeaser."),
        (f"<article>{FOUR}</article><aside><article><p>{MORE}</p></article></aside>", FOUR_TEXT),
        (f"<article>{FOUR}<div class=related><article><p>{MORE}</p></article></div></article>", FOUR_TEXT),
        (f"<nav><a href=x>never closed</a><article>{FOUR}</article>", FOUR_TEXT),
        (f"<div class=page-widget><article><p>{LONG}</p></article></div>", LONG),
        (f"<form><article><p>{LONG}</p></article></form>", LONG),
        (f"<div role=complementary><article>Teaser</article></div>{FOUR}", FOUR_TEXT),
    ],
)
def test_the_article_with_the_running_text_counts(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><p>{LONG}</p><p>{LINKED}</p><p>{MORE}</p></article>", f"{LONG}\n\n{LINKED_TEXT}\n\n{MORE}"),
        (f"<article><p>{LONG}</p><ul><li><a>One</a></li><li><a>Two</a></li></ul><p>{MORE}</p></article>", f"{LONG}\n\nOne\n\nTwo\n\n{MORE}"),
        (f"<article><p>{LONG}</p><ul><li><a>One</a></li><li><a>Two</a></li></ul></article>", LONG),
        (f"<article><a>One</a><p>{LONG}</p></article>", LONG),
    ],
)
def test_links_between_text_of_an_article_stay(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<!-- b</p>c", "a"),
        ("<p>a<!-- b", "a"),
        ("<p>a</p><b", "a\n\n<b"),
        (f"<article>&#{'1' * 5000};&#{'0' * 5000}65;</article>", "\ufffdA"),
    ],
)
def test_unclosed_ends_and_long_references(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("part", ["<svg ", "<svg>", "<a ", "<a x='", '<p x="', "<div>", "<select>", "</", "<!--", "&#1"])
@pytest.mark.parametrize("end", ["", ">", "</p>" * 100_000])
def test_a_megabyte_of_broken_markup_takes_no_two_seconds(part, end):
    begin = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)) + end)
    assert time.process_time() - begin < 2


@pytest.mark.parametrize("html", ["<", "<p", "<p class='x", "</", "<!--", "<script>", "&#;", "a<b>c", "<a" * 50])
def test_broken_markup_does_not_fail(html):
    html_text.main_text(html)


def test_ambiguous_blocks_take_the_nearest_label():
    make = lambda label: html_text.Block("x", 0, False, html_text.TEXT, label)
    t, b = html_text.TEXT, html_text.BOILERPLATE
    blocks = [make(x) for x in (None, t, None, None, None, b, None, None)]
    html_text._inherit(blocks, b)
    assert [x.label for x in blocks] == [t, t, t, b, b, b, b, b]


def test_rows(spark):
    rows = [
        (1, "u", page(f"<article><p>{LONG}</p></article>"), 7),
        (1, "u", page(f"<article><p>{LONG}</p></article>"), 7),
        (2, None, None, 7),
        (None, "v", "", 7),
        (3, "w", page("<article>" + f"<p>{MORE}</p>" * 5000 + "</article>"), 7),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id, r.n_chars) for r in got.collect()), key=str) == sorted(
        [(1, len(LONG)), (1, len(LONG)), (2, 0), (None, 0), (3, 5000 * (len(MORE) + 2) - 2)], key=str
    )
    assert html_text.extract(pages.limit(0)).collect() == []
