"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass decides what it can: a block in a
menu, header, footer, sidebar, form, advert, notice or comment section, or mostly of links, is
boilerplate; a long block, or one dense in stop words, is text. Short blocks in between stay
ambiguous, and the second pass gives them the label of the nearest decided neighbour. A class or id counts
as a name only if the whole token does (``share-bar``, not ``social-science``), and never on html, body,
main or article; a container that only its name makes boilerplate is overruled if it has several
blocks and most of them are long and dense in stop words. Stop words are English, German, French and
Spanish: where no long block of a page is dense in them, as in other languages or in code, long blocks
are text by their length and share of links alone; beside running text, a long block with hardly any
stop words is boilerplate. Where a page names its article, blocks of the article look for neighbours in it, and the rest is boilerplate.
An article inside an aside, a nav, a footer or a container named as boilerplate does not count, unless hardly any
running text is elsewhere; and articles do not count where several running blocks outside hold more than they do.
A block of links in an article is text if it stands between text.

One pass over the tags of a page, two where an article stands in boilerplate, in Arrow batches without a shuffle;
whole pages, nothing capped. The time of a pass grows with the page's length, of broken markup as well.

Defined results: a null page is empty and gives an empty text; a page without tags is one block;
tags that are never closed end with their surroundings; of elements that are left out whole, only
scripts, styles and comments run to the end of the page when unclosed, of others just the tag, a
title's text and a list's options go; what a head holds besides those is text; where nothing is decided, all ambiguous
blocks are text; at equal distances text wins in an article and boilerplate elsewhere; repeated rows give equal rows; an empty table gives an empty result; other columns play no
part.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from assaylake.llm.common import text_of
from assaylake.llm.quality_rules import STOP_WORDS

#: Characters of a long block.
LONG = 70
#: A block with more of its characters in links is boilerplate.
MAX_LINKED = 0.5
#: Stop words among the words of running text, and of what is hardly any.
DENSE, SPARSE = 0.25, 0.08
#: Blocks that a container needs to overrule its name: an advert or a notice may be a long sentence.
OVERRULES = 3
#: Articles in boilerplate count if they raise a page's running text more than so many times.
RAISES = 4

# Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside body details dialog div dl fieldset figure footer form header html li main "
    "menu nav ol section table ul span p h1 h2 h3 h4 h5 h6 td th tr a".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
#: Of these, those that hold no main text even if an article stands in them; and such roles.
SEALED_TAGS = frozenset("nav footer aside".split())
SEALED_ROLES = frozenset("navigation contentinfo complementary".split())
ARTICLE_TAGS = frozenset(("article", "main"))
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted "
    "sponsor sponsored sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer foot bottom cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe subscription signup login popup modal overlay paywall share sharing "
    "social related recommended recommendations pagination pager widget widgets toolbar "
    "disclaimer copyright skip search".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist respond replies reply disqus".split())
#: What may stand beside such a name in one token, as in share-bar.
NAME_PARTS = frozenset(
    "area bar block body bottom box button buttons column container content footer group head "
    "header icons inner item items left link links list main outer page panel posts primary right "
    "secondary section site slot top unit wrap wrapper".split()
)
#: Their classes and ids say nothing of what is in them.
UNNAMED = frozenset("html body main article".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert menu menubar form".split()
)
BREAKS = frozenset(("br", "td", "th", "wbr"))

# Elements that are left out whole, and those that run to the end if unclosed.
SKIPPED = frozenset(
    "script style noscript template title svg iframe object textarea select button canvas audio "
    "video".split()
)
RUNS_ON = frozenset(("script", "style"))

# a quoted value may hold any character; a quote that nothing fits ends with the tag
_TOKEN = re.compile(
    r"<!--.*?(?P<end>-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)"
    r"(?P<attributes>(?:[^>\"'=]|=(?!\s*[\"'])|=\s*(?:\"[^\"]*\"|'[^']*')(?=[\s/>]))*+|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.DOTALL,
)
_ENDS = {
    name: re.compile(rf"<{'/' if name in RUNS_ON else '/?'}{name}(?=[\s/>])[^>]*>", re.IGNORECASE)
    for name in SKIPPED
}
_LEFT_OPEN = {
    "title": re.compile(r"[^<]*"),
    "select": re.compile(
        r"(?:\s*<(?:option|optgroup)(?=[\s/>])[^>]*>[^<]*(?:</(?:option|optgroup)\s*>)*)*",
        re.IGNORECASE,
    ),
}
_ATTRIBUTE = re.compile(
    r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?",
    re.IGNORECASE,
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PARTS = re.compile(r"[-_]+")
_NUMBER = re.compile(r"\d+(?:x\d+)?")
_STOP = frozenset(STOP_WORDS)
_WORD = re.compile(r"\w+")
# decimal references of any length; those of eight digits are no character either
_ZEROS, _DIGITS = re.compile(r"&#0+(?=[0-9])"), re.compile(r"(&#[0-9]{8})[0-9]+")

TEXT, BOILERPLATE, SEALED, COMMENT = "text", "boilerplate", "sealed", "comment"
#: Contexts from the weakest to the strongest.
_CONTEXTS = (TEXT, BOILERPLATE, SEALED, COMMENT)
#: Provisional label of a block of links.
LINKS = "links"


@dataclass
class Block:
    text: str
    linked: int
    in_article: bool
    context: str
    label: str | None = None


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a whole token of a class or id is one of the names, or made of one and parts that
    say where or how it stands."""
    for token in value.lower().split():
        parts = {_NUMBER.sub("", part) for part in _PARTS.split(token)} - {""}
        if parts & names and not parts - names - NAME_PARTS:
            return True
    return False


def _context(name: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """What a tag says about what is in it, and whether its class or id names boilerplate."""
    found, named = TEXT, False
    if name in BOILERPLATE_TAGS or (name == "header" and not in_article):
        found = SEALED if name in SEALED_TAGS else BOILERPLATE
    if not attributes:
        return found, named
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key in ("class", "id"):
            if name in UNNAMED:
                continue
            if _named(value, COMMENT_NAMES):
                return COMMENT, False
            if name != "h1" and not (in_article and name == "header"):
                named = named or _named(value, BOILERPLATE_NAMES)
        elif key == "role" and value.lower() in BOILERPLATE_ROLES:
            found = SEALED if value.lower() in SEALED_ROLES else _stronger(found, BOILERPLATE)
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            found = _stronger(found, BOILERPLATE)
        elif key == "style" and _HIDDEN.search(value):
            found = _stronger(found, BOILERPLATE)
    return found, named


def _stronger(one: str, other: str) -> str:
    return max(one, other, key=_CONTEXTS.index)


def _plain(html: str) -> str:
    """Text with its character references decoded and white space turned into single spaces."""
    return " ".join(unescape(_DIGITS.sub(r"\1", _ZEROS.sub("&#", html))).split())


def _skip(html: str, name: str, at: int, last: int) -> int:
    """Where an element that is left out whole ends, if its tag ends at ``at`` and the page's last
    tag at ``last``."""
    end = _ENDS[name].search(html, at, last)
    if end and end[0].startswith("</"):
        return end.end()
    if name in RUNS_ON:
        return len(html)
    # the next tag of the name opens another one, or there is none
    return _LEFT_OPEN[name].match(html, at).end() if name in _LEFT_OPEN else at


def blocks_of(html: str, anywhere: bool = False) -> tuple[list[Block], bool]:
    """The blocks of a page in page order, without empty ones, and whether it has articles in
    boilerplate; these count as articles only with ``anywhere``."""
    blocks: list[Block] = []
    in_boilerplate = False
    parts: list[str] = []
    linked: list[str] = []
    # open containers: name, context, whether an article holds them and the innermost named one
    opened: list[tuple[str, str, bool, int]] = []
    names: Counter[str] = Counter()
    # of the containers named as boilerplate the one around, and of blocks the innermost named one
    around: list[int] = []
    inside: list[int] = []
    breaks = 0

    def end_block() -> None:
        nonlocal breaks
        breaks = 0
        if parts:
            text = _plain("".join(parts))
            if text:
                _, context, in_article, named = opened[-1] if opened else ("", TEXT, False, -1)
                share = _plain("".join(linked))
                blocks.append(Block(text, len(share), in_article, context))
                inside.append(named)
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        nonlocal breaks
        if not text:
            return
        parts.append(text)
        if not text.isspace():
            breaks = 0
        if any(container[0] == "a" for container in reversed(opened[-4:])):
            linked.append(text)

    def close(name: str) -> None:
        closed = "" if names[name] else name
        while closed != name:
            closed = opened.pop()[0]
            names[closed] -= 1

    # no tag ends behind the last bracket, so nothing is searched for there
    at, last = 0, html.rfind(">") + 1
    while token := _TOKEN.search(html, at, last):
        add(html[at : token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            if token["end"] == "":
                at = len(html)
            continue
        name = name.lower()
        if name in SKIPPED:
            if not token["close"] and not token["attributes"].endswith("/"):
                at = _skip(html, name, at, last)
            continue
        if name in BREAKS:
            parts.append(" ")
            breaks += name == "br" and not token["close"]
            if breaks == 2:
                end_block()
            if name not in CONTAINERS:
                continue
        if name in BLOCKS:
            end_block()
        if name not in CONTAINERS:
            continue
        if token["close"]:
            close(name)
            continue
        if name in BLOCKS and opened and opened[-1][0] in CLOSED_BY_BLOCK:
            names[opened.pop()[0]] -= 1
        _, outer, in_article, innermost = opened[-1] if opened else ("", TEXT, False, -1)
        own, named = _context(name, token["attributes"], in_article)
        if name in ARTICLE_TAGS and own == TEXT and outer != COMMENT:
            inner = outer == SEALED or innermost >= 0
            in_boilerplate = in_boilerplate or inner
            if anywhere or not inner:
                outer, in_article, innermost = TEXT, True, -1
        if not token["attributes"].endswith("/"):
            context = _stronger(outer, own)
            if named:
                around.append(innermost)
                innermost = len(around) - 1
            opened.append((name, context, in_article and context != COMMENT, innermost))
            names[name] += 1
    add(html[at:].partition("<!--")[0])
    end_block()
    _overrule(blocks, inside, around)
    return blocks, in_boilerplate


def _overrule(blocks: list[Block], inside: list[int], around: list[int]) -> None:
    """Blocks in a container that is named as boilerplate are, unless its blocks and those of all
    named ones around it say otherwise."""
    whole, running = [0] * len(around), [0] * len(around)
    for block, named in zip(blocks, inside, strict=True):
        if named >= 0:
            whole[named] += 1
            running[named] += block.context == TEXT and _runs(block)
    for named in range(len(around) - 1, -1, -1):
        if around[named] >= 0:
            whole[around[named]] += whole[named]
            running[around[named]] += running[named]
    stays = []
    for n, of_these, outer in zip(running, whole, around, strict=True):
        overruled = n >= OVERRULES and 2 * n > of_these
        stays.append(not overruled or (outer >= 0 and stays[outer]))
    for block, named in zip(blocks, inside, strict=True):
        if named >= 0 and stays[named] and block.context == TEXT:
            block.context = BOILERPLATE


def _density(block: Block) -> float:
    words = _WORD.findall(block.text.lower())
    return sum(w in _STOP for w in words) / max(len(words), 1)


def _runs(block: Block) -> bool:
    """Whether a block is long, not of links and dense in stop words."""
    length = len(block.text)
    return length >= LONG and block.linked <= MAX_LINKED * length and _density(block) >= DENSE


def _decide(block: Block, stops: bool) -> str | None:
    """The first pass: text, boilerplate, or none if the block is ambiguous; ``stops`` says whether
    the page's stop words can tell."""
    if block.context != TEXT:
        return BOILERPLATE
    length = len(block.text)
    if block.linked > MAX_LINKED * length:
        return LINKS if block.in_article else BOILERPLATE
    if block.in_article:
        return TEXT if length >= LONG else None
    if length >= LONG:
        density = _density(block) if stops else 1.0
        return TEXT if density >= DENSE else BOILERPLATE if density < SPARSE else None
    return None


def _is_text(block: Block) -> bool:
    return block.context == TEXT and block.linked <= MAX_LINKED * len(block.text)


def _running(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks if len(b.text) >= LONG and _is_text(b))


def _with_articles(html: str) -> list[Block]:
    """The blocks of a page, those told to be of an article that are of its main text."""
    blocks, in_boilerplate = blocks_of(html)
    if in_boilerplate:
        others, _ = blocks_of(html, anywhere=True)
        if _running(others) > RAISES * _running(blocks):
            blocks = others
    within = sum(len(b.text) for b in blocks if b.in_article and _is_text(b))
    outside = [len(b.text) for b in blocks if not b.in_article and b.context == TEXT and _runs(b)]
    if len(outside) >= OVERRULES and sum(outside) > within:
        for block in blocks:
            block.in_article = False
    return blocks


def classify(html: str) -> list[Block]:
    """The blocks of a page with their labels."""
    blocks = _with_articles(html)
    named = any(b.in_article and b.context == TEXT for b in blocks)
    stops = not named and any(b.context == TEXT and _runs(b) for b in blocks)
    for block in blocks:
        outside = named and not block.in_article
        block.label = BOILERPLATE if outside else _decide(block, stops)
    _inherit([b for b in blocks if b.in_article and b.context == TEXT], TEXT)
    _inherit([b for b in blocks if not b.in_article], BOILERPLATE)
    return blocks


def _inherit(blocks: list[Block], otherwise: str) -> None:
    """The second pass: ambiguous blocks take the label of the nearest decided one; links are text
    if they stand between text."""
    labels = [None if b.label == LINKS else b.label for b in blocks]
    before = _nearest(labels)
    after = _nearest(labels[::-1])[::-1]
    for block, label, (left, far_left), (right, far_right) in zip(
        blocks, labels, before, after, strict=True
    ):
        if block.label == LINKS:
            block.label = TEXT if left == right == TEXT else BOILERPLATE
        elif label is None:
            if left is None and right is None:
                block.label = TEXT
            elif left == right or far_left == far_right:
                block.label = left if left == right else otherwise
            else:
                block.label = left if far_left < far_right else right


def _nearest(labels: list[str | None]) -> list[tuple[str | None, float]]:
    """For each place the last label before it and how far back it is."""
    out, last, distance = [], None, float("inf")
    for label in labels:
        out.append((last, distance + 1))
        if label is not None:
            last, distance = label, 0
        else:
            distance += 1
    return out


def main_text(html: str) -> str:
    return "\n\n".join(b.text for b in classify(html) if b.label == TEXT)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column("html")]
        columns = {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array(map(len, texts), pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
