"""Main text of HTML pages from flat text blocks and a decision tree.

The page is read once into flat blocks of text (what stands between block-level tags). A
block is described by its word count and link density, those of its neighbours, and the size
and link density of the box around it; a decision tree, grown from the blocks of the small
labelled table of page layouts below, says whether it is main text. Names of classes and ids
are one feature among these and decide nothing alone: many of the table's layouts are learned
without their names too, and misleading names stand around main text in others. Scripts, styles and
other elements without text for readers give no blocks and split none.

Rows: null and empty html give the empty text; unclosed and unmatched tags are tolerated;
repeated rows are answered each; extra columns pass through extract() as they are, but for
those it returns itself; an empty table gives an empty result. A page is held by one task,
as text, elements and blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: elements by role
SILENT = "script style noscript template textarea select option svg canvas iframe object head title datalist".split()
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter mi mn mo mrow ms msqrt msub msubsup msup mfrac mtext nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav aside footer form button menu dialog fieldset".split())
MAIN = {"article", "main"}
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
#: fixed values: words in class names and ids that hint at what surrounds the main text, at readers' comments, and at main text
ASIDE_NAMES = set("ad ads adv advert adverts advertisement adsense adbox adslot sponsor sponsored promo banner sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended toolbar pagination pager search copyright legal disclaimer tags tagcloud skip".split())
COMMENT_NAMES = set("comment comments respond disqus replies reply discussion review reviews feedback".split())
#: fixed values: elements whose names say how they look, not what they hold
PLAIN = {"body", "html", "blockquote", "pre", "figcaption"}
#: fixed values: elements that hold one paragraph, heading or cell
HEADINGS = {"h1", "h2", "h3"}
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr figcaption".split())
MAIN_NAMES = set("article post entry content story main text body".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SILENT_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in SILENT}
_HEAD_END = re.compile(r"</head\s*>|<body\b[^>]*>", re.I)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    aside: bool  # by its tag or role
    unseen: bool  # hidden from readers
    hint: int  # of its names: -2 comments, -1 surroundings, 0 none, 1 main text
    words: int = 0
    links: int = 0
    title: bool = False  # holds a heading of the page's first level, an article or a main element


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_words: int
    element: int
    heading: bool
    item: bool


def _element(tag: str, attrs: str, parent: int) -> Element:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
    names = {x.lower() for x in _NAME.findall(f"{found.get('class', '')} {found.get('id', '')}")} if tag not in PLAIN else set()
    hint = -2 if names & COMMENT_NAMES else -1 if names & ASIDE_NAMES else 1 if names & MAIN_NAMES else 0
    unseen = "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    return Element(tag if found.get("role", "").lower() != "main" else "main", parent, tag in ASIDE or found.get("role", "").lower() in ASIDE_ROLES, unseen, hint)


def blocks(html: str) -> tuple[list[Block], list[Element]]:
    """The flat blocks of a page in order, and its elements with the words that they hold."""
    out: list[Block] = []
    elements = [Element("", 0, False, False, 0)]
    text: list[str] = []  # pieces of the open block
    linked: list[str] = []
    stack = [0]  # open elements
    heading = item = False
    links = 0

    def close() -> None:
        nonlocal text, linked
        if text:
            words = unescape("".join(text)).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(len(words), len(unescape("".join(linked)).split())), stack[-1], heading, item))
        text, linked = [], []

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece:
            text.append(piece)
            if links:
                linked.append(piece + " ")
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue  # a comment or declaration
        ends = bool(m[1] or m[4])
        if not ends and tag in _SILENT_END:
            if tag != "head":
                stop = _SILENT_END[tag].search(html, at)
                at = stop.end() if stop else n
            elif stop := _HEAD_END.search(html, at):
                at = stop.start() if stop[0][1] != "/" else stop.end()
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if ends else 1
            elif tag == "br":
                text.append(" ")
            continue
        close()
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]].tag == tag or tag in MAIN and elements[stack[k]].tag in MAIN:
                    del stack[k:]
                    links = 0
                    break
            heading, item = False, any(elements[e].tag == "li" for e in stack[-3:])
            continue
        top = elements[stack[-1]].tag
        if tag in ("p", "li", "td", "th", "dt", "dd", "tr") or tag[0] == "h" and tag[1:].isdigit():
            # these end an open one of their kind
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag, "p") if tag != "p" else ("p",))
            if top in same:
                stack.pop()
        elif top == "p":
            stack.pop()
        heading = tag[0] == "h" and tag[1:].isdigit()
        item = tag == "li"
        if tag not in VOID:
            elements.append(_element(tag, m[3] or m[6] or "", stack[-1]))
            stack.append(len(elements) - 1)
    close()
    for b in out:
        elements[b.element].words += b.words
        elements[b.element].links += b.link_words
    elements[0].title = True
    first = min((e.tag for e in elements if e.words and e.tag in HEADINGS), default="h1")
    for e in reversed(elements[1:]):  # children come after their parents
        e.title |= e.tag == first or e.tag in MAIN or e.tag in ("html", "body")
        up = elements[e.parent]
        up.words, up.links, up.title = up.words + e.words, up.links + e.links, up.title or e.title
    return out, elements


FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "heading", "item", "region", "hint", "box words", "box links", "box share", "box title", "article share", "branch links", "branch share", "beside title", "unseen")


def _boxes(elements: list[Element]) -> list[tuple[int, int, int, int, bool]]:
    """For each element (region, hint, box, branch, unseen) of the text right in it. Region: 2 in an article or main element, 1 in none,
    0 where the page has one elsewhere, -1 in an element for surroundings. Box: the nearest element whose tag, role or name says
    something. Branch: the outermost element around it that holds no title, itself if it holds one."""
    article = any(e.tag in MAIN and e.words for e in elements)
    out = [(0 if article else 1, 0, 0, 0, False)]
    for i, e in enumerate(elements[1:], 1):
        region, hint, box, branch, unseen = out[e.parent]
        if e.aside or e.tag == "header" and region != 2:  # an article's own header holds its title
            region, box = -1, i
        elif e.tag in MAIN and region != -1:
            region, hint, box = 2, 0, i
        if e.hint and not (hint < 0 and e.hint > hint):
            hint, box = e.hint, i
        if branch == e.parent and elements[branch].title and e.tag not in LEAVES:
            branch = i
        out.append((region, hint, box, branch, unseen or e.unseen))
    return out


def describe(found: list[Block], elements: list[Element]) -> np.ndarray:
    """A row of FEATURES for each block."""
    size = [0, *(b.words for b in found), 0]
    share = [0.0, *(b.link_words / b.words for b in found), 0.0]
    boxes = _boxes(elements)
    total = max(elements[0].words - elements[0].links, 1)
    in_article = sum(b.words - b.link_words for b in found if boxes[b.element][0] == 2) / total
    rows = []
    for i, b in enumerate(found):
        region, hint, at, up, unseen = boxes[b.element]
        box, branch = elements[at], elements[up]
        rows.append([b.words, share[i + 1], size[i], share[i], size[i + 2], share[i + 2], b.heading, b.item, region, hint, box.words, box.links / max(box.words, 1), (box.words - box.links) / total, box.title, in_article, branch.links / max(branch.words, 1), (branch.words - branch.links) / total, branch.title, unseen])
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


#: The labelled table: page layouts in which {m N} is a block of N words of main text, {x N} one of other words, {a N} N linked words and
#: {l N} N linked words inside main text. Each is learned with main text of three sizes, and those marked with a star also without their names.
LAYOUTS = """
* <body><nav><ul><li>{a 1}</li><li>{a 1}</li><li>{a 2}</li></ul></nav><div class="ad">{x 8}</div><article><h1>{m 7}</h1><p>{m 60}</p><p>{m 12}</p><p>{m 1}</p><p>{m 90}</p></article><footer>{x 9}</footer></body>

* <body><nav><ul><li>{a 1}</li><li>{a 1}</li></ul></nav><div class="ad">{x 14}</div><article><h1>{m 3}</h1><p>{m 2}</p></article><footer>{x 24}</footer></body>

* <body><div class="ad">{x 30}</div><main><h1>{m 5}</h1><p>{m 40}</p><h2>{m 4}</h2><p>{m 70} {l 6} {m 10}</p><ul><li>{m 6}</li><li>{l 3}</li><li>{m 9}</li></ul></main><aside><h3>{x 2}</h3><p>{x 30}</p></aside></body>

<body><header><h1>{x 3}</h1><p>{x 8}</p></header><div class="cookie-notice"><p>{x 25}</p><button>{x 1}</button></div><article><header><h1>{m 8}</h1><p>{m 5}</p></header><p>{m 80}</p><blockquote>{m 20}</blockquote><p>{l 12}</p><div class="related"><h3>{x 2}</h3><ul><li>{a 6}</li><li>{a 7}</li></ul></div><p>{m 30}</p></article><div id="comments"><h2>{x 1}</h2><div class="comment"><p>{x 2}</p><p>{x 40}</p></div><div class="comment"><p>{x 2}</p><p>{x 90}</p></div></div><footer><p>{x 12}</p></footer></body>

* <body><div id="header"><div class="logo">{a 2}</div><div class="slogan">{x 6}</div></div><div id="menu"><div>{a 1}</div><div>{a 1}</div><div>{a 2}</div></div><div id="content"><h1>{m 6}</h1><div>{m 55}</div><div>{m 80}</div><div>{m 8}</div><div>{m 45} {l 4}</div></div><div id="sidebar"><h3>{x 2}</h3><div>{a 5}</div><div>{a 6}</div><p>{x 22}</p></div><div id="footer">{x 10} {a 2}</div></body>

* <body><div class="top-banner">{x 12}</div><div class="story-header"><h1>{m 9}</h1><p>{m 50}</p><p>{m 75}</p><p>{m 20}</p></div><div class="promo-box"><p>{x 14}</p></div><div class="newsletter"><p>{x 18}</p></div><div class="copyright">{x 7}</div></body>

<body><div class="nav">{a 1} {a 1} {a 1}</div><div class="sidebar-layout"><h1>{m 5}</h1><p>{m 60}</p><p>{m 30}</p><h2>{m 3}</h2><p>{m 40}</p><div class="ad-slot">{x 9}</div><p>{m 25}</p></div><div class="side"><p>{x 20}</p></div></body>

* <body><article class="sidebar-layout"><h1>{m 4}</h1><p>{m 35}</p><section class="related-work"><h2>{m 2}</h2><p>{m 60}</p><p>{m 50}</p></section><section class="notice-board-history"><h2>{m 3}</h2><p>{m 45}</p><p>{m 30}</p></section><blockquote class="social">{m 18}</blockquote><p>{m 20}</p></article><footer class="legal">{x 30}</footer></body>

<body><article><h1>{m 6}</h1><p>{m 40}</p><div class="ad">{x 10}</div><p>{m 60}</p><div class="advert"><p>{x 25}</p></div><p>{m 5}</p><div class="share">{a 1} {a 1}</div><div class="newsletter-signup"><p>{x 16}</p></div><p>{m 33}</p><section class="comments"><h3>{x 2}</h3><p>{x 55}</p><p>{x 70}</p></section></article></body>

<body><article><div class="header"><h1>{m 6}</h1><p>{m 14}</p></div><div class="body"><p>{m 70}</p><table><tr><td>{m 2}</td><td>{m 1}</td></tr><tr><td>{m 3}</td><td>{m 1}</td></tr></table><p>{m 15}</p><pre>{m 12}</pre></div><div class="tags">{a 1} {a 2}</div><aside>{x 40}</aside></article><div class="related"><h3>{x 2}</h3><p>{a 8}</p><p>{a 7}</p></div></body>

<body><table><tr><td class="menu">{a 1}</td><td class="menu">{a 2}</td></tr></table><h1>{m 5}</h1><p>{m 45}</p><p>{m 65}</p><p>{m 12} {l 3} {m 20}</p><p>{m 6}</p><hr><p class="footer">{x 8}</p></body>

<body><ul class="nav"><li>{a 1}</li><li>{a 1}</li><li>{a 1}</li><li>{a 2}</li></ul><div class="post"><h2>{m 7}</h2><div class="meta">{a 2} {a 1}</div><p>{m 85}</p><p>{m 40}</p><ul><li>{m 12}</li><li>{m 9}</li><li>{m 15}</li></ul><p>{m 50}</p></div><div class="pagination">{a 1} {a 1}</div><div class="widget"><p>{x 20}</p></div><div class="disclaimer">{x 35}</div></body>

* <body><div class="menu"><a href="#">home</a></div><form><p>{x 6}</p><label>{x 2}</label></form><div class="main"><h1>{m 4}</h1><dl><dt>{m 2}</dt><dd>{m 20}</dd><dt>{m 1}</dt><dd>{m 16}</dd></dl><p>{m 30}</p></div><div role="complementary"><p>{x 25}</p></div><div class="consent">{x 40}</div></body>

<body><div class="alert">{x 15}</div><main><section><h1>{m 5}</h1><p>{m 3}</p></section><section><h2>{m 2}</h2><p>{m 100}</p><p>{m 4}</p></section><section class="reviews"><h2>{x 2}</h2><p>{x 35}</p><p>{x 20}</p></section><form><p>{x 12}</p></form></main><div class="subscribe"><p>{x 10}</p></div></body>

<body><div class="comment-article"><h1>{m 8}</h1><p>{m 60}</p><p>{m 75}</p><p>{m 55}</p></div><div class="comment-list"><p>{x 30}</p><p>{x 25}</p></div><div class="sponsor">{x 12}</div></body>

<body><article><h1>{m 5}</h1><p>{m 30}</p></article><article><h1>{m 6}</h1><p>{m 25}</p><nav>{a 2}</nav></article><div id="discussion"><h2>{x 1}</h2><p>{x 60}</p><p>{x 120}</p></div><div class="notice">{x 22}</div><footer><ul><li>{a 1}</li><li>{a 1}</li></ul><p>{x 14}</p></footer></body>

* <body><p>{m 40}</p><p>{m 60}</p><p>{m 20}</p></body>

* <body><h1>{m 3}</h1><p>{m 6}</p></body>

* <body><div><div>{a 1}</div><div>{a 1}</div><div>{a 1}</div></div><div><p>{m 60}</p><p>{m 45}</p><p>{m 70}</p></div><div><div>{a 4}</div><div>{a 5}</div></div><p>{a 2} {a 2} {a 3}</p></body>

* <body><div class="teasers"><article><h3>{a 5}</h3><p>{x 9}</p></article><article><h3>{a 6}</h3><p>{x 8}</p></article><article><h3>{a 4}</h3></article></div><div class="content"><h1>{m 6}</h1><p>{m 70}</p><p>{m 55}</p><p>{m 80}</p><p>{m 40}</p></div><footer>{x 10}</footer></body>

* <body><div class="page"><h1>{m 6}</h1><p>{m 3}</p><p>{m 90}</p><h2>{m 2}</h2><p>{m 50}</p></div><div class="ad">{x 9}</div></body>

* <body><div class="banner">{x 11}</div><div class="wrap"><h1>{m 7}</h1><p>{m 30}</p><p>{m 60}</p><p>{m 7}</p></div><div class="footer">{x 13}</div></body>

* <body><article><p>{m 30}</p><p>{m 2}</p><p>{m 8}</p><p>{l 4}</p><h2>{m 3}</h2><h3>{m 1}</h3><p>{m 60}</p><ol><li>{m 1}</li><li>{m 4}</li></ol><p>{m 1}</p></article></body>

* <body><header><p>{x 50}</p></header><nav><p>{x 45}</p><ul><li>{a 2}</li></ul></nav><article><h1>{m 6}</h1><p>{m 25}</p><p>{m 60}</p><aside><p>{x 70}</p><p>{x 90}</p></aside><p>{m 12}</p><form><p>{x 60}</p></form></article><aside><h2>{x 3}</h2><p>{x 80}</p><p>{x 55}</p></aside><footer><p>{x 100}</p><p>{x 45}</p></footer></body>

* <body><nav>{a 1} {a 1}</nav><div class="intro"><h1>{m 4}</h1><p>{m 20}</p><p>{m 65}</p></div><footer><p>{x 60}</p><p>{x 120}</p></footer><aside><p>{x 75}</p></aside></body>

<body><div class="notice"><p>{x 60}</p></div><div id="content"><h1>{m 6}</h1><p>{m 50}</p><p>{m 44}</p><div class="advert"><p>{x 70}</p></div><p>{m 60}</p></div><div id="sidebar"><p>{x 55}</p><p>{x 65}</p></div><div class="disclaimer"><p>{x 90}</p></div></body>

<body><article><h1>{m 4}</h1><p>{m 70}</p><p>{m 30}</p><div class="promo"><p>{x 50}</p></div><p>{m 48}</p><div id="comments"><p>{x 3}</p><p>{x 80}</p><p>{x 60}</p></div></article><div class="cookie"><p>{x 75}</p></div></body>

<body><article><h1>{m 5}</h1><p>{m 40}</p><div class="comments"><p>{x 51}</p></div></article><section id="comments"><p>{x 900}</p><p>{x 300}</p><p>{x 200}</p></section></body>

<body><div id="text"><h1>{m 5}</h1><p>{m 40}</p><p>{m 30}</p></div><div id="replies"><p>{x 2}</p><p>{x 600}</p><p>{x 2}</p><p>{x 500}</p><p>{x 700}</p></div></body>

<body><article><h1>{m 4}</h1><p>{m 50}</p><p>{m 20}</p></article><div class="comment-section"><div><p>{x 700}</p></div><div><p>{x 800}</p></div></div></body>

* <body><article><h1>{m 4}</h1><div hidden>{x 30}</div><p>{m 50}</p><div style="display: none"><p>{x 60}</p><p>{x 12}</p></div><p>{l 8}</p><p>{m 20}</p><div aria-hidden="true">{x 14}</div><p>{m 6}</p></article></body>

* <body><article><h1>{m 4}</h1><p>{m 12}</p><p>{l 7}</p><p>{m 30}</p><p>{l 11}</p><p>{l 2}</p><p>{m 40}</p><nav>{a 3}</nav><p>{l 10}</p><p>{m 5}</p></article></body>

* <body><nav><ul><li>{a 1}</li><li>{a 1}</li></ul></nav><div class="ad">{x 8}</div><article><h1>{m 7}</h1><p>{m 7}</p></article><footer>{x 8}</footer></body>

* <body><nav>{a 1} {a 1}</nav><div class="ad">{x 11}</div><article><h1>{m 5}</h1><p>{m 10}</p><p>{m 3}</p></article><footer>{x 14}</footer></body>

* <body><article><h1>{m 6}</h1></article><footer>{x 6}</footer></body>

* <body><header>{x 6}</header><article><p>{m 9}</p><p>{m 6}</p></article><aside>{x 40}</aside></body>

* <body><main><p>{m 8}</p></main><footer>{x 30}</footer></body>

* <body><nav>{a 1}</nav><div class="story-header"><h1>{m 3}</h1><p>{m 40}</p></div></body>

* <body><nav>{a 1} {a 2}</nav><div class="related-work"><h1>{m 4}</h1><p>{m 30}</p><p>{m 25}</p></div></body>

* <body><div class="notice-board-history"><h1>{m 2}</h1><p>{m 60}</p></div><footer>{x 9}</footer></body>

* <article><div class="sidebar-layout"><h1>{m 2}</h1><p>{m 40}</p></div></article>

<body><nav>{a 1}</nav><article><h1>{m 3}</h1><p>{m 14}</p><p>{m 6}</p><div class="ad">{x 11}</div><p>{m 2}</p></article><section class="comments"><p>{x 12}</p></section><footer>{x 3}</footer></body>

<body><article><h1>{m 4}</h1><p>{m 12}</p><div class="advert">{x 9}</div><p>{m 20}</p><div class="subscribe"><p>{x 14}</p></div></article></body>

<body><div class="post"><h1>{m 4}</h1><p>{m 16}</p><div class="ad">{x 10}</div><p>{m 20}</p></div><div class="notice">{x 16}</div></body>

* <body><article class="footer-notes"><h1>{m 4}</h1><div class="nav-history"><p>{m 30}</p><p>{m 45}</p></div><div class="side-effects"><p>{m 50}</p><p>{m 24}</p></div></article></body>

* <body><article><h1>{m 5}</h1><p>{m 10}</p><div class="cookie-recipe"><p>{m 33}</p><p>{m 41}</p></div><div class="alert-system"><h2>{m 2}</h2><p>{m 38}</p><p>{m 29}</p></div><p>{m 8}</p></article><footer>{x 12}</footer></body>

* <body><article class="promo-history"><h1>{m 5}</h1><p>{m 36}</p><section class="banner-year"><p>{m 47}</p><p>{m 19}</p></section><section class="menu-prices"><p>{m 52}</p><p>{m 16}</p></section><section class="search-party"><p>{m 44}</p><p>{m 34}</p></section></article></body>

* <body><nav>{a 1} {a 1}</nav><article><h1>{m 4}</h1><p>{m 2}</p><p>{m 6}</p><ul><li>{l 2}</li><li>{m 3}</li><li>{l 1}</li><li>{l 5}</li></ul><p>{m 12}</p></article><footer>{x 13}</footer></body>

* <body><article><h1>{m 4}</h1><p>{m 20}</p><ol><li>{m 2}</li><li>{l 3}</li><li>{m 1}</li><li>{m 14}</li></ol><p>{l 2}</p></article></body>

* <body><nav>{a 1} {a 1}</nav><article><h1>{m 6}</h1><div><p>{m 30}</p><p>{m 55}</p><p>{m 14}</p></div><div><p>{m 20}</p></div></article><footer>{x 11}</footer></body>

* <body><header>{a 2} {a 1}</header><article><div><h1>{m 6}</h1><p>{m 4}</p></div><div><div><p>{m 62}</p><p>{m 35}</p></div><div><p>{m 40}</p><p>{m 5}</p></div></div></article><div class="ad">{x 9}</div></body>

* <body><div>{a 1} {a 1} {a 1}</div><div><div><h1>{m 5}</h1></div><div><p>{m 52}</p><p>{m 71}</p><p>{m 18}</p></div></div><div class="side"><p>{x 19}</p></div></body>

* <body><main><h1>{m 4}</h1><div><p>{m 12}</p></div><div><p>{m 44}</p><ul><li>{m 3}</li><li>{m 5}</li></ul></div><div><p>{m 8}</p></div></main><footer>{x 15}</footer></body>
"""
_SLOT = re.compile(r"\{([mxal]) (\d+)\}")
#: factors that the words of the table's main text are learned with
SIZES = (0.1, 1.0, 4.0)


def labelled(layout: str, factor: float = 1.0) -> tuple[str, list[bool]]:
    """(html of a layout, for each of its blocks whether it is main text)."""

    def fill(m):
        kind, n = m[1], int(m[2])
        words = max(1, round(n * factor)) if kind == "m" else n
        mark = "main" if kind in "ml" else "rest"
        text = " ".join([mark] * words)
        return f'<a href="#">{text}</a>' if kind in "al" else text

    html = _SLOT.sub(fill, layout)
    return html, [b.text.startswith("main") for b in blocks(html)[0]]


def unnamed(layout: str) -> str:
    return re.sub(r"""\s(?:class|id)=("[^"]*"|'[^']*')""", "", layout)


def layouts(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n\n") if x.strip()]


def table(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the layouts' blocks."""
    x, y = [np.zeros((0, len(FEATURES)))], [np.zeros(0, dtype=int)]
    for layout in of:
        for variant in [layout.removeprefix("* "), unnamed(layout)[2:]][: 1 + layout.startswith("* ")]:
            for factor in SIZES:
                html, labels = labelled(variant, factor)
                x.append(describe(*blocks(html)))
                y.append(np.array(labels, dtype=int))
    return np.concatenate(x), np.concatenate(y)


@dataclass
class Node:
    main: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None  # at or under the limit
    high: Node | None = None


#: fewest blocks of the labelled table on each side of a limit
LEAST = 2


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Node:
    """A decision tree by Gini impurity, with LEAST rows on each side of a limit; ties go to the earlier feature and smaller limit."""
    node = Node(bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node

    def impurity(v: np.ndarray) -> float:
        p = v.mean() if len(v) else 0.0
        return 2 * p * (1 - p) * len(v)

    best = impurity(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            if min(low.sum(), (~low).sum()) >= LEAST and (score := impurity(y[low]) + impurity(y[~low])) < best - 1e-9:
                best, node.feature, node.limit = score, f, float(limit)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.limit
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


@cache
def tree() -> Node:
    return grow(*table(layouts(LAYOUTS)), depth=10)


def classify(x: np.ndarray, node: Node | None = None) -> np.ndarray:
    node = node or tree()
    if node.low is None:
        return np.full(len(x), node.main)
    low = x[:, node.feature] <= node.limit
    out = np.empty(len(x), dtype=bool)
    out[low], out[~low] = classify(x[low], node.low), classify(x[~low], node.high)
    return out


def main_text(html: str | None) -> str:
    found, elements = blocks(html) if html else ([], [])
    if not found:
        return ""
    return "\n\n".join(b.text for b, keep in zip(found, classify(describe(found, elements)), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col in place of html_col, and n_chars: the main text and its code points."""
    keep = [f for f in pages.schema if f.name not in (html_col, out_col, "n_chars")]

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in keep), out_col, "n_chars"])

    cols = [F.col(f"`{f.name}`") for f in keep]
    return pages.select(*cols, F.col(f"`{html_col}`")).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out_col}` string", "n_chars bigint"]))


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    return extract(pages.select("page_id", "url", "html"))
