"""A tolerant HTML reader: elements that matter for layout, text blocks, and what is boilerplate."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

#: Comments, tags, other markup, and a tag that the page's end cuts off. Quotes hold a value after = only; nothing is tried twice, so
#: that no page takes more than about linear time.
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^<>=]+|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>]++)))?")
#: Elements by their part in a page.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button svg".split()
)
CONTAINERS = frozenset("article body center div main section td blockquote dd details".split())
CLOSED_BY_BLOCK = frozenset(["p"])
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button select svg menu dialog".split()) | RAW
#: A container is boilerplate by a class or id made of the first words and of words for parts of a layout or of an article alone (but not
#: for an article's head), or of the suspect words alone where no other name is one for articles. Any of these words within a longer name counts only if half of the container's
#: text stands in links; so it does for paragraphs and headings, whatever their names.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments cookie cookies copyright disclaimer disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted replies reply share sharing sidebar "
    "sidebars social sponsor sponsored subscribe".split()
)
LAYOUT_WORDS = frozenset(
    "area bar block bottom box button buttons column container desktop fixed form global group holder icons inner item items left link links list lists "
    "main mobile overlay page panel primary region right row secondary section site slot sticky top unit wrap wrapper zone".split()
)
HEAD_WORDS = frozenset("banner header masthead".split())
SUSPECT_WORDS = frozenset("login promotion related responses signup skip subscription tags toolbar widget widgets".split())
ARTICLE_WORDS = frozenset("article main content entry post story text body".split())
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())


@dataclass
class Element:
    """step: its part of the generalised path; mark: a number for the whole path; last: the last element inside it, which all between are, too."""

    tag: str
    step: str = ""
    mark: int = 0
    parent: int = -1
    boilerplate: bool = False
    suspect: bool = False
    attributes: dict = field(default_factory=dict)
    last: int = 0


@dataclass
class Block:
    """Text between two block boundaries, its element, and how many of its characters stand in links."""

    text: str
    element: int
    linked: int


@dataclass
class Page:
    elements: list[Element]
    blocks: list[Block]
    title: str
    links: list[str]

    def inside(self, block: Block, element: int) -> bool:
        return element <= block.element <= self.elements[element].last

    def path(self, element: int) -> str:
        steps = []
        while element > 0:
            steps.append(self.elements[element].step)
            element = self.elements[element].parent
        return ">".join(reversed(steps))


def attributes(text: str) -> dict[str, str]:
    """Names and values; those without a value have the empty one."""
    return {name.lower(): unescape(a or b or c) if a or b or c else "" for name, a, b, c in _ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


def step(tag: str, attrs: dict[str, str]) -> str:
    """An element's part of a generalised path: its tag and sorted classes, digits as #."""
    if "class" not in attrs:
        return tag
    names = sorted({re.sub(r"\d+", "#", c.lower().replace(">", "")) for c in attrs.get("class", "").split()})
    return ".".join([tag, *names])


def marked(above: int, step: str) -> int:
    """The number of a path from that of the path above it, the same within one process."""
    return hash((above, step))


def mark_of(path: str) -> int:
    mark = 0
    for part in path.split(">"):
        mark = marked(mark, part)
    return mark


def _decides(words: list[str]) -> bool:
    """Whether a name says by itself that its container is boilerplate. Heads of articles are none."""
    found = BOILERPLATE_WORDS.intersection(words)
    if not found or not (BOILERPLATE_WORDS | LAYOUT_WORDS | ARTICLE_WORDS).issuperset(words):
        return False
    return bool(found - HEAD_WORDS) or (ARTICLE_WORDS - LAYOUT_WORDS).isdisjoint(words)


def judged(tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its tag, role and names, or may be by its names."""
    if not attrs:
        return tag in BOILERPLATE_TAGS, False
    if tag in BOILERPLATE_TAGS or attrs.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in attrs or "display:none" in attrs.get("style", "").lower().replace(" ", ""):
        return True, False
    if tag in ("html", "body", "article", "main") or "class" not in attrs and "id" not in attrs:
        return False, False
    names = [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) for name in (*attrs.get("class", "").split(), attrs.get("id", ""))]
    names = [words for words in names if words]
    bad = BOILERPLATE_WORDS | SUSPECT_WORDS
    if tag in TEXT_TAGS:
        return False, any(not bad.isdisjoint(words) for words in names)
    if any(_decides(words) for words in names):
        return True, False
    for_articles = any(ARTICLE_WORDS.issuperset(words) for words in names)
    if any(SUSPECT_WORDS.issuperset(words) for words in names) and not for_articles:
        return True, False
    return False, any(not bad.isdisjoint(words) for words in names)


def weigh(elements: list[Element], blocks: list[Block]) -> None:
    """Suspect elements with half of their text in links are boilerplate, and all that is inside boilerplate; also each element's last.

    A header inside an article or main loses all but its headings.
    """
    for k in range(len(elements) - 1, -1, -1):
        elements[k].last = max(elements[k].last, k)
        if k:
            above = elements[elements[k].parent]
            above.last = max(above.last, elements[k].last)
    if any(e.suspect for e in elements):
        size, linked = [0] * len(elements), [0] * len(elements)
        for b in blocks:
            size[b.element] += len(b.text)
            linked[b.element] += b.linked
        for k in range(len(elements) - 1, 0, -1):
            size[elements[k].parent] += size[k]
            linked[elements[k].parent] += linked[k]
            elements[k].boilerplate |= elements[k].suspect and 2 * linked[k] >= size[k]
    within, headed = [False] * len(elements), [False] * len(elements)  # inside an article; boilerplate by such a header alone
    for k, e in enumerate(elements[1:], 1):
        above = elements[e.parent]
        within[k] = within[e.parent] or e.tag in ("article", "main")
        own_header = e.tag == "header" and within[e.parent] and not above.boilerplate and "banner" not in e.attributes.get("role", "").lower()
        headed[k] = own_header or headed[e.parent] and not e.boilerplate
        if headed[e.parent] and not e.boilerplate and e.tag in TEXT_TAGS and e.tag != "p":
            headed[k] = False
            continue
        e.boilerplate |= above.boilerplate


def read(html: str | None) -> Page:
    """Elements with their paths, all text blocks in page order, the title and the links. Never fails; null is the empty page."""
    html = html or ""
    elements = [Element("")]
    stack, opened = [0], Counter()
    blocks: list[Block] = []
    links: list[str] = []
    parts: list[str] = []
    linked, in_link, title = 0, False, ""

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, stack[-1], linked))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text)

    at = 0
    while True:
        m = _TAG.search(html, at)
        add(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                close()
                while opened[tag]:
                    top = elements[stack.pop()].tag
                    opened[top] -= 1
                    if top == tag:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if tag == "title" and not title:
                title = " ".join(unescape(html[at : end.start() if end else len(html)]).split())
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            add(" ")
            continue
        attrs = attributes(rest)
        if tag == "a":
            in_link = True
            if "href" in attrs:
                links.append(attrs["href"].strip())
            continue
        if tag not in BLOCKS:
            continue
        close()
        if tag == "hr":
            continue
        top = elements[stack[-1]].tag
        if top == "p" or tag == top and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            opened[elements[stack.pop()].tag] -= 1
        own = step(tag, attrs)
        elements.append(Element(tag, own, marked(elements[stack[-1]].mark, own), stack[-1], *judged(tag, attrs), attrs))
        if not rest.rstrip().endswith("/") or tag not in ("div", "p", "svg"):
            stack.append(len(elements) - 1)
            opened[tag] += 1
    close()
    weigh(elements, blocks)
    return Page(elements, blocks, title, links)


def text_of(page: Page, element: int = 0) -> str:
    """The blocks under an element that are no boilerplate, joined by one space."""
    return " ".join(b.text for b in page.blocks if not page.elements[b.element].boilerplate and page.inside(b, element))
