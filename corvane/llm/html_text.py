"""Main text of web pages: parser events, text-to-tag ratios, and a content region.

The standard library's parser streams events. Text is gathered in blocks (what stands between
block-level tags); each block is a line with a ratio of text to tags. The ratios are smoothed
with a Gaussian, and a two-means threshold splits lines into content and the rest. The content
region is the articles, or else the main element, that hold most of the content lines' text; without
such, the smallest element that holds them all, or where less than that holds most of them, those
of its parts that hold any. Within the region, blocks of menus, notices, adverts, forms and comments are left out by their element.
A mark on an element that turns out to hold most of the content lines' text is lifted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import sliced

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q rb rp "
    "rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img br nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text.
DROPPED = frozenset(
    "script style noscript template head title nav aside footer form button select textarea option "
    "iframe object svg canvas audio video map menu dialog datalist math".split())
#: Elements that keep headings only, where they stand in an article.
HEADERS = frozenset(["header"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that mark an element as something else than main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo "
    "promotion banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead toolbar comment comments commentlist disqus replies reply respond cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget "
    "widgets pagination pager search complementary contentinfo dialog skip".split())
#: Words that leave a compound name such as site-footer or comment-list a name of the marked thing;
#: with any other word (has-sidebar, no-menu) it may name the page that has or lacks the thing.
PARTS = frozenset(
    "area bar block body bottom box buttons container content footer header inner item items links "
    "list main mobile page post primary secondary section site slot title top wrap wrapper".split())
#: Marks that themes also give to what is wrapped around the page.
LAYOUT = frozenset(
    "banner sidebar sidebars menu menus nav navbar navigation footer header masthead toolbar alert "
    "popup modal overlay share sharing social signup login search widget widgets notice notices".split())
#: Marks that name the thing also beside words that say whose or which: user-comments, left-sidebar.
TELLING = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsored promo sidebar sidebars "
    "comment comments commentlist disqus replies cookie cookies consent gdpr newsletter related "
    "recommended recommendations notice notices".split())
#: Words that say that a page has, lacks or shows a thing.
STATES = frozenset(
    "has have had no not non without with is are show shows showing hide hides hidden enable enabled "
    "disable disabled allow allows open opened closed close on off free count supports".split())
ROOTS = frozenset("html body main article".split())
#: What a head may hold; any other tag closes it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Kinds of marks: of layout and forms, of other text and sections, and of what is never text.
WRAPS, OTHER, NEVER = 1, 2, 3
SECTIONS = frozenset("nav aside footer menu dialog".split())
#: Stray end tags of inline elements, paragraphs and items do not close these.
WALLS = frozenset("article main body td table".split())
#: Elements inside a text, which are no region of it, and those that stand between its parts.
FLOWING = INLINE | HEADINGS | {"p", "li", "td", "tr", "blockquote"}
TEXTUAL = FLOWING | {"ul", "ol", "dl", "table", "pre", "figure"}
SIGMA = 1.0
#: Share of the content from which an element counts as the place of most of it.
REGION_SHARE = 0.6


class Element:
    """An element: its place in the tree and what its text counts as.

    ``depth`` counts the elements around it, ``wall`` is the depth of the nearest element that holds
    the page's parts, and ``titled`` says whether its text is kept inside a header.
    """

    __slots__ = ("tag", "parent", "mark", "inside", "header", "index", "depth", "wall", "titled", "in_head")

    def __init__(self, tag: str, parent: Element | None, mark: int, header: bool, index: int = 0):
        self.tag, self.parent, self.mark, self.header, self.index = tag, parent, mark, header, index
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.in_head = tag == "head" or bool(parent and parent.in_head)
        self.wall = self.depth if tag in WALLS else parent.wall if parent else -1
        self.titled = (self.inside if tag in HEADINGS else tag != "header" and bool(parent and parent.titled))


def inherited(elements: list[Element], own) -> list[bool]:
    """Per element, whether ``own`` holds for it or for one around it."""
    out: list[bool] = []
    for e in elements:  # parents come before their children
        out.append(own(e) or bool(e.parent and out[e.parent.index]))
    return out


def summed(elements: list[Element], lines: Iterator[tuple[int, Element]]) -> list[int]:
    """Per element, the sizes of the lines in it and in those inside it."""
    out = [0] * len(elements)
    for size, element in lines:
        out[element.index] += size
    for e in reversed(elements):
        if e.parent:
            out[e.parent.index] += out[e.index]
    return out


def marks_of(value: str) -> set[str]:
    """The words of MARKS that whole names in a class, id or role stand for.

    A name counts if all its words are marks or parts, or if a telling mark is its first or last word
    and none says that something has or lacks it. Words end at other characters than letters, and
    before a capital.
    """
    out: set[str] = set()
    for name in value.split():
        listed = re.findall("[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        words = set(listed)
        if words <= MARKS | PARTS:
            out |= words & MARKS
        elif words.isdisjoint(STATES):
            out |= TELLING & {listed[0], listed[-1]}
    return out


class BlockReader(HTMLParser):
    """Streams a page into blocks: (text, tags met, element, header text that is dropped)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Element("", None, 0, False)
        self.elements = [self.top]
        self.open: dict[str, list[Element]] = {}
        self.blocks: list[tuple[str, int, Element, bool]] = []
        self.words: list[str] = []
        self.tags = 0

    def close_block(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            drop = self.top.header and not self.top.titled
            self.blocks.append((text, max(1, self.tags), self.top, drop))
            self.tags = 0
        self.words = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.words.append("\n")
        if tag not in INLINE:
            self.close_block()
        if tag == "body" and self.top.in_head or (
                self.top.tag == "head" and tag not in IN_HEAD):
            self._leave("head")
        if tag in VOID:
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and self.top.tag in (tag, "p"):
            self._leave(self.top.tag)
        mark = 0
        if tag in DROPPED:
            mark = WRAPS if tag == "form" else OTHER if tag in SECTIONS else NEVER
        elif tag not in ROOTS:
            for name, value in attrs:
                words = marks_of(value) if name in ("class", "id", "role") and value else set()
                if words:
                    mark = max(mark, WRAPS if words <= LAYOUT else OTHER)
                if name == "hidden" or (name == "aria-hidden" and value == "true"):
                    mark = NEVER
        elif tag == "article" and self.top.inside:
            if any(n in ("class", "id") and v and not marks_of(v).isdisjoint(("comment", "comments"))
                   for n, v in attrs):
                mark = OTHER
        self.top = Element(tag, self.top, mark, self.top.header or tag in HEADERS, len(self.elements))
        self.elements.append(self.top)
        self.open.setdefault(tag, []).append(self.top)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.close_block()
        self._leave(tag)

    def _leave(self, tag: str) -> None:
        same = self.open.get(tag)
        if not same or (tag in INLINE | {"p", "li"} and self.top.wall > same[-1].depth):
            return  # a stray end tag does not close what holds the page
        around = same[-1].parent
        while self.top is not around:
            self.open[self.top.tag].pop()
            self.top = self.top.parent

    def handle_data(self, data: str) -> None:
        if self.top.tag == "head" and data.strip():
            self._leave("head")
        self.words.append(data)


def content_lines(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are content: smoothed text-to-tag ratios above a two-means threshold."""
    if not len(ratios):
        return np.zeros(0, bool)
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma ** 2))
    smooth = np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(50):
        cut = (low + high) / 2
        above = smooth > cut
        if above.all() or not above.any():
            break
        after = smooth[~above].mean(), smooth[above].mean()
        if after == (low, high):
            break
        low, high = after
    return smooth >= (low + high) / 2


def dropped(elements: list[Element], blocks: list[tuple[str, int, Element, bool]],
            lines: np.ndarray) -> list[bool]:
    """Which blocks go, after marks on what holds most of the content lines' text are lifted.

    Marks of layout are lifted from what holds the article, or where no article has text below its
    headings; marks of other text only where both hold, so long comments don't take the page over.
    """
    never = inherited(elements, lambda e: e.mark >= NEVER)
    flagged = [(len(text), element) for flag, (text, _, element, drop) in zip(lines, blocks)
               if flag and not drop and not never[element.index]]
    mass, total = summed(elements, flagged), sum(size for size, _ in flagged)
    holds = [False] * len(elements)
    for e in reversed(elements):
        if e.parent and mass[e.index] and (holds[e.index] or e.tag in ("article", "main")):
            holds[e.parent.index] = True
    # marked elements that hold most of the text lie inside each other, outer ones first
    marked = [e for e in elements if e.mark and 2 * mass[e.index] > total]
    shut = inherited(elements, lambda e: e.tag in HEADINGS or bool(e.mark and 2 * mass[e.index] <= total))
    around = [0] * len(elements)  # of the marked elements
    for e in elements[1:]:
        around[e.index] = around[e.parent.index] + bool(e.mark and 2 * mass[e.index] > total)
    stories = {around[x.index] for _, _, x, _ in blocks if x.inside and not shut[x.index]}
    story, all_lifted = 0 in stories, True
    for n, e in enumerate(marked, 1):
        held = holds[e.index]
        if (held or not story) if e.mark == WRAPS else (held and not story):
            e.mark = 0
        all_lifted = all_lifted and not e.mark
        story = story or (all_lifted and n in stories)
    gone = inherited(elements, lambda e: bool(e.mark))
    return [drop or gone[element.index] for _, _, element, drop in blocks]


def main_text(html: str | None) -> str:
    """Main text of one page: blocks joined by newlines; empty for null, empty or textless pages.

    Elements are numbered as they open, and what they hold is added up once, so the work grows with
    the page however deep it is.
    """
    if not html:
        return ""
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    reader.close_block()
    blocks, elements = reader.blocks, reader.elements
    ratios = np.array([len(text) / tags for text, tags, _, _ in blocks], float)
    lines = content_lines(ratios)
    gone = dropped(elements, blocks, lines)
    blocks = [(text, tags, element, drop) for (text, tags, element, _), drop in zip(blocks, gone)]
    if not any(flag and not drop for flag, (_, _, _, drop) in zip(lines, blocks)):
        lines = np.ones(len(blocks), bool)
    mass = summed(elements, [(len(text), element) for flag, (text, _, element, drop)
                             in zip(lines, blocks) if flag and not drop])
    if not mass[0]:
        return ""
    return "\n".join(text for text, _, element, drop in kept(elements, blocks, mass) if not drop)


def kept(elements: list[Element], blocks: list[tuple[str, int, Element, bool]],
         mass: list[int]) -> list[tuple[str, int, Element, bool]]:
    """The blocks of the content region; ``mass`` is the content lines' text in each element."""
    total = mass[0]
    for tag in ("article", "main"):
        named = inherited(elements, lambda e: e.tag == tag and mass[e.index] > 0)
        outer = sum(mass[e.index] for e in elements[1:] if named[e.index] and not named[e.parent.index])
        if 2 * outer > total:
            return [b for b in blocks if named[b[2].index]]
    wide = [e for e in elements if mass[e.index] and e.tag not in FLOWING]

    def deepest(least: float) -> Element:
        return max((e for e in wide if mass[e.index] >= least), key=lambda e: (e.depth, mass[e.index]))

    region, whole = deepest(REGION_SHARE * total), deepest(total)
    if mass[region.index] == total:
        within = inherited(elements, lambda e: e is region)
        return [b for b in blocks if within[b[2].index]]
    within = inherited(elements, lambda e: e is whole)
    part: list[Element | None] = []  # the child of the whole that an element lies in
    for e in elements:
        part.append(e if e.parent is whole else part[e.parent.index] if e.parent else None)
    out = []
    for b in blocks:
        if within[b[2].index]:
            p = part[b[2].index]
            if p is None or mass[p.index] or p.tag in TEXTUAL:
                out.append(b)
    return out


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by text and n_chars (its code points).

    Each whole page is parsed by itself, without a shuffle; pages reach Python in bounded slices.
    Null, empty and textless pages give an empty text. Other columns stay; columns named text
    and n_chars are replaced.
    """
    keep = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep),
                        "text string", "n_chars long"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, html):
            texts = [main_text(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in keep), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                [*(f.name for f in keep), "text", "n_chars"])

    return pages.select(*[F.col(f"`{f.name}`") for f in keep], html).mapInArrow(extract, schema)
