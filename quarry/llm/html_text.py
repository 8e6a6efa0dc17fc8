"""Main text of raw HTML: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

A streaming pass over the standard library's parser events cuts a page into blocks. Blocks inside
elements that are something else by their tag or role (navigation, footers, asides, forms ...) or can't be
seen never count. Class, id and heading can call an element something else. Names of comments, adverts, notices and sign-ups remove
it; so do repeated boxes, each with an author or a date, after the page's first text. Names that may as well be a topic (search,
related, legal, discussion ...) count for nothing in an article if the element reads like one (text outside links, no repeated boxes), remove it after the page's last
other text, and else make its blocks weigh less: these must be as dense as the article's own. No name counts on headings, inline elements and
paragraphs of an article, on an element that holds the article, or on one that holds most of the text, the first of it included. Each block is a line with a ratio of text outside
links to tags; ratios are smoothed with a Gaussian and lines at or over their standard deviation are
content. The region that is returned is the element that holds the content: the innermost article
or main element with most of it, else the innermost element with nearly all of it; in the
latter case only the blocks from the first to the last content line count, with headings before.

Broken markup: what isn't of the head ends it; an element that isn't seen (noscript, button, svg ...) and has no end tag
hides nothing; comments, scripts and styles without an end reach to the end of the page, as in browsers.

Scale: one page at a time inside map tasks; no shuffle. Time is linear in a page, whatever is in it.

Defined results: null html is empty and gives an empty text; ids may be null or repeat; character
references are decoded; runs of white space in a block become one space and blocks are joined by
\\n; <br> is white space inside its block; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of

_OUT = "id long, url string, text string"
#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas audio video button select datalist textarea".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template head html".split())
OTHER = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in names of elements that aren't the article; those of comments; those that a topic may have, unless
#: one of LISTS stands beside them; those of a part of the article; those of an author or a date; headings of comments.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup paywall "
    "sidebar sidebars nav navbar navigation breadcrumb breadcrumbs pagination pager footer share sharing toolbar copyright".split()
)
COMMENTS = frozenset("comment comments commentlist respond disqus reply replies".split())
TOPICS = frozenset(
    "banner promotion notification notifications overlay menu menus header masthead social related recommended recommendations widget widgets "
    "login search legal disclaimer skip discussion discussions responses thread feedback".split()
)
LISTS = frozenset("posts articles stories links form box bar list icons buttons".split())
PARTS = frozenset("post entry article story content section title".split())
SIGNS = frozenset("author user username byline commenter date time timestamp avatar".split())
SAID_COMMENTS = re.compile(r"(?i)(\d+ )?(reader |user )?(comments?|responses|replies|kommentare?|commentaires?|comentarios?)( \(\d+\))?:?")
_PLAIN, _TOPIC, _MARK, _COMMENT = range(4)
#: An element of the first kind ends open ones of the second when it starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a block weighs whose element may be something else.
WEAK = 0.25
#: Characters that make a first text of the page, before a marked element and before comments; the share of links beyond which a topic isn't one.
FIRST, FIRST_WORDS, LINKED = 80, 20, 0.5
_CONTAINERS = frozenset("table ul ol dl select body html".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Block:
    __slots__ = ("text", "tags", "linked", "box", "heading")

    def __init__(self, text: str, tags: int, linked: int, box: int, heading: bool):
        self.text, self.tags, self.linked, self.box, self.heading = text, tags, linked, box, heading


class _Page(HTMLParser):
    """Blocks of a page and the tree of elements they stand in. Each event takes constant time, but for the elements it ends."""

    def __init__(self, forms: bool):
        super().__init__(convert_charrefs=True)
        self.forms = forms  # forms are left out
        self.open: list[tuple[str, bool, int, int]] = []  # tag, left out, box, number of the unseen element it is or -1
        self.places: dict[str, list[int]] = {}  # where in `open` each tag stands
        self.block_places: list[int] = []
        self.parents, self.kinds, self.marks = [-1], [""], [_PLAIN]  # boxes: block elements that hold others
        self.looks: list[tuple[str, str]] = [("", "")]  # tag and class of each box
        self.signed, self.headed, self.titled = [False], [False], [False]  # whether a box names an author or a date, has a heading, has one of the first level
        self.blocks: list[_Block] = []
        self.left_out = 0
        self.unseen: list[int] = []  # open unseen elements
        self.ended: list[bool] = []  # for each unseen element, whether it was ended by its own tag
        self.around: list[int] = []  # for each, the unseen element around it or -1
        self.within: list[tuple[int, int]] = []  # blocks in unseen elements, and the innermost of these
        self.pieces: list[str] = []
        self.tags = self.linked = self.in_link = 0

    def _last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _within_article(self) -> bool:
        return bool(self.places.get("article") or self.places.get("main"))

    def _is_other(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in OTHER and (tag != "form" or self.forms):
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
            return True
        role = (attrs.get("role") or "").strip().lower()
        if role in ROLES and (self.forms or role != "form"):
            return True
        return tag == "header" and not self._within_article()

    def _mark(self, tag: str, names: set[str]) -> int:
        """What a class or id calls the element."""
        within = self._within_article()
        if tag not in BLOCK or tag in HEADING or (tag == "p" and within) or tag in ("html", "body", "main"):
            return _PLAIN
        if names & COMMENTS:
            return _COMMENT
        if tag == "article":
            return _PLAIN
        if names & MARKS:
            return _MARK
        topics = names & TOPICS
        if tag in ("header", "hgroup") or within or names & PARTS:
            topics -= {"header", "banner", "masthead"}
        if not topics:
            return _PLAIN
        return _MARK if names & LISTS else _TOPIC

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            box = self.open[-1][2] if self.open else 0
            if self.unseen:
                self.within.append((len(self.blocks), self.unseen[-1]))
            heading = any(x[0] in HEADING for x in self.open[-3:])
            self.headed[box] |= heading
            self.titled[box] |= any(x[0] == "h1" for x in self.open[-3:])
            self.blocks.append(_Block(text, self.tags, min(self.linked, len(text)), box, heading))
        self.pieces, self.tags, self.linked = [], 0, 0

    def _close(self, at: int, own: bool = False) -> None:
        """End the elements from `at` on; own: the first of them by its own end tag."""
        if (self.block_places and self.block_places[-1] >= at) or (self.unseen and self.open[at][3] >= 0):
            self._flush()
        while len(self.open) > at:
            tag, other, _, number = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.block_places.pop()
            self.left_out -= other
            self.in_link -= tag == "a"
            if number >= 0:
                self.unseen.pop()
                self.ended[number] = own and len(self.open) == at

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in IN_HEAD and self.places.get("head"):
            self._close(self._last("head"), own=True)  # what isn't of the head ends it
        if tag in BLOCK:
            self._flush()
            if self.places.get("p"):  # a block ends an open paragraph
                self._close(self._last("p"))
        if ended := ENDS.get(tag):
            at = self._last(*ended)
            if at > self._last(*_CONTAINERS):
                self._close(at)
        if tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
            return
        attributes = dict(attrs)
        other = self._is_other(tag, attributes)
        box = self.open[-1][2] if self.open else 0
        names = {w.lower() for name in ("class", "id") for w in _WORD.findall(attributes.get(name) or "")}
        mark = self._mark(tag, names)
        self.signed[box] |= tag in ("time", "cite") or bool(names & SIGNS)
        if tag in BLOCK and tag not in HEADING and (tag != "p" or mark):
            is_main = tag in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
            self.parents.append(box)
            self.kinds.append("main" if is_main else tag)
            self.marks.append(mark)
            self.looks.append((tag, attributes.get("class") or ""))
            self.signed.append(False)
            self.headed.append(False)
            self.titled.append(False)
            box = len(self.parents) - 1
        number = -1
        if tag in UNSEEN:
            if tag not in BLOCK:
                self._flush()
            number = len(self.ended)
            self.ended.append(False)
            self.around.append(self.unseen[-1] if self.unseen else -1)
            self.unseen.append(number)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.block_places.append(len(self.open))
        self.open.append((tag, other, box, number))
        self.left_out += other
        self.in_link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash
        if tag in ("svg", "math"):  # but for these
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
        at = self._last(tag)
        if at < 0:
            if tag in BLOCK:
                self._flush()
        elif tag in BLOCK or tag in UNSEEN or not self.block_places or at > self.block_places[-1]:  # an inline end tag doesn't end blocks
            self._close(at, own=True)

    def handle_data(self, data: str) -> None:
        if self.left_out:
            return
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._close(len(self.open) - 1, own=True)
        self.pieces.append(data)
        if self.in_link:
            self.linked += len(data)

    def finish(self) -> None:
        """Blocks in unseen elements go, unless the element's end tag is missing: then it ended nobody knows where."""
        self._flush()
        if self.open:
            self._close(0)
        hidden: list[bool] = []
        for ended, around in zip(self.ended, self.around, strict=True):
            hidden.append(ended or (around >= 0 and hidden[around]))
        gone = {i for i, number in self.within if hidden[number]}
        self.blocks = [b for i, b in enumerate(self.blocks) if i not in gone]


def _smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / whole


def _totals(page: _Page, values: Iterable[float]) -> np.ndarray:
    """For each box the sum of its blocks' values."""
    out = np.zeros(len(page.parents))
    for b, value in zip(page.blocks, values, strict=True):
        out[b.box] += value
    for box in range(len(out) - 1, 0, -1):  # a box comes after those around it
        out[page.parents[box]] += out[box]
    return out


def _firsts(page: _Page) -> list[int]:
    """For each box its first block, or the number of blocks."""
    first = [len(page.blocks)] * len(page.parents)
    for i in range(len(page.blocks) - 1, -1, -1):
        first[page.blocks[i].box] = i
    for box in range(len(first) - 1, 0, -1):
        first[page.parents[box]] = min(first[page.parents[box]], first[box])
    return first


def _repeated(page: _Page, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes that have a sibling of the same look, both with text and without headings; and those of them of which each names an author or a date."""
    signed, headed = list(page.signed), list(page.headed)
    for box in range(len(signed) - 1, 0, -1):
        signed[page.parents[box]] |= signed[box]
        headed[page.parents[box]] |= headed[box]
    alike: dict[tuple, list[int]] = {}
    for box in range(1, len(dense)):
        if dense[box] and page.kinds[box] != "main":
            alike.setdefault((page.parents[box], page.looks[box]), []).append(box)
    repeated, all_signed = np.zeros(len(dense), bool), np.zeros(len(dense), bool)
    for boxes in alike.values():
        if len(boxes) > 1 and not any(headed[b] for b in boxes):
            repeated[boxes] = True
            all_signed[boxes] = all(signed[b] for b in boxes)
    return repeated, all_signed


def _titled_mains(page: _Page) -> list[bool] | None:
    """For each box whether it holds an article (or the like) with a first heading; None if the page has none."""
    titled, held = list(page.titled), [False] * len(page.parents)
    for box in range(len(titled) - 1, 0, -1):
        titled[page.parents[box]] |= titled[box]
        held[box] |= titled[box] and page.kinds[box] == "main" and page.marks[box] == _PLAIN
        held[page.parents[box]] |= held[box]
    return held if held[0] else None


def _weights(page: _Page) -> np.ndarray:
    """What each block weighs: 1, WEAK, or 0 in an element that isn't of the article."""
    lengths = [len(b.text) - b.linked for b in page.blocks]
    dense, whole, firsts = _totals(page, lengths), _totals(page, [len(b.text) for b in page.blocks]), _firsts(page)
    repeated, signed = _repeated(page, dense)
    mains = [i for i, kind in enumerate(page.kinds) if kind == "main" and page.marks[i] == _PLAIN and dense[i] >= 0.3 * dense[0] and dense[i]]
    around: set[int] = set()
    for i in mains:
        up = page.parents[i]
        while up >= 0 and up not in around:
            around.add(up)
            up = page.parents[up]
    titled = _titled_mains(page)
    is_main = np.zeros(len(dense), bool)
    is_main[mains] = True
    lists = np.zeros(len(dense), int)  # repeated boxes in each box
    for box in range(len(dense) - 1, 0, -1):
        lists[page.parents[box]] += repeated[box] + lists[box]
    scopes, weights, since = np.zeros(len(dense), int), np.ones(len(dense)), np.zeros(len(dense))
    said, counted = 0, 0  # text so far that counts, and blocks looked at
    for box in range(1, len(dense)):
        parent = page.parents[box]
        scope = scopes[box] = box if is_main[box] else scopes[parent]
        weights[box] = weights[parent]
        while counted < firsts[box] and firsts[box] < len(page.blocks):
            b = page.blocks[counted]
            said += lengths[counted] if weights[b.box] and not b.heading else 0
            counted += 1
        if is_main[box]:
            since[box] = said
        mark = page.marks[box]
        if firsts[box] < len(page.blocks):
            b = page.blocks[firsts[box]]
            if not is_main[box] and b.heading and SAID_COMMENTS.fullmatch(b.text) and dense[box] > len(b.text):
                mark = _COMMENT
        if mark < _COMMENT and signed[box]:
            mark = _COMMENT if said - since[scope] >= FIRST else mark
        if mark == _PLAIN or not weights[box] or box in around:
            continue
        begun = said - since[scope] >= (FIRST_WORDS if mark == _COMMENT else FIRST)
        if not begun and dense[box] >= 0.5 * dense[scope] and (scope or titled is None or titled[box]):
            continue  # holds the page's first text and most of it
        if mark == _TOPIC:
            if lists[box] > 1 and begun and page.looks[box][0] not in ("ul", "ol", "dl", "table"):
                weights[box] = 0
            elif not scope or dense[box] < (1 - LINKED) * whole[box] or dense[box] < FIRST:
                weights[box] = min(weights[box], WEAK)
        else:
            weights[box] = 0
    of_blocks = weights[[b.box for b in page.blocks]]
    if not mains:  # what may be something else, after the last text that isn't, goes unless it has a heading
        plain = [i for i, w in enumerate(of_blocks) if w == 1 and lengths[i] >= FIRST_WORDS]
        for i in range(plain[-1] + 1, len(page.blocks)) if plain else ():
            if of_blocks[i] == WEAK and not page.headed[page.blocks[i].box]:
                of_blocks[i] = 0
    return of_blocks


def _region(page: _Page) -> list[_Block]:
    weights = _weights(page)
    page.blocks = blocks = [b for b, w in zip(page.blocks, weights, strict=True) if w]
    weights = weights[weights > 0]
    if not blocks:
        return []
    own = weights * np.array([(len(b.text) - b.linked) / (b.tags + 1) for b in blocks])
    ratios = _smoothed(own)
    least = min(float(ratios.std()), float(ratios.max()))
    # A neighbour's text doesn't make content of a block that weighs less.
    plain = own[(weights == 1) & (ratios >= least)]
    content = (ratios >= least) & ((weights == 1) | (own >= max(least, WEAK * float(np.median(plain)) if len(plain) else 0.0)))
    if not content.any():
        content = ratios >= least
    held = _totals(page, [is_content * weight * len(b.text) for b, is_content, weight in zip(blocks, content, weights, strict=True)])
    mains = [i for i, kind in enumerate(page.kinds) if kind == "main" and held[i] >= 0.3 * held[0] and held[i]]
    best = -1
    in_best = np.zeros(len(held), bool)  # boxes inside the best so far, up to the one looked at
    looked = -1
    for i in mains:
        for box in range(looked + 1, i + 1) if best >= 0 else ():
            in_best[box] = in_best[page.parents[box]] or page.parents[box] == best
        looked = i
        if best < 0 or held[i] > held[best] or (in_best[i] and held[i] >= 0.5 * held[best]):
            best = i
            in_best[:] = False
    if best < 0:
        best = max((i for i in range(len(held)) if held[i] >= 0.7 * held[0]))  # the innermost: boxes with so much lie in each other
    inside = [False] * len(held)
    inside[best] = True
    for box in range(best + 1, len(held)):
        inside[box] = inside[page.parents[box]]
    chosen = [i for i, b in enumerate(blocks) if inside[b.box]]
    if page.kinds[best] != "main":
        marked = [i for i in chosen if content[i]]
        low, high = marked[0], marked[-1]
        while low > chosen[0] and blocks[low - 1].heading:
            low -= 1
        chosen = [i for i in chosen if low <= i <= high]
    return [blocks[i] for i in chosen if content[i] or weights[i] == 1]


_OPENS = re.compile(r"<!--|<(script|style)(?=[\s/>])", re.I)
_ENDS_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style")}
_TAG = re.compile(r"<[A-Za-z/!?]")


def _tidy(html: str) -> str:
    """The page without comments, scripts and styles, and without a tag that never ends: what the parser would look for an
    end of again and again. Marked sections become comments, as HTML has it."""
    out, at = [], 0
    while got := _OPENS.search(html, at):
        out.append(html[at : got.start()])
        if name := got[1]:
            end = _ENDS_OF[name.lower()].search(html, got.end())
            at = end.end() if end else len(html)
        elif html.startswith((">", "->"), got.end()):  # an empty comment
            at = html.index(">", got.end()) + 1
        else:
            end = html.find("-->", got.end())
            at = end + 3 if end >= 0 else len(html)
    out.append(html[at:])
    html = "".join(out).replace("<![", "<! [")
    last = html.rfind(">") + 1
    unended = _TAG.search(html, last)
    return html[: unended.start()] if unended else html


def _blocks(html: str, forms: bool) -> _Page:
    page = _Page(forms)
    page.feed(html)
    page.close()
    page.finish()
    return page


def _dense(page: _Page) -> int:
    return sum(len(b.text) - b.linked for b in page.blocks)


def _all_marked(page: _Page) -> bool:
    """Whether all blocks stand in marked elements."""
    marked = [mark > _PLAIN for mark in page.marks]
    for box in range(1, len(marked)):
        marked[box] = marked[box] or marked[page.parents[box]]
    return all(marked[b.box] for b in page.blocks)


def main_text(html: str) -> str:
    """The main text of a page."""
    html = _tidy(html)
    page = _blocks(html, True)
    if "<form" in html.lower() and _all_marked(page):
        whole = _blocks(html, False)  # some sites wrap the whole page in a form
        if _dense(whole) > 2 * _dense(page):
            page = whole
    return "\n".join(b.text for b in _region(page)) if page.blocks else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text."""
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html")).mapInArrow(_extract, _OUT)
