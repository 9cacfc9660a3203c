"""Main text of HTML pages.

The standard library's parser streams events over a page. They build lines, a line per block of text, each with the number of
tags in it and the elements around it. The text-to-tag ratio of the lines, smoothed with a Gaussian, is cut in two clusters;
the runs of the upper one are the content regions. The content is the smallest element that holds nearly all text of the regions,
without outer parts that hold little of it; all of its lines, less those in elements that are never content. What elements
are called only weighs: an article or main element counts its text several times, an element named as side matter is left
out unless most of the text of the regions is in it.

Ties: of equally narrow elements there is only one, as they nest; lines keep their order. Repeated rows give equal texts, an empty
table an empty one.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split())
NEVER = frozenset(
    "aside button datalist dialog footer form head iframe menu nav noscript object option script search select style svg "
    "template textarea title".split())
HOLDERS = frozenset("article body center div html main section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup legend caption".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# words in a class or id that name what is not the main text
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer login menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted "
    "promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# words that say nothing of what a class or id names
PLAIN = frozenset(
    "area bar block body bottom box col column container content group inner item items left list main module outer page panel post right row "
    "section site top wrap wrapper".split())
COMMENTS = frozenset("comment comments disqus".split())
BULK = 0.8  # share of the regions' text that makes an element their holder, or a named one a wrapper of the page
PART = 0.2  # share of the largest part's text that another part of the holder must have
FAVOUR = 4.0  # how often the text of an article or main element counts
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Line:
    __slots__ = ("text", "tags", "around")

    def __init__(self, text: str, tags: int, around: tuple[int, ...]):
        self.text, self.tags, self.around = text, tags, around


class Lines(HTMLParser):
    """Collects lines from parser events; ``feed`` takes a page in pieces of any size."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, element number, never content
        self.kinds: dict[int, str] = {}
        self.text: list[str] = []
        self.tags = 0
        self.lost = 0  # open elements that are never content
        self.doubtful: set[int] = set()  # elements that are not content by their name or as a form, unless they wrap the page
        self.raw = 0  # open scripts and the like, whose text is no text

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            if self.lost:
                self.lines.append(Line(text, self.tags + 1, (-1,)))
            else:
                self.lines.append(Line(text, self.tags + 1, tuple(n for _, n, _ in self.open)))
            self.tags = 0
        self.text.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "option") and self.open and any(t == tag for t, *_ in self.open):
                self._close_implied(tag)
            elif tag not in ("p",) and self.open and self.open[-1][0] == "p":
                self._pop()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        why = self._named(tag, attrs)
        doubtful = tag == "form" and why != "never" or why == "name"
        never = not doubtful and (tag in NEVER or bool(why))
        number = len(self.kinds)
        self.kinds[number] = tag
        if doubtful and tag in NEVER - {"form"}:
            doubtful, never = False, True
        if doubtful:
            self.doubtful.add(number)
        self.open.append((tag, number, never))
        self.lost += never
        self.raw += tag in ("script", "style")

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end means nothing in HTML

    def _named(self, tag: str, attrs) -> str:
        """What says that an element is not main text: ``never``, ``name`` if it is only its class or id, or nothing.

        A class or id counts if all of its words name side matter or nothing; one with another word (``related-work``) does not. The id
        of a heading or section is a slug of its text and counts only for comments, as does any name of a page or article. Comments are
        never content, however many they are.
        """
        named = ""
        inside = any(t in ("article", "main") for t, *_ in self.open)
        holder = tag in ("body", "html", "article", "main")
        if tag == "header" and not inside:
            return "never"
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "never"
            if name == "role" and value and value.strip().lower() in ROLES:
                return "never"
            if name in ("class", "id") and value and tag not in HEADINGS:
                names = COMMENTS if holder or name == "id" and tag == "section" else NAMES if inside else NAMES | {"header"}
                for part in value.split():
                    words = {w.lower() for w in _WORD.findall(part)}
                    if words & names and words <= names | PLAIN:
                        named = "never" if holder or words & COMMENTS else named or "name"
        return named

    def _pop(self) -> None:
        tag, _, never = self.open.pop()
        self.lost -= never
        self.raw -= tag in ("script", "style")

    def _close_implied(self, tag: str) -> None:
        """A paragraph or item ends where the next begins, within the same list or section."""
        for depth in range(len(self.open) - 1, -1, -1):
            t = self.open[depth][0]
            if t == tag:
                while len(self.open) > depth:
                    self._pop()
                return
            if t in BLOCK and t != "p":
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag in VOID or not any(t == tag for t, *_ in self.open):
            return
        if tag not in BLOCK:  # an inline end tag does not close blocks
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] == tag:
                    if not any(t in BLOCK for t, *_ in self.open[depth + 1:]):
                        while len(self.open) > depth:
                            self._pop()
                    return
                if self.open[depth][0] in BLOCK:
                    break
            for depth in range(len(self.open) - 1, -1, -1):  # it ends its element alone
                if self.open[depth][0] == tag:
                    _, _, never = self.open.pop(depth)
                    self.lost -= never
                    return
            return
        while self.open:
            last = self.open[-1][0]
            self._pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def parse(html: str, piece: int = 1 << 16) -> Lines:
    """Lines of a page. As in the standard, a tag or comment that the page's end cuts off is not text."""
    lines = Lines()
    for at in range(0, len(html), piece):
        lines.feed(html[at: at + piece])
    if not lines.cdata_elem and re.match(r"<[A-Za-z/!?]", lines.rawdata):  # what the parser still has open
        lines.rawdata = ""
    lines.close()
    lines.flush()
    return lines


def regions(lines: list[Line], sigma: float = 1.0) -> np.ndarray:
    """Which lines are in content regions: smoothed text-to-tag ratios, split where two clusters separate best."""
    ratio = np.array([len(x.text) / x.tags if x.around != (-1,) else 0.0 for x in lines])
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(np.log1p(ratio), reach, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(32):
        upper = smooth > (low + high) / 2
        if not upper.any() or upper.all():
            break
        centre = smooth[~upper].mean(), smooth[upper].mean()
        if centre == (low, high):
            break
        low, high = centre
    upper = smooth > (low + high) / 2
    return upper if upper.any() else np.ones(len(lines), bool)


def settled(page: Lines) -> list[Line]:
    """The lines, those in doubtful elements marked as never content unless the element wraps the page's text."""
    lines = page.lines
    if not page.doubtful or not lines:
        return lines
    mass = masses(page, lines, regions(lines))
    total = mass.sum()
    held = dict.fromkeys(page.doubtful, 0.0)
    for x, m in zip(lines, mass):
        for n in x.around if m else ():
            if n in held:
                held[n] += m
    lost = {n for n, m in held.items() if not total or m < BULK * total}
    return [Line(x.text, x.tags, (-1,)) if lost.intersection(x.around) else x for x in lines]


def masses(page: Lines, lines: list[Line], chosen: np.ndarray) -> np.ndarray:
    """Length of each line in a content region, as often as its elements count; zero elsewhere."""
    return np.array([len(x.text) * (FAVOUR if any(page.kinds[n] in ("article", "main") for n in x.around) else 1.0)
                     if own and x.around != (-1,) else 0.0 for x, own in zip(lines, chosen)])


def main_text(html: str | None) -> str:
    """The content lines of a page in order, a blank line between them; empty if there are none."""
    page = parse(html or "")
    lines = settled(page)
    able = np.array([x.around != (-1,) for x in lines], bool)
    if not able.any():
        return ""
    chosen = regions(lines) & able
    mass = masses(page, lines, chosen if chosen.any() else able)
    # down from the page while one element inside holds nearly all; an article, or main element without one, is the holder itself
    inside = [tuple(n for n in x.around if n >= 0 and page.kinds[n] in HOLDERS) for x in lines]
    around: tuple[int, ...] = ()
    while True:
        depth, parts = len(around), {}
        within = [able[k] and own[:depth] == around for k, own in enumerate(inside)]
        for k in np.flatnonzero(within):
            if len(inside[k]) > depth:
                parts[inside[k][depth]] = parts.get(inside[k][depth], 0.0) + mass[k]
        total = sum(m for m, own in zip(mass, within) if own)
        best = max(parts, key=parts.get, default=None)
        kind = page.kinds[around[-1]] if around else ""
        if best is None or parts[best] < BULK * total or kind == "article" or kind == "main" and not any(
                page.kinds[n] == "article" for own in inside if own[:depth + 1] == (*around, best) for n in own[depth:]):
            break
        around += (best,)
    # all of that element if much of the text stands in it directly, else those of its parts that hold much, what lies between them
    # and what stands in the element directly
    loose = total - sum(parts.values())
    most = max([loose, *parts.values()])
    kept = {n for n, m in parts.items() if m >= PART * most}
    whole = loose >= PART * most or kind in ("article", "main")
    places = [k for k in np.flatnonzero(within) if len(inside[k]) > depth and inside[k][depth] in kept]
    first, last = (places[0], places[-1]) if places else (0, -1)
    return "\n\n".join(x.text for k, (x, own) in enumerate(zip(lines, inside)) if within[k] and (
        whole or len(own) == depth or own[depth] in kept or first < k < last))


def extract(html: Column) -> Column:
    """``struct<text: string, n_chars: long>`` of a page's main text; a null page is empty. Pages are whole rows in one task.

    Every row is read on its own, so repeated rows give equal results and ties cannot arise; an empty table gives an empty result.
    The caller keeps its other columns, whatever they are called.
    """

    @F.arrow_udf("struct<text:string,n_chars:bigint>")
    def extracted(column: pa.Array) -> pa.Array:
        texts = [main_text(x) for x in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["text", "n_chars"])

    return extracted(html.cast("string"))
