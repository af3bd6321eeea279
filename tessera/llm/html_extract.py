"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; they become lines (blocks of
text) with a count of the tags met since the last line. A line's ratio is its
text outside links to its tags. Ratios are smoothed with a Gaussian along each
region (the container a line stands in; an article or other landmark is one
region with all that it holds, but for its link lists and parts named otherwise).
A line is content where its smoothed ratio, weighted by what the region's class,
id or role says and by whether it lies in a landmark of the page, reaches the
spread of the page's; a region is taken whole, short lines included, if at least
half of its text is in such lines. On a page without landmarks a neighbour of a taken region
needs only a part of that ratio, if it has few links. Only elements that are never an article
(scripts, menus, footers ...) are left out before that. A form is left out unless
it holds half of the page's text outside links; an article opens content again
inside a form, menu or header that surrounds it, a main element inside anything.

Defined cases: a null or empty page, or one without text, gives the empty text;
broken markup ends where the parser ends it; a page without any landmark is one
region per block container; regions of equal ratio are all taken; attribute
values of any length are read whole; of the other columns only those in `carry` are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text is never content, that take no end tag, and that end a block.
SKIPPED = frozenset("script style noscript template svg math nav footer aside button select option textarea iframe object canvas dialog menu head title audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LANDMARKS = frozenset(("article", "main"))
#: Left-out elements inside which a landmark opens content again, be it that they surround the page or lack an end tag.
REOPENED = {"main": frozenset(("nav", "header", "aside", "footer")), "article": frozenset(("nav", "header"))}
REGIONS = frozenset("article main section div body td".split())
#: Parts of a landmark that are a region of their own if most of their text is links.
LISTS = frozenset("ul ol dl table div section".split())
#: Words of class, id or role that speak against a part.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer contentinfo "
    "sidebar complementary aside widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login search comment comments commentlist respond reply replies disqus discussion pagination pager toolbar tags copyright legal disclaimer skip".split()
)
#: Of these, what marks even a single paragraph.
ADVERTS = frozenset("ad ads advert adverts advertisement sponsored".split())
#: Weights of a region named by such a word, of one whose name begins with one, and of one outside the page's landmarks.
NAMED, BEGUN, OUTSIDE = 0.1, 0.4, 0.3
#: Part of the threshold that a neighbour of a taken region needs, and the share of links that it may have.
BESIDE, FEW_LINKS = 0.25, 0.25
#: An end tag that may be left out: opening one of the values ends the key.
IMPLIED_END = {"head": BLOCKS - {"header"}, "p": BLOCKS - {"br"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
CHUNK = 1 << 16
SIGMA = 1.0
_TOKENS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


def _weight(tag: str, attrs: list[tuple[str, str | None]]) -> float:
    """What class, id and role say about a part: 1 for nothing, 0 for a hidden one."""
    out = 1.0
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for word in value.split():
                parts = [p.lower() for p in _TOKENS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", word))]
                if not parts or parts[0] not in (BOILERPLATE if tag in BLOCKS - {"p"} else ADVERTS):
                    continue
                out = min(out, NAMED if all(p in BOILERPLATE or len(p) < 2 for p in parts) else BEGUN if tag != "p" else 1.0)
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 0.0
    return out


@dataclass
class Region:
    """A part of the page: the region around it, its weight, and whether it is one only as a list of links."""

    parent: int
    weight: float
    landmark: bool
    listed: bool = False
    form: bool = False
    chars: int = 0
    linked: int = 0


@dataclass
class Line:
    text: str
    linked: int  # characters in links
    tags: int
    region: int


class _Lines(HTMLParser):
    """Collects lines and regions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.regions = [Region(-1, 1.0, False)]
        self.open: list[tuple[str, int, int]] = []  # element, what it adds to the closed parts, region before it
        self.text: list[str] = []
        self.tags = self.closed = self.region = self.landmarks = self.links = self.linked = 0

    def end_block(self) -> None:
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text.clear()
            if line:
                self.lines.append(Line(line, min(self.linked, len(line)), self.tags, self.region))
                self.tags = 0
        self.linked = 0

    def _pop(self) -> None:
        tag, dead, region = self.open.pop()
        self.closed -= dead
        self.landmarks -= tag in LANDMARKS
        self.links -= tag == "a"
        if region != self.region:
            self.end_block()
        self.region = region

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_block()
        self.tags += 1
        if tag in VOID:
            return
        while self.open and tag in IMPLIED_END.get(self.open[-1][0], ()):
            self._pop()
        weight = _weight(tag, attrs) if attrs and tag not in ("html", "body") else 1.0
        dead = int(tag in SKIPPED or weight == 0 or (tag == "header" and not self.landmarks))
        if self.closed and weight == 1 and self._reopens(tag):
            dead = -self.closed
        self.open.append((tag, dead, self.region))
        self.closed += dead
        self.links += tag == "a"
        inside = self.landmarks > 0
        self.landmarks += tag in LANDMARKS
        named, listed, form = weight < 1, inside and tag in LISTS, tag == "form"
        if named or listed or form or (tag in REGIONS and not inside):
            self.end_block()
            own = self.regions[self.region].weight * weight
            self.regions.append(Region(self.region, own, self.landmarks > 0, listed and not named, form))
            self.region = len(self.regions) - 1

    def _reopens(self, tag: str) -> bool:
        """Whether all that is closed around a landmark may surround it."""
        return tag in REOPENED and all(dead <= 0 or t in REOPENED[tag] for t, dead, _ in self.open)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        self.tags += 1
        if tag not in VOID and any(t == tag for t, _, _ in self.open):
            while self.open[-1][0] != tag:
                if self.open[-1][0] in LANDMARKS and tag not in LANDMARKS | {"body", "html"}:
                    return  # a stray end tag of something outside the article
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.closed:
            self.text.append(data)
            if self.links > 0:
                self.linked += len(data.strip())


def lines_of(html: str) -> tuple[list[Line], list[Region]]:
    """Lines, and the regions that they name; lists that are not mostly links are part of what holds them."""
    parser = _Lines()
    for i in range(0, len(html), CHUNK):
        parser.feed(html[i : i + CHUNK])
    parser.close()
    parser.end_block()
    lines, regions = parser.lines, parser.regions
    for line in lines:
        regions[line.region].chars += len(line.text)
        regions[line.region].linked += line.linked
    lines = _without_forms(lines, regions)
    into = list(range(len(regions)))
    for k in range(len(regions) - 1, 0, -1):  # from the inside out: the parts of a list count for it
        own, parent = regions[k], regions[k].parent
        if own.listed and own.linked * 2 < max(own.chars, 1):
            into[k] = parent
            regions[parent].chars += own.chars
            regions[parent].linked += own.linked
    for k in range(1, len(regions)):
        into[k] = into[into[k]]
    for line in lines:
        line.region = into[line.region]
    return lines, regions


def _without_forms(lines: list[Line], regions: list[Region]) -> list[Line]:
    """The lines but those of forms with less than half of the page's text outside links."""
    around = [0] * len(regions)  # the outermost form around a region, 0 if none or if a landmark stands between
    for k in range(1, len(regions)):
        own, parent = regions[k], around[regions[k].parent]
        opened = own.landmark and not regions[own.parent].landmark
        around[k] = 0 if opened and not own.form else parent or (k if own.form else 0)
    if not any(around):
        return lines
    text = np.array([len(x.text) - x.linked for x in lines])
    of = np.array([around[x.region] for x in lines], int)
    mass = np.bincount(of, text, len(regions)) if len(lines) else np.zeros(len(regions))
    return [x for x, k in zip(lines, of.tolist(), strict=True) if k == 0 or mass[k] * 2 >= text.sum() > 0]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def scores(lines: list[Line], regions: list[Region], sigma: float = SIGMA) -> np.ndarray:
    """Smoothed and weighted text-to-tag ratio of every line."""
    ratios = np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    of = np.array([x.region for x in lines])
    out, landmarks = np.zeros(len(lines)), any(regions[k].landmark for k in set(of.tolist()))
    for k in np.unique(of).tolist():
        own = np.flatnonzero(of == k)
        weight = regions[k].weight * (OUTSIDE if landmarks and not regions[k].landmark else 1.0)
        out[own] = smoothed(ratios[own], sigma) * weight
    return out


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    lines, regions = lines_of(html or "")
    if not lines:
        return ""
    ratios, sizes = scores(lines, regions, sigma), np.array([len(x.text) for x in lines], float)
    least = min(ratios.std(), ratios.max())
    numbers, region = np.unique([x.region for x in lines], return_inverse=True)
    mass = np.bincount(region, sizes)
    lit = lambda limit: np.bincount(region, sizes * (ratios >= limit))
    taken = lit(least) * 2 >= mass
    if not taken.any():
        taken[np.argmax(np.bincount(region, sizes * ratios))] = True
    if not any(regions[k].landmark for k in numbers.tolist()):
        own = [regions[k] for k in numbers.tolist()]
        beside = {x.parent for x, t in zip(own, taken, strict=True) if t}
        near = np.array([x.parent in beside and x.weight == 1 and x.linked <= FEW_LINKS * x.chars for x in own])
        taken |= near & (lit(least * BESIDE) * 2 >= mass)
    return "\n".join(x.text for x, r in zip(lines, region, strict=True) if taken[r])


def extract(pages: DataFrame, *, html: str = "html", carry: tuple[str, ...] = ("page_id", "url"), sigma: float = SIGMA) -> DataFrame:
    """The columns in `carry`, text and n_chars of every page; pages are read and written row by row."""
    kept = pages.select(*carry).schema
    place = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x.as_py(), sigma) for x in part.column(place)]
                columns = [*part.columns[:place], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "text", "n_chars"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "text string, n_chars long"])
    return pages.select(*carry, pages[html].alias("_html")).mapInArrow(run, ddl)
