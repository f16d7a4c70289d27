"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; text between block boundaries is
a line, with the tags met in it. The ratios of characters to tags are smoothed
by a Gaussian over neighbouring lines, and lines above a threshold (the
standard deviation of the smoothed ratios, their mean at most) cluster into
content regions. A region belongs to its innermost article or main element;
where there is one, the whole element is the content, so that short paragraphs
stay; elsewhere short lines between two lines of a region, and a heading right
before it, are kept. End tags that HTML lets a page omit are implied. Elements
that are never content (menus, adverts, forms, comments and the like) are left
out before; one that is never closed ends with its list. What a class or an id names so is left out too.
Some names can be those of an article as well (shares, a widget, a search): there the lines are set aside, and a region
in one such element that has ``DENSE`` characters and ``OVERRULE`` times those of the other content, or all there is,
overrules the name. Comments are never content, whatever elements hold them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

SIGMA, REACH = 1.0, 2
#: least characters of a region that overrules a name, and least multiple of what is found without it
DENSE, OVERRULE = 200, 4

#: fixed sets of element and class names
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select textarea iframe object svg canvas audio video map dialog menu".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
NEVER_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login footer masthead topbar pagination pager".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: names that an article's element may bear too
DOUBTFUL = frozenset("banner promo promotion share sharing social related recommended search widget".split())
#: elements that are never content, but end with their list where a page never closes them
LOOSE = frozenset("nav aside header footer form dialog".split())
LISTS = frozenset("ul ol dl menu".split())
LOOSE_TAG = re.compile(r"<(/?)(nav|aside|header|footer|form|dialog)\b", re.I)
CONTENT = frozenset("article main".split())
#: an open element of these names ends where the element begins, unless one of the others lies between
_P_ENDS = (frozenset(["p"]), frozenset("table caption td th button object template body html".split()))
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset("dl table td th".split()))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset("thead tbody tfoot tr caption colgroup".split()), frozenset(["table"]))),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr li dt dd main menu nav ol p pre section table ul".split()
)
IN_HEAD = frozenset("base link meta title script style noscript template".split())
SPLIT_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


Line = tuple[str, int, int, bool, int]


class Lines(HTMLParser):
    """Collects (text, tags, container, heading, named) of every line outside the elements that are never content.

    ``named`` is the number of the innermost element whose class or id may be that of
    something that is not content, 0 outside of these.
    """

    def __init__(self, html: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.loose = never_closed(html)
        self.seen: dict[str, int] = {}
        self.hanging: set[int] = set()  # numbers in ``open`` of elements that are never closed
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, int]] = []  # (name, left out, container, named)
        self.text: list[str] = []
        self.tags, self.containers, self.names, self.heading = 0, 0, 0, False

    def state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def line(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, max(1, self.tags), self.state()[1], self.heading, self.state()[2]))
            self.text = []
        self.tags = 0

    def left_out(self, tag: str, attributes: list[tuple[str, str | None]], inside: int) -> bool:
        if tag in NEVER or (tag == "header" and not inside):
            return True
        if tag in ("html", "body", "main"):
            return False
        for key, value in attributes:
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return True
            if key == "role" and (value or "").lower() in NEVER_ROLES:
                return True
        return False

    def named(self, tag: str, attributes: list[tuple[str, str | None]]) -> frozenset[str]:
        """Names of what is no content among the whole tokens of class and id and their leading parts."""
        if tag in ("html", "body"):
            return frozenset()
        tokens = [x for key, value in attributes if key in ("class", "id") and value for x in value.split()]
        if tag in CONTENT:  # an article may be open to comments, but may also be one
            return frozenset(x.lower() for x in tokens) & COMMENTS
        return frozenset(y.lower() for x in tokens for y in (x, SPLIT_NAME.split(x)[0])) & (NEVER_NAMES | COMMENTS | DOUBTFUL)

    def cut(self, k: int) -> None:
        del self.open[k:]
        self.hanging = {x for x in self.hanging if x < k}

    def in_comments(self) -> bool:
        return any(name == "#comments" for name, *_ in self.open)

    def end_implied(self, names: frozenset[str], stops: frozenset[str]) -> None:
        """End the outermost open element of these names that lies inside the innermost of the stops."""
        found = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                found = k
            elif self.open[k][0] in stops:
                break
        if found is not None:
            self.cut(found)

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.line()
            if tag in IMPLIED:
                self.end_implied(*IMPLIED[tag])
            if tag in ENDS_P:
                self.end_implied(*_P_ENDS)
            if len(self.open) - 1 in self.hanging and tag not in LISTS and tag not in LOOSE:
                self.cut(len(self.open) - 1)
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.cut(len(self.open) - 1)
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        out, container, named = self.state()
        names = self.named(tag, attributes)
        if (out or named) and tag in CONTENT and not names and not self.in_comments() and not self.left_out(tag, attributes, 1):
            while self.open and (self.open[-1][1] or self.open[-1][3]):  # an element that was left out and never closed
                self.cut(len(self.open) - 1)
            out, container, named = self.state()
        if names & COMMENTS and not out:
            self.open.append(("#comments", True, container, named))  # ends with the element inside it
        if not out:
            out = self.left_out(tag, attributes, container) or bool(names - DOUBTFUL)
        if not out and names:
            self.names += 1
            named = self.names
        if tag in LOOSE:
            self.seen[tag] = self.seen.get(tag, 0) + 1
            if self.seen[tag] in self.loose.get(tag, ()):
                self.hanging.add(len(self.open))
        if not out and tag in CONTENT:
            self.containers += 1
            container = self.containers
        self.heading = tag in HEADINGS if tag in BLOCKS else self.heading
        self.open.append((tag, out, container, named))

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID and tag in ("svg", "path", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.line()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                k -= k > 0 and self.open[k - 1][0] == "#comments"
                self.cut(k)
                if tag in LISTS and k - 1 in self.hanging:
                    self.cut(k - 1)
                break
            if self.open[k][0] in ("body", "html"):
                break
        if tag in BLOCKS:
            self.heading = False

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.text.append(data)


def never_closed(html: str) -> dict[str, set[int]]:
    """Which of the elements that end with their list have no end tag, counted by name from 1."""
    count: dict[str, int] = {}
    open_: dict[str, list[int]] = {}
    for m in LOOSE_TAG.finditer(html):
        name = m.group(2).lower()
        if not m.group(1):
            count[name] = count.get(name, 0) + 1
            open_.setdefault(name, []).append(count[name])
        elif open_.get(name):
            open_[name].pop()
    return {name: set(left) for name, left in open_.items() if left}


def smoothed(values: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """Gaussian mean over neighbours; weights beyond either end are left out."""
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, weights)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), weights)[reach : reach + len(values)]


def chosen(lines: list[Line]) -> list[str]:
    """The lines of the content regions, those of a named element only where it overrules its name."""
    found = regions([line for line in lines if not line[4]])
    named: dict[int, list[Line]] = {}
    for line in lines:
        if line[4]:
            named.setdefault(line[4], []).append(line)
    sizes = {k: sum(map(len, regions(own))) for k, own in named.items()}
    largest = max(sizes, key=sizes.__getitem__, default=0)
    others = sum(map(len, found))
    if largest and sizes[largest] >= (max(DENSE, OVERRULE * others) if others else 1):
        return regions([line for line in lines if line[4] in (0, largest)])
    return found


def regions(lines: list[Line]) -> list[str]:
    """The lines of the content regions, whatever their names."""
    if not lines:
        return []
    raw = np.array([len(text) / tags for text, tags, *_ in lines])
    ratio = smoothed(raw)
    threshold = min(ratio.std(), ratio.mean())
    high = ratio >= threshold
    for step in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        outside = True  # a region begins and ends with a line that is high by itself
        for k in step:
            outside = (outside or not high[k]) and raw[k] < threshold
            high[k] &= not outside
    weight: dict[int, int] = {}
    for (text, _, container, *_), above in zip(lines, high, strict=True):
        if above:
            weight[container] = weight.get(container, 0) + len(text)
    inner = {c: n for c, n in weight.items() if c}
    if inner and max(inner.values()) >= weight.get(0, 0) / 2:
        return [text for text, _, container, *_ in lines if container in inner]
    at = np.flatnonzero(high)
    keep = high.copy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a <= REACH + 1:
            keep[a:b] = True
    for k in at:
        if k and lines[k - 1][3]:
            keep[k - 1] = True
    return [line[0] for line, ok in zip(lines, keep, strict=True) if ok]


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty for a null, an empty page or one without content."""
    parser = Lines(html or "")
    parser.feed(html or "")
    parser.close()
    parser.line()
    return "\n".join(chosen(parser.lines))


@arrow_udf(StringType())
def extracted(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in pages], pa.string())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; repeated rows are read each, other columns are left out."""
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(F.col(html_col)).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
