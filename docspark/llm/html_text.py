"""Main text of HTML pages by line-block distribution.

A page is cut at its block-level tags into lines; markup, comments, scripts and styles go, character references are decoded, white
space inside a line becomes one space.  Each line has a weight: its length less its link text (none, if most of it is links), and ``SURGE`` more in an element that holds prose (a paragraph, a heading, a list item and the
like) or in what the page marks as its article (there link text counts).  Text that lies loose, in no such element, weighs nothing on a page whose prose is mostly in such elements.

What a page marks as beside the text (menus, page headers and footers, sidebars, notices, adverts, forms and reader comments, by element, role, or a name in class or id), and where it marks its
article, all outside it, is a window of negative mass, ``-SURGE / 2`` a line, in its place.  A mark counts only while the page has its text elsewhere: one that covers all but ``LEFT`` of the page's prose and leaves no marked article is void, such as
a form round the whole page, and an article mark that holds less than half of the prose left by the other marks is void, such as teasers.  A name is a mark if all its parts are such words or words of layout,
and not with ``no-``, ``has-``, ``-open`` and the like, so ``share-price`` and ``no-sidebar`` are none.

Sums over windows of ``WINDOW`` lines give the distribution.  The text surges at the first line of positive weight after a window without mass and dives where a window has none again; a stretch whose sums
never reach ``SURGE`` (a lone short block that no element calls prose) is dropped, unless the page has no other, and the main text is all lines of the other stretches from surge to dive.
So a line without weight, such as one that is a link and nothing else, stays between lines of text, and a list of links does not.

The scanner reads a page from left to right once; an unclosed tag, comment or raw element reaches to the end, as in a browser, so time and memory grow in proportion to the page.  Null and empty
pages give an empty text.  Every row gives a row, repeated ones too, and an empty table an empty one; the columns to keep pass as they are, others are not read, whatever their names.  A page is worked on in the task that holds it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import computed

WINDOW = 3
SURGE = 30
#: Share of the prose outside a mark up to which it is void, and length from which loose text counts as prose.
LEFT, LONG = 0.05, 200
#: Marked elements inside each other that are told apart; what is deeper goes with them.
DEPTH = 8

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>=]++|=)(?:\s*+=\s*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s>\"'][^\s>]*+)?+))?+)?+")
#: Elements whose content is not text: to the end of the page if unclosed, and those that are only skipped if closed.
RAW = frozenset("script style textarea title iframe".split())
SKIPPED = frozenset("noscript template svg math select".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never article text.
BESIDE = frozenset("nav footer aside form head dialog button menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of the names (class or id) of such parts; the words of layout that names are made of besides; and first and last words that make a name a state of the page.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice "
    "notices notification popup modal overlay comment comments commentlist disqus replies respond related recommended recommendations share sharing social subscribe newsletter signup login search pagination pager toolbar skip widget widgets".split()
)
LAYOUT = frozenset(
    "bar box area block wrap wrapper container section list links link item items button buttons panel column col row inner outer top bottom left right main site page global primary secondary first second post entry article "
    "content body google slot unit zone text form icons icon group nav wide sticky fixed".split()
)
STATE_FIRST, STATE_LAST = frozenset("no not has have with without is show hide js".split()), frozenset("open closed on off enabled disabled active visible".split())
CLOSED_BY = {"p": frozenset("p div ul ol li table article section aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote hr main dl figure".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}




def _is_mark(name: str) -> bool:
    """Whether a name of a class or id says that the element is beside the text."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x.isalpha()]
    if not parts or parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
        return False
    return bool(MARKS.intersection(parts)) and MARKS.union(LAYOUT).issuperset(parts)


def _kind(tag: str, found: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether an element is marked as beside the text, and whether as the article."""
    role = found.get("role", "")
    article = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articlebody"
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    beside = tag in BESIDE or tag == "header" and not inside or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or any(map(_is_mark, names)) or "display:none" in found.get("style", "").replace(" ", "")
    if tag in ("html", "body", "main"):
        beside = False
    elif tag == "article":  # a reader's comment can be an article of its own
        beside = any(_is_mark(n) and re.search(r"comment|advert|\bads?\b|promo|related|sponsored", n) for n in names)
    return beside, article and not beside


class Line(NamedTuple):
    text: str
    #: Length of its link text.
    link: int
    #: Numbers of the elements that are marked as beside the text and hold the line.
    beside: tuple[int, ...]
    article: bool
    prose: bool

    @property
    def own(self) -> int:
        return 0 if 2 * self.link > len(self.text) else len(self.text) - self.link

    @property
    def mass(self) -> int:
        """Its prose."""
        return self.own if self.prose or self.own >= LONG else 0


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
    """First and last character, name, end tag or not, and attributes of every tag; comments, declarations and the content of raw elements come with no name."""
    at, unclosed = 0, set()
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 4)
            at = len(page) if at < 0 else at + 3
            yield lt, at, "", False, {}
            continue
        name = NAME.match(page, lt)
        if name is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt)
                at = len(page) if at < 0 else at + 1
                yield lt, at, "", False, {}
            else:
                at = lt + 1  # a sign in the text
            continue
        at, found = name.end(), {}
        while at < len(page) and page[at] != ">":
            m = ATTRIBUTE.match(page, at)
            at = m.end()
            if m[1] and m[1].lower() not in found:
                found[m[1].lower()] = (m[2] or m[3] or m[4] or "").lower()
        at, tag, end = min(at + 1, len(page)), name[1].lower(), page[lt + 1] == "/"
        if not end and (tag in RAW or tag in SKIPPED and tag not in unclosed):
            close = _end_of(tag).search(page, at)
            if close is not None or tag in RAW:
                at = close.end() if close else len(page)
                yield lt, at, "", False, {}
                continue
            unclosed.add(tag)
        yield lt, at, tag, end, found


def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?:\s[^>]*+)?+(?:>|\Z)", re.IGNORECASE)


def lines_of(page: str) -> list[Line]:
    """Every line that is not empty."""
    lines: list[Line] = []
    stack: list[tuple[str, tuple[int, ...], bool, bool, bool]] = []  # tag, marks, article, link, prose: each for all that is inside
    open_, parts, link, at, marks = Counter(), [], 0, 0, 0
    none = ("", (), False, False, False)

    def flush() -> None:
        nonlocal link
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, beside, article, _, prose = stack[-1] if stack else none
            lines.append(Line(text, link, beside, article, prose))
        link = 0

    def push(*of) -> None:
        stack.append(of)
        open_[of[0]] += 1

    def pop() -> None:
        open_[stack.pop()[0]] -= 1

    for start, stop, tag, end, found in tags_of(page):
        if start > at:
            parts.append(page[at:start])
            if stack and stack[-1][3]:
                link += start - at
        at = stop
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        up = stack[-1] if stack else none
        if tag in INLINE:
            if end:
                if up[0] == tag:
                    if tag != "a":
                        flush()
                    pop()
            elif tag == "a":
                push("a", up[1], up[2], True, up[4])
            elif found and tag != "img" and tag not in VOID and _kind(tag, found, True)[0]:
                flush()
                marks += 1
                push(tag, (*up[1], marks) if len(up[1]) < DEPTH else up[1], up[2], up[3], up[4])
            elif open_[tag]:  # its end must not close the one that is beside the text
                push(tag, up[1], up[2], up[3], up[4])
            continue
        flush()
        if end:
            while open_[tag]:
                if stack[-1][0] == tag:
                    pop()
                    break
                pop()
            continue
        while stack and (stack[-1][0] == "a" or tag in CLOSED_BY.get(stack[-1][0], ())):
            pop()
        if tag in VOID:
            continue
        up = stack[-1] if stack else none
        beside, article = _kind(tag, found, up[2])
        marks += beside
        push(tag, (*up[1], marks) if beside and len(up[1]) < DEPTH else up[1], up[2] or article, up[3], up[4] or tag in PROSE)
    parts.append(page[at:])
    flush()
    return lines


def _void(lines: list[Line]) -> set[int]:
    """The marks that cover the page's text itself."""
    covered, in_article = Counter(), Counter()
    for line in lines:
        for mark in line.beside:
            covered[mark] += line.mass
            in_article[mark] += line.mass if line.article else 0
    total, articles = sum(x.mass for x in lines), sum(x.mass for x in lines if x.article)
    return {mark for mark, mass in covered.items() if mass and total - mass <= LEFT * total and articles == in_article[mark]}


def weighed(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[tuple[str, float]]:
    """Text and weight of every line; what is beside the text is a window of negative mass, without its text."""
    void = _void(lines)
    beside = [not void.issuperset(x.beside) for x in lines]
    free = [x for x, b in zip(lines, beside, strict=True) if not b]
    articles, prose = sum(x.mass for x in free if x.article), sum(x.mass for x in free)
    marked = any(x.article for x in free) and 2 * articles >= prose
    loose = 0 if 2 * prose > sum(x.own for x in free) else 1  # what text outside elements of prose weighs
    out: list[tuple[str, float]] = []
    for x, b in zip(lines, beside, strict=True):
        if b or marked and not x.article:
            out += [("", -surge / 2)] * window
            continue
        inside = marked and x.article
        weight = len(x.text) if inside else x.own if x.prose or x.own >= LONG else x.own * loose
        out.append((x.text, weight + surge if weight and (inside or x.prose) else weight))
    return out


def stretches(weights: list[float], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """From each surge to its dive: first and last line of positive weight while no window is without mass, where a window's sum reaches ``surge``."""
    found, first, last, peak = [], None, 0, 0.0
    padded = [*weights, *[0.0] * window]
    for i, weight in enumerate(padded):
        total = sum(padded[max(0, i - window + 1) : i + 1])
        if weight > 0:
            first, last = i if first is None else first, i
        peak = max(peak, total)
        if total <= 0 and weight <= 0 and first is not None:
            if peak >= surge:
                found.append((first, last))
            first, peak = None, 0.0
    return found


def main_text(page: str | None) -> str:
    rows = weighed(lines_of(page or ""))
    weights = [w for _, w in rows]
    found = stretches(weights) or stretches(weights, surge=1)
    return " ".join(text for a, b in found for text, _ in rows[a : b + 1] if text)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id_col, the columns to keep, text, n_chars of every row."""

    rows = pages.select(id_col, *keep, F.col(html_col).alias("_html"))
    return computed(rows, ["_html"], "text string, n_chars long", lambda: lambda page: (text := main_text(page), len(text)))
