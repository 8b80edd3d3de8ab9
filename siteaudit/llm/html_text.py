"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped, each block of text being a line. The lengths of the lines, summed over a sliding
window, surge where the article begins and dive where it ends; lines between are its
text. Lines of what pages say to be no content weigh nothing, unless the page's text stands in it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, spare

#: Lines of a window, to each side and with its own.
WINDOW = 3
#: Characters of a line that count at most, and those that a line of an article has besides its own.
LONGEST, BONUS = 300, 40

#: Elements whose content isn't text of the page.
DROPPED = "script style noscript template svg math canvas object iframe head select textarea button datalist audio video map".split()
#: Elements that hold page furniture.
FURNITURE = frozenset("nav header footer aside dialog menu".split())
#: Elements that may be page furniture or hold the whole page.
FORMS = frozenset(("form", "fieldset"))
#: Elements that start and end lines.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stray end tags of other elements don't reach beyond.
WALLS = frozenset("article main body table td".split())
#: Elements that a page's main text stands in.
MAIN = frozenset(("article", "main"))
#: Roles of page furniture.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class names and ids that hint at page furniture.
HINTS = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr ccpa notice notices alert alerts announcement popup modal overlay "
    "newsletter subscribe subscription signup signin login sidebar sidebars aside rail menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs masthead header footer foot topbar toolbar comment comments "
    "commentlist disqus reply replies respond discussion feedback share sharing social related recommended recommendations widget widgets pagination pager search skip copyright legal disclaimer paywall tags byline".split()
)
_START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK, _EDGE = re.compile(r"[\"'<>]"), re.compile(r"[<>]")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


#: Of these, what names a part of the article itself when it stands within it.
OWN_HINTS = frozenset(("header", "masthead"))


def furniture(tag: str, attributes: str, within: bool = False) -> tuple[bool, set[str]]:
    """Whether an element is page furniture for certain, and the hints that it may be; ``within``: it stands in the article, whose own header isn't.

    Hints say nothing of an article or main element.
    """
    if tag in FURNITURE and not (within and tag == "header"):
        return True, set()
    hints = {f"<{tag}>"} if tag in FORMS else set()
    if not attributes or tag in ("html", "body"):
        return False, hints
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in MAIN:
            found = HINTS.intersection(x.lower() for x in _NAME.findall(value))
            hints |= found - OWN_HINTS if within else found
        if name == "role" and value.lower() == "form" and tag not in MAIN:
            hints.add("<form>")
        elif name == "role" and value.lower() in ROLES and value.lower() != "form" or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, set()
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, set()
    return False, hints


def _close(page: str, at: int, gone: set[str]) -> int:
    """Where the tag that ``at`` lies in ends, -1 if a tag begins first or a quote stays open; ``gone`` holds the quotes of which none is left."""
    while m := _MARK.search(page, at):
        if m[0] in "<>":
            return m.end() if m[0] == ">" else -1
        end = -1 if m[0] in gone else page.find(m[0], m.end())
        if end < 0:
            gone.add(m[0])
            return -1
        at = end + 1
    return -1


def _tags(page: str):
    """Tags in order as ``(start, end, closing, name, attributes)``; name "": a declaration or broken tag, None: a comment or an element whose content isn't
    text, as a whole. One scan forward, whatever the page."""
    at, gone, size = 0, set(), len(page)
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, False, None, ""
            continue
        m = _START.match(page, start)
        if not m:
            at = start + 1
            if page[at : at + 1] in ("!", "?", "/"):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
                yield start, at, False, "", ""
            continue
        name, end = m[2].lower(), _close(page, m.end(), gone)
        attributes = page[m.end() : end - 1] if end >= 0 else ""
        if end < 0:
            edge = _EDGE.search(page, m.end())
            if edge and edge[0] == "<":
                at = start + 1
                continue
            end = edge.end() if edge else size
        at = end
        if name in _END and not m[1] and not attributes.endswith("/"):
            last = _END[name].search(page, end)
            at = last.end() if last else size
            name = None
        yield start, at, bool(m[1]), name, attributes


class Part:
    """Lines ``start`` to ``end`` of a page: an article or main element, or an element with ``hints``; ``main``: it is or holds such."""

    __slots__ = ("start", "end", "hints", "main")

    def __init__(self, start: int, hints: set[str], main: bool):
        self.start, self.end, self.hints, self.main = start, -1, hints, main

    def holds(self, k: int) -> bool:
        return self.start <= k < self.end


def lines_of(page: str) -> tuple[list[tuple[str, int, bool, bool]], list[Part], list[Part]]:
    """A page's lines in order, ``(text, characters in links, furniture for certain, runs on from the line before)``, its hinted parts and its outermost
    articles; white space is one space, references are decoded."""
    lines: list[tuple[str, int, bool, bool]] = []
    hinted: list[Part] = []
    articles: list[Part] = []
    held: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, int, Part | None]] = []
    spots: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
    walls: list[int] = []  # places of elements that stray end tags close nothing outside of
    bare: list[Part] = []  # open parts that hold no article yet
    main = out = False
    links = 0
    runs_on = False

    def flush(inline: bool = False):
        nonlocal runs_on
        if held:
            raw = html.unescape("".join(x for x, _ in held))
            if text := " ".join(raw.split()):
                linked = len(" ".join(html.unescape("".join(x for x, link in held if link)).split()))
                lines.append((text, linked, out, runs_on and not raw[0].isspace()))
                runs_on = inline and not raw[-1].isspace()
            elif not inline or raw:
                runs_on = False
            held.clear()
        elif not inline:
            runs_on = False

    def close(k: int):
        nonlocal main, out, links
        while len(stack) > k:
            name, main, out, links, part = stack.pop()
            spots[name].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            if part is not None:
                part.end = len(lines)
                if bare and bare[-1] is part:
                    bare.pop()

    at = 0
    for start, end, closing, tag, attributes in _tags(page):
        if start > at:
            held.append((page[at:start], links > 0))
        at = end
        if not tag:
            if tag is None:
                held.append((" ", links > 0))
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            k = spots[tag][-1] if spots[tag] else -1
            if k >= 0 and (tag in WALLS and tag != "td" or not walls or walls[-1] <= k):
                if tag not in BLOCKS and (stack[k][1:3] != (main, out) or any(x[4] is not None for x in stack[k:])):
                    flush(True)
                close(k)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "p" and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
            close(len(stack) - 1)
        off, hints = furniture(tag, attributes, main and not out)
        if held and (off and not out or hints):
            flush(True)
        part = None
        if tag in MAIN and not off and not out:
            while bare:
                bare.pop().main = True
            if not main:
                articles.append(part := Part(len(lines), set(), True))
        elif hints and not off and not out:
            hinted.append(part := Part(len(lines), hints, False))
            bare.append(part)
        spots[tag].append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        stack.append((tag, main, out, links, part))
        main, out, links = main or (tag in MAIN and not off and not out), out or off, links + (tag == "a")
    if at < len(page):
        held.append((page[at:], links > 0))
    flush()
    if stack:
        close(0)
    return lines, hinted, articles


def _windows(weight: list[int], start: int = 0, end: int | None = None) -> list[int]:
    """Sums of the windows round the lines from start to end, of these lines only."""
    end = len(weight) if end is None else end
    return [sum(weight[max(start, k - WINDOW + 1) : min(end, k + WINDOW)]) for k in range(start, end)]


def _standing(hinted: list[Part], articles: list[Part], size: list[int], plain: list[int], weight: list[int]) -> list[Part]:
    """The hinted parts that are furniture: none that holds an article, and none round the page's heaviest window, unless it is mostly
    links or an article outside has a quarter of its text at least. What names such a part says nothing of other parts outside it."""
    sums = _windows(weight)
    heaviest = max(range(len(sums)), key=lambda k: (sums[k], weight[k]))
    plains, sizes = ([0, *accumulate(x)] for x in (plain, size))
    text = lambda p: plains[p.end] - plains[p.start]
    rest = [p for p in hinted if not p.main]
    most = sorted(articles, key=text, reverse=True)[:2]  # articles don't overlap: one at most holds a part
    body = []
    for p in rest:
        if p.holds(heaviest) and 2 * text(p) >= sizes[p.end] - sizes[p.start] and not any(4 * text(a) >= text(p) for a in most if not a.start <= p.start < a.end):
            body.append(p)
    if not body:
        return rest
    void, own = {w for p in body for w in p.hints if w[0] != "<"}, set(map(id, body))
    first, last = min(p.start for p in body), max(p.end for p in body)  # all hold the heaviest line
    return [p for p in rest if id(p) not in own and (p.hints - void or first <= p.start < last)]


def main_text(page: str | None) -> str:
    """The lines between the surge and the dive of the text, joined by spaces.

    A line weighs the length of its text outside links, ``LONGEST`` at most, so that no single line sets the scale; furniture weighs nothing. Lines of
    an article or main element that has a quarter of the page's text at least weigh ``BONUS`` more, and windows don't reach over its bounds. The text
    surges at the first line with a weight whose window holds a tenth of the heaviest window's text at least, and dives after the last such, in each stretch inside or
    outside such articles; furniture between is left out.
    """
    lines, hinted, articles = lines_of(page or "")
    size = [0 if out else len(text) for text, _, out, _ in lines]
    if not any(size):
        return ""
    plain = [max(0, n - linked) for n, (_, linked, _, _) in zip(size, lines)]
    plain = plain if any(plain) else size
    weight = [min(n, LONGEST) for n in plain]
    done = 0
    for p in sorted(_standing(hinted, articles, size, plain, weight), key=lambda p: p.start):
        for k in range(max(done, p.start), p.end):
            size[k] = plain[k] = weight[k] = 0
        done = max(done, p.end)
    total = sum(plain)
    heavy = [a for a in articles if 4 * sum(plain[a.start : a.end]) >= total > 0]
    for a in heavy:
        for k in range(a.start, a.end):
            weight[k] += BONUS if size[k] else 0
    bounds = sorted({0, len(lines), *(x for a in heavy for x in (a.start, a.end))})
    sums = [s for start, end in zip(bounds, bounds[1:]) for s in _windows(weight, start, end)]
    least = max(sums) / 10
    texts: list[str] = []
    last = -1
    for start, end in zip(bounds, bounds[1:]):
        dense = [k for k in range(start, end) if weight[k] and sums[k] >= least]
        for k in range(dense[0], dense[-1] + 1) if dense else ():
            if size[k]:
                texts += ["" if not texts or lines[k][3] and last == k - 1 else " ", lines[k][0]]
                last = k
    return "".join(texts)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """Adds ``main_text`` to each row of ``pages``: "" for a null, empty or textless page.

    Whole pages are read, one at a time, in time linear in their length; a column called main_text is replaced, others stay, and repeated rows and
    null ids make no difference. Empty in, empty out.
    """
    kept = [c for c in pages.columns if c.lower() != "main_text"]
    page = spare(kept, "page")
    pages = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(source).alias(page))
    schema = pages.drop(page).schema.add("main_text", "string")

    def run(batches):
        for batch in pieces(batches, page):
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "main_text"])

    return pages.mapInArrow(run, schema)
