"""Main text of web pages by the distribution of text over line blocks.

A page becomes lines, one for each block element. Markup, scripts, styles and the parts that the page itself names as
menus, headers, footers, sidebars, notices, adverts, forms or comments are stripped and leave empty lines, but for a form or
open dialog around the article, or around most of a page that marks none. A line weighs
its characters without those of links (up to `SATURATED`, so that one long paragraph does not dwarf the others), and far more
where the page marks it as article or main: markup adds weight, and the curve decides. The curve is the sum over
windows of `width` lines. A surge is a window over `SURGE` of the page's peak, the dive after it the first window
of at most `DIVE` of the peak; the lines between them are kept, however short each is, with the lines that adjoin
the surge or the dive in the same container (a linked headline, a list of sources).

Tags are read in one pass and their ends paired by name, so any page takes time in proportion to its length.

Defined results: a null or empty page has an empty text, as has one whose text is all in links; null and
repeated ids are kept; a container that is never closed is not left out, nor what an unfinished tag would hold; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines of a window; characters up to which a line's weight grows; shares of the peak at which text begins and ends.
WIDTH, SATURATED, SURGE, DIVE = 3, 344, 1 / 4, 1 / 32
# HTML element names by their role, and the words by which pages name parts that are not the article.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("head nav footer aside menu button select datalist noscript template svg math canvas object audio video".split())
UNLESS_ROUND_ALL = frozenset("form dialog".split())
UNLESS_IN_ARTICLE = frozenset("header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
CONTAINERS = frozenset("article aside blockquote body center details div dl fieldset figure main ol section table td th ul".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion nav navbar navigation menu menus topbar masthead footer sidebar sidebars aside cookie cookies consent gdpr notice notices notification alert banner banners popup modal overlay comment comments commentlist respond disqus replies share sharing social related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget widgets toolbar skip".split()
)
OUTER_NAMES = frozenset("header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

MARK = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

ZEROS, HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
SURELY, BY_NAME, BY_TAG = 3, 2, 1


def _leaves_out(tag: str, attributes: str, in_article: bool, nested: bool) -> int:
    """A class or id names a part if all words of one of its values do: cookie-banner, but not has-banner or comments-open."""
    if tag in LEFT_OUT or (tag in UNLESS_IN_ARTICLE and not in_article):
        return SURELY
    if tag == "dialog" and not any(m[1].lower() == "open" for m in ATTRIBUTE.finditer(attributes)):
        return SURELY
    by_tag = BY_TAG if tag in UNLESS_ROUND_ALL else 0
    if not attributes.strip() or tag in ("html", "body", "main"):
        return by_tag
    names = NAMES if in_article else NAMES | OUTER_NAMES
    named = by_tag
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            tokens = ({w.lower() for w in WORDS.findall(token)} for token in value.split())
            if any(words and words <= names for words in tokens) and (tag != "article" or nested):
                named = BY_NAME
        elif name == "role" and value.lower() in ROLES:
            named = BY_NAME
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return SURELY
    return named


def decoded(text: str) -> str:
    """With character references resolved; numbers beyond any character stand for none."""
    return html.unescape(HUGE.sub("\ufffd", ZEROS.sub("&#", text))) if "&" in text else text


def tags_of(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of all markup; comments and the contents of scripts and the like have no name."""
    out, at, last, pattern = [], 0, page.rfind(">"), QUOTED
    while m := MARK.search(page, at):
        start, name = m.start(), ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2) + 3
            out.append((start, end if end > 2 else len(page), "", False, ""))
        elif start > last:  # never finished
            out.append((start, len(page), "", False, ""))
        elif m[0][1] in "!?":
            out.append((start, page.find(">", start) + 1, "", False, ""))
        else:
            t = pattern.match(page, start)
            if t is None:  # a quote swallows the rest of the page: from here on quotes do not count
                pattern = PLAIN
                t = pattern.match(page, start)
            name = t[2].lower()
            out.append((start, t.end(), name, bool(t[1]), t[3]))
            if name in RAW and not t[1]:
                close = RAW_END[name].search(page, t.end())
                out.append((t.end(), close.end() if close else len(page), "", False, ""))
        at = out[-1][1]
    return out


def _ends(tags: list[tuple]) -> list[int]:
    """For each opening tag the place of its end, by nesting among tags of its name; -1 where there is none."""
    ends, opened = [-1] * len(tags), {}
    for i, (_, _, name, closing, attributes) in enumerate(tags):
        if not name or name in VOID or name in RAW:
            continue
        if not closing:
            if not attributes.endswith("/"):
                opened.setdefault(name, []).append(i)
        elif opened.get(name):
            ends[opened[name].pop()] = i
    return ends


def _counts(tags: list[tuple], names: frozenset) -> list[int]:
    """How many opening tags of these names stand before each place."""
    return [0, *accumulate(t[2] in names and not t[3] for t in tags)]


class Line(NamedTuple):
    text: str
    weight: float
    container: int


def lines_of(page: str, width: int = WIDTH) -> list[Line]:
    """All lines in order; stripped parts and the borders of an article are empty lines."""
    tags = tags_of(page)
    ends, blocks, mains, articles = _ends(tags), _counts(tags, BLOCKS), _counts(tags, frozenset(["main"])), _counts(tags, frozenset(["article"]))
    texts = [0, *accumulate(len(page[a:t[0]].strip()) for a, t in zip([0, *(t[1] for t in tags)], tags, strict=False))]
    marked = width * SATURATED / DIVE  # no window of unmarked lines reaches the dive of a page with marked ones
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    open_: Counter = Counter()
    linked = inside = links = at = i = 0

    def end_line():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Line(text, min(max(0, len(text) - linked), SATURATED) + (marked if inside else 0), stack[-1][1] if stack else -1))
        parts.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if text:
            text = decoded(text)
            parts.append(text)
            if links:
                linked += len(text)

    def holds_article(end: int) -> bool:
        """main, or all articles of the page, are in it."""
        return mains[end] > mains[i] or articles[end] - articles[i] == articles[-1] > 0

    def holds_most(end: int) -> bool:
        """Nothing on the page is marked, and over half of its text is in it."""
        return mains[-1] == articles[-1] == 0 and 2 * (texts[end + 1] - texts[i]) > texts[-1]

    while i < len(tags):
        start, end, tag, closing, attributes = tags[i]
        add(page[at:start])
        at, i = end, i + 1
        if not tag:
            continue
        if not closing and tag not in VOID and tag not in RAW and ends[i - 1] >= 0:
            why = _leaves_out(tag, attributes, inside > 0, open_["article"] > 0)
            if why in (BY_NAME, BY_TAG) and not inside and (holds_article(ends[i - 1]) or why == BY_TAG and holds_most(ends[i - 1])):
                why = 0
            if why:
                if tag in BLOCKS or tag in LEFT_OUT:
                    end_line()
                    out += [Line("", 0, -1)] * min(width, 1 + blocks[ends[i - 1]] - blocks[i])
                at, i = tags[ends[i - 1]][1], ends[i - 1] + 1
                continue
        if tag in BLOCKS:
            end_line()
        if tag in CONTAINERS:
            if not closing:
                stack.append((tag, end))
                open_[tag] += 1
            elif open_[tag]:
                while (gone := stack.pop()[0]) != tag:
                    open_[gone] -= 1
                open_[tag] -= 1
        if tag in ARTICLE:
            before, inside = inside, max(0, inside + (-1 if closing else 1))
            if (before > 0) != (inside > 0):
                out += [Line("", 0, -1)] * width
        if tag == "a":
            links = 0 if closing else 1
    add(page[at:])
    end_line()
    return out


def spans_of(weights: list[float], width: int = WIDTH, surge: float = SURGE, dive: float = DIVE) -> list[tuple[int, int]]:
    """(first, end) of the stretches of lines between a surge and the dive after it."""
    n = len(weights)
    before = [0, *accumulate(weights)]
    sums = [before[min(n, i + width)] - before[i] for i in range(n)]
    peak, out, i = max(sums, default=0), [], 0
    while i < n:
        if sums[i] <= surge * peak:
            i += 1
            continue
        # The window's first lines may only lead up to the surge.
        first = next(k for k in range(i, n) if weights[k] * width > surge * peak)
        i = next((k for k in range(first + 1, n) if sums[k] <= dive * peak), n)
        out.append((first, i))
    return out


def main_text(page: str | None, width: int = WIDTH, surge: float = SURGE, dive: float = DIVE) -> str:
    """The lines between surges and dives, with their neighbours of the same container, joined by spaces."""
    lines = lines_of(page or "", width)
    run, runs, last = 0, [], None
    for x in lines:
        if x.text:
            run += x.container != last
            last = x.container
        runs.append(run)
    kept, whole = [False] * len(lines), set()
    for first, end in spans_of([x.weight for x in lines], width, surge, dive):
        kept[first:end] = [True] * (end - first)
        whole |= {runs[first], runs[end - 1]}
    return " ".join(x.text for x, k, r in zip(lines, kept, runs, strict=True) if x.text and (k or r in whole))


def _extract(width: int, surge: float, dive: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, width, surge, dive) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, width: int = WIDTH, surge: float = SURGE, dive: float = DIVE) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(width, surge, dive), "page_id long, url string, text string, n_chars long")


def op8_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_line_blocks": op8_html_line_blocks}
ORACLES: dict[str, str] = {}
