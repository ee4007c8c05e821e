"""Main text of web pages by line-block distribution.

A page becomes lines: its markup is stripped, block elements and the text around them each make a line. A line weighs as
much as its text is long, link texts left out. Lines inside elements that never hold the article (menus, headers and footers
of the page, side bars, notices, adverts, forms, scripts, styles, reader comments) weigh nothing and are never returned, and
where a page has article or main elements, so are lines outside them. The weights are summed over a sliding window. The text
begins at a surge, the lines around a window of ``threshold`` or more (or the page's heaviest), and ends at a dive, where all
lines of a window weigh nothing. What lies between them stays whole, short lines and link texts too, but for lines at its edges
that light containers hold beside the one with most of the weight. Article and main elements stay whole, and so does what lies
between two surges in the same container, so that no list of links or advert inside the article costs what follows it. Inside
of an article fewer names tell what is none of it: a part named for related pages, sharing or search belongs to it unless it
has nothing but links.

White space inside a line becomes one space; character references are decoded. Defined cases: a null or empty page has no
text; markup cut off at the end of the page is dropped; elements left open end with the page. Equal pages give equal texts.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

THRESHOLD, WINDOW = 86, 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
#: Those of them whose content is shown as it stands.
SHOWN = {"xmp", "plaintext"}
#: Elements that never hold the article.
NEVER = (RAW - SHOWN) | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "template", "svg", "canvas", "object", "audio", "video", "noscript"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split()) | set(
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose semantics".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = {"article", "main"}
#: Words in class, id, role or aria-label that name what is not the article: where each word of a name is one of these or
#: of PLACES ("related-posts", not "related-work").
BOILER = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe"
    " subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets toolbar pagination pager comment comments commentlist respond replies reply disqus share sharing"
    " social related recommended recommendations outbrain taboola login search skip complementary contentinfo alert".split()
)
#: Those of them that name parts of an article inside of one.
PARTS = set("related recommended recommendations search login skip social share sharing toolbar widget widgets pagination pager complementary contentinfo alert".split())
PLACES = set(
    "top bottom left right main site page global primary secondary list lists box area container wrapper wrap block section group bar inner outer content link links post posts article articles story stories item items"
    " button buttons media icon icons form field thread count title header footer body row col js ui text label unit slot".split()
)
#: And those that do so outside an article only ("page-header", not "post-header").
FRAME, FRAME_PLACES = set("header masthead topbar footer foot bottom side rail".split()), set("top main site page global inner outer wrapper wrap container bar area left right js ui".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements that hold blocks; lines of the nearest one are in one container.
CONTAINERS = {"div", "section", "article", "main", "td", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
MAIN_ROLE = re.compile(r"""role\s*=\s*["']?(?:main|article)|itemprop\s*=\s*["']?articleBody""", re.I)


def is_boilerplate(name: str, attrs: str, in_article: bool) -> bool:
    if name in NEVER or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body"):
        return False
    if HIDDEN.search(attrs):
        return True
    names = " ".join(m[1].strip("\"'") for m in NAMED.finditer(attrs))
    if name in ARTICLE:
        return name == "article" and "comment" in names.lower()
    if not names or name in HEADINGS:
        return False
    for one in names.split():
        words = {w.lower() for w in WORD.findall(one) if not w.isdigit()}
        boiler = BOILER - PARTS if in_article else BOILER
        if words & boiler and words <= BOILER | PLACES or not in_article and words & FRAME and words <= FRAME | FRAME_PLACES:
            return True
    return False


class Line(NamedTuple):
    text: str
    weight: int
    blank: bool
    article: int  # the outermost article or main element, from 1; 0 outside of them
    container: int
    part: int  # the nearest part of an article, from 1, that a name says to be of links; 0 outside of them
    heading: bool


def is_part(attrs: str) -> bool:
    """Whether an element inside an article is named as one that may be a list of links."""
    for one in " ".join(m[1].strip("\"'") for m in NAMED.finditer(attrs)).split():
        words = {w.lower() for w in WORD.findall(one) if not w.isdigit()}
        if words & PARTS and words <= BOILER | PLACES:
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The lines that have text."""
    lines: list[Line] = []
    pieces: list[str] = []
    links: list[str] = []
    open_: list[tuple[str, bool, bool, int, int]] = []  # name, boilerplate, article, nearest container and part
    named: Counter[str] = Counter()  # of the open ones
    blank = article = articles = containers = parts = 0
    in_link = False

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(links)).split()))
                container, part = open_[-1][3:] if open_ else (0, 0)
                lines.append(Line(text, 0 if blank else max(0, len(text) - linked), blank > 0, articles if article else 0, container, part, any(named[x] for x in HEADINGS)))
            pieces.clear()
            links.clear()

    def text(piece: str) -> None:
        if piece:
            pieces.append(piece)
            if in_link:
                links.append(piece)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if name in INLINE:
            if name == "a":
                in_link = not m["close"]
            elif name in ("br", "img", "input"):
                text(" ")
            if name != "br" and not m["close"] and name not in VOID and not attrs.endswith("/") and attrs and is_boilerplate(name, attrs, article > 0):
                flush()
                open_.append((name, True, False, *(open_[-1][3:] if open_ else (0, 0))))
                named[name] += 1
                blank += 1
            elif m["close"] and open_ and open_[-1][0] == name:
                flush()
                open_.pop()
                named[name] -= 1
                blank -= 1
            continue
        flush()
        if m["close"]:
            done = not named[name]
            while not done:
                last, is_boiler, is_article, *_ = open_.pop()
                named[last] -= 1
                blank -= is_boiler
                article -= is_article
                done = last == name
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if name in SHOWN:
                for line in page[at : close.start() if close else end].split("\n"):
                    text(html.escape(line))
                    flush()
            at = close.end() if close else end
        elif name not in VOID and name not in ("p", "html", "body", "dt", "dd") and not attrs.endswith("/"):
            boiler = is_boilerplate(name, attrs, article > 0)
            is_article = not boiler and (name in ARTICLE or bool(attrs and MAIN_ROLE.search(attrs)))
            containers += 1
            articles += is_article and not article
            container, part = open_[-1][3:] if open_ else (0, 0)
            if article and attrs and not boiler and not is_article and is_part(attrs):
                part = parts = parts + 1
            open_.append((name, boiler, is_article, containers if name in CONTAINERS else container, part))
            named[name] += 1
            blank += boiler
            article += is_article
        elif name == "p" and attrs and is_boilerplate(name, attrs, article > 0):
            close = re.compile(r"</p\s*>|(?=<(?:p|div|article|section|ul|ol|h[1-6]|footer|nav)\b)", re.I).search(page, at)
            at = close.end() if close else end
    flush()
    return lines


def window_sums(weights: list[int], window: int) -> list[int]:
    """The sum of each line's weight and of those of the window - 1 lines behind it."""
    upto = [0, *itertools.accumulate(weights)]
    return [upto[min(len(weights), k + window)] - upto[k] for k in range(len(weights))]


def surges(weights: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """[from, to) of the lines from a surge to the next dive: around a window of the threshold, on both sides as far as no
    ``window`` lines on end weigh nothing, without lines that weigh nothing at the ends."""
    sums = window_sums(weights, window)
    on = [k for k, w in enumerate(weights) if w]
    found, k = [], 0
    while k < len(on):  # stretches of lines with gaps under the window
        j = k
        while j + 1 < len(on) and on[j + 1] - on[j] <= window:
            j += 1
        if max(sums[on[k] : on[j] + 1]) >= threshold:
            found.append((on[k], on[j] + 1))
        k = j + 1
    return found


def edged(lines: list[Line], weights: list[int], first: int, last: int, least: int) -> tuple[int, int]:
    """[first, last) without lines at the ends that lie in light containers, where one other container has most of the weight."""
    held: Counter[int] = Counter()
    for k in range(first, last):
        held[lines[k].container] += weights[k]
    main, weight = max(held.items(), key=lambda x: x[1])
    if 2 * weight <= sum(weights[first:last]):
        return first, last
    other = lambda k: lines[k].container != main and held[lines[k].container] < least and not lines[k].heading
    while other(first):
        first += 1
    while other(last - 1):
        last -= 1
    return first, last


def kept_lines(lines: list[Line], threshold: int, window: int) -> list[int]:
    has_article = any(x.article and not x.blank for x in lines)
    weights = [x.weight if x.article or not has_article else 0 for x in lines]
    # a page of links or of short lines alone has its heaviest window for a surge
    least = max(1, min(threshold, max(window_sums(weights, window), default=0)))
    if has_article and not any(weights):
        weights = [len(x.text) if x.article and not x.blank else 0 for x in lines]
    found = surges(weights, window, least)
    keep = {k for k, x in enumerate(lines) if x.article}
    if not has_article:
        found = [edged(lines, weights, a, b, least) for a, b in found]
        keep = {k for a, b in found for k in range(a, b)}
    for (_, a), (b, _) in zip(found, found[1:], strict=False):  # between surges of one container
        if lines[a - 1].container == lines[b].container and not has_article:
            keep.update(range(a, b))
    told = {x.part for x in lines if x.weight}  # parts with more than links
    return sorted(k for k in keep if not lines[k].blank and (not lines[k].part or lines[k].part in told))


def main_text(page: str | None, threshold: int = THRESHOLD, window: int = WINDOW) -> str:
    lines = lines_of(page or "")
    return "\n".join(lines[k].text for k in kept_lines(lines, threshold, window))


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    small_batches(pages.sparkSession)
    columns = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return columns.mapInArrow(lean(run), "page_id bigint, url string, text string, n_chars bigint")
