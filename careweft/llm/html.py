"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, each with the innermost enclosing containers; what stands in
boilerplate elements or in containers named like boilerplate gives no lines. Inside an article or main element its own header
stays, and only containers are judged by their names, not headings, paragraphs or inline elements (but for adverts).

A line weighs its text outside links. Weights are summed over sliding windows of lines. The peak is the heaviest line of the greatest
window (in article or main elements if there are any). Lines that stand with the peak, in its article or main element or in the
container that holds half of the text, weigh a `SURGING`th of a mean line at the peak at least. From the peak outwards,
surge and dive are where the window sums fall below that; what other lines there weigh less than the bar for lines on their own is cut
off again, and a first heading right before the surge is taken in. The lines between surge and dive are the text, none dropped for being short.

Elements whose end tag may be left out end where HTML says: p at the next block, li, dd, dt and the parts of
tables at the next of their kind, head at the first element that cannot stand in it.

A page is handled on its own, in one pass over its characters; nothing is shuffled.

Rows: null html counts as empty; a page without text gives an empty text; repeated rows and
null ids or urls stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGING = 4
# Least weight of a line outside the article or main element of the page.
APART = 86

# Element and class names.
DROPPED = set("nav header footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu head title".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = {"article", "main", "section", "div", "td", "center"}
BODIES = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMED = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments discussion disqus respond replies share sharing social related newsletter subscribe "
    "popup modal widget pagination pager".split()
)
ADVERTS = set("ad ads advert adverts advertisement advertising sponsored".split())
# Boilerplate names that parts of an article have too.
PARTS = set("alert header masthead widget".split())
# An article may well be a post with a header class, but not the text if it is one of these.
BODY_NAMED = set("ad ads advert comment comments promo related replies sidebar sponsored".split())
# Start tags that end an open element whose end tag may be left out, and the elements not looked past.
TABLE = {"table"}
ENDS_P = set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "search section summary table ul".split()
)
LISTED = BLOCKS - {"address", "div", "p", "li", "dd", "dt"}
ENDS = {
    "li": ({"li"}, LISTED | {"dd", "dt"}),
    **dict.fromkeys(["dd", "dt"], ({"dd", "dt"}, LISTED | {"li"})),
    **dict.fromkeys(["td", "th"], ({"td", "th", "caption"}, TABLE)),
    "tr": ({"tr", "td", "th", "caption"}, TABLE),
    **dict.fromkeys(["tbody", "thead", "tfoot"], ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, TABLE)),
}
CELLS = TABLE | {"td", "th", "caption"}
# How far an end tag reaches out.
REACH = {"p": CELLS, "li": {"ul", "ol", "menu"} | CELLS, **dict.fromkeys(["dd", "dt"], {"dl"} | CELLS), **dict.fromkeys(["td", "th", "tr", "tbody", "thead", "tfoot", "caption"], TABLE)}
KEPT_OPEN = CONTAINERS | {"body", "html"} | set(REACH) | TABLE | {"ul", "ol", "dl"}
IN_HEAD = set("title meta link script style base noscript template".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


class Line(NamedTuple):
    text: str
    weight: int  # code points outside links
    path: tuple[int, ...]  # numbers of the enclosing containers, outermost first
    body: int  # number of the outermost article or main element, or 0
    title: bool  # a first heading


def is_boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Of an element, `inside` an article or main element or not."""
    if name in DROPPED and not (inside and name == "header"):
        return True
    if not attributes or name in {"body", "html"}:
        return False
    if name in BODIES:
        named = BODY_NAMED
    elif name in HEADINGS or not (name in BLOCKS or "-" in name) or (inside and name in {"p", "li", "dt", "dd", "pre"}):
        named = ADVERTS
    else:
        named = NAMED - PARTS if inside else NAMED
    if HIDDEN.search(attributes):
        return True
    for key, *values in NAMES.findall(attributes):
        words = re.split(r"\s+" if named is ADVERTS else r"[^a-z]+", "".join(values).lower())
        if key.lower() == "role":
            words = [{"complementary": "sidebar", "contentinfo": "footer", "search": "menu"}.get(w, w) for w in words]
        if not named.isdisjoint(words):
            return True
    return False


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    held: list[str] = []
    open_elements: list[tuple[str, int, bool]] = []  # name, container number or 0, boilerplate
    linked: list[str] = []
    number = dropped = at = 0
    link = title = False

    def joined(parts: list[str]) -> str:
        return " ".join(references.unescape("".join(parts)).split())

    def close_line() -> None:
        nonlocal link
        text, weight = joined(held), len(joined(linked))
        held.clear()
        linked.clear()
        link = False
        if text:
            body = next((n for name, n, _ in open_elements if name in BODIES), 0)
            lines.append(Line(text, max(0, len(text) - weight), tuple(n for _, n, _ in open_elements if n), body, title))

    def pop(until: int) -> None:
        nonlocal dropped
        while len(open_elements) > until:
            dropped -= open_elements.pop()[2]

    def end(names: set[str], stops: set[str]) -> None:
        """Ends the outermost open element of `names` inside the first of `stops`."""
        place = None
        for i in range(len(open_elements) - 1, -1, -1):
            if open_elements[i][0] in names:
                place = i
            elif open_elements[i][0] in stops:
                break
        if place is not None:
            pop(place)

    while True:
        tag = TAG.search(page, at)
        if not dropped:
            held.append(page[at : tag.start() if tag else len(page)])
            if link:
                linked.append(held[-1])
        if not tag:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name == "br" or name == "hr":
            held.append(" ")
        if name in BLOCKS:
            close_line()
            title = name == "h1" and not tag[1]
        if name == "a":
            link = not tag[1]
        if tag[1]:
            stops = REACH.get(name, set()) - {name}
            inner = (i for i in range(len(open_elements) - 1, -1, -1) if open_elements[i][0] == name or open_elements[i][0] in stops)
            place = next(inner, None)
            if place is not None and open_elements[place][0] == name:
                pop(place)
            continue
        if open_elements and open_elements[-1][0] == "head" and name not in IN_HEAD:
            pop(len(open_elements) - 1)
        if name in ENDS:
            end(*ENDS[name])
        if name in ENDS_P:
            end({"p"}, CELLS)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID or tag[3].endswith("/"):
            continue
        if name in BODIES and dropped and all(n not in BODIES for n, _, _ in open_elements):
            # A boilerplate element that was never closed, or a form around the page.
            pop(next(i for i, e in enumerate(open_elements) if e[2]))
        boilerplate = is_boilerplate(name, tag[3], any(n in BODIES for n, _, _ in open_elements))
        if not (boilerplate or name in KEPT_OPEN):
            continue
        number += 1
        open_elements.append((name, number if name in CONTAINERS else 0, boilerplate))
        dropped += boilerplate
    close_line()
    return lines


def window_sums(sizes: list[int]) -> list[int]:
    ends = [0, *accumulate(sizes)]
    return [ends[min(len(sizes), i + WINDOW)] - ends[max(0, i - WINDOW + 1)] for i in range(len(sizes))]


def text_ends(lines: list[Line]) -> tuple[int, int]:
    """Surge and dive: the text is lines[surge:dive]."""
    weights = [line.weight for line in lines]
    if not any(weights):
        weights = [len(line.text) for line in lines]
    sums = window_sums(weights)
    bodies = [i for i, line in enumerate(lines) if line.body]
    top = max(bodies or range(len(lines)), key=sums.__getitem__)
    window = range(max(0, top - WINDOW + 1), min(len(lines), top + WINDOW))
    peak = max((i for i in window if lines[i].body or not bodies), key=weights.__getitem__)
    mean = sum(weights[i] for i in window) / len(window)
    least = max(1.0, mean / SURGING)
    body, path = lines[peak].body, (0, *lines[peak].path)  # 0 is the page
    bar = max(APART, 2 * least) if body else least
    inside = Counter({0: sum(weights)})
    for line, weight in zip(lines, weights, strict=True):
        inside.update(dict.fromkeys(line.path, weight))
    home = next(n for n in reversed(path) if 2 * inside[n] >= inside[0])

    def stands(i: int) -> bool:
        line = lines[i]
        if body:
            return line.body == body
        same = line.path == lines[peak].path
        return i == peak or (weights[i] > 0 and (same or (home > 0 and home in line.path)))

    standing = [stands(i) for i in range(len(lines))]
    sums = window_sums([max(w, least) if s else w for w, s in zip(weights, standing, strict=True)])
    surge = dive = peak
    while surge and sums[surge - 1] >= least:
        surge -= 1
    while dive + 1 < len(lines) and sums[dive + 1] >= least:
        dive += 1
    # The windows reach over the ends; lines there that are light on their own are not text.
    while not standing[surge] and weights[surge] < bar:
        surge += 1
    while not standing[dive] and weights[dive] < bar:
        dive -= 1
    while surge and lines[surge - 1].title and weights[surge - 1]:
        surge -= 1
    return surge, dive + 1


def main_text(page: str) -> str:
    lines = lines_of(page)
    surge, dive = text_ends(lines) if lines else (0, 0)
    return "\n\n".join(line.text for line in lines[surge:dive])


def extract(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
