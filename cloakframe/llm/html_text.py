"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming parser gives the events.  A page becomes lines: one for each block
of text, with its number of characters, its number of tags (links weigh more), and what stands
around it.  Blocks inside elements that are boilerplate by name, by role or by what a class or id
calls them (``NEVER``: comments, sidebars, notices, adverts; whatever their size) are no candidates.
Other class words are decided after parsing: an element that holds more than half of the page's text
is a wrapper and stays, and so does one that holds an article (or main part) where none stands outside
such elements; in an article, words that may name its matter (``MATTER``) discard an element only if
the ratios show no content in it.  The text-to-tag ratios of the candidate lines (lines that the page
marks as its main part or its article count for more) are smoothed with a Gaussian, and a threshold
from two-means clustering separates content lines from the rest.  They select the content region: the
articles that hold content lines, with all their candidate lines; without such, the main part that
holds some; else the innermost container that holds all content lines, with its candidate lines but
lists of links, and the headings right before it.

Defined results: null or empty html, and pages without text, give an empty text; a page of
one kind of lines keeps its candidates; a tag that the page never finishes ends it; rows and null or
repeated page_ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SIGMA = 1.5
#: Added to a line's log ratio inside the main part, and twice that inside an article.
MARK_WEIGHT = 1.5
#: Spread of the smoothed ratios below which they are one cluster.
ONE_CLUSTER = 0.7
#: Characters of a line that tell a block of an article from a button or a label.
LEAST_TEXT = 40

# HTML element names by their part in a page, and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template head title iframe object svg math canvas audio video map datalist select option textarea button".split())
BOILERPLATE = frozenset("nav header footer aside dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLASS_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored promo promos promotion nav navbar navigation menu menus topbar breadcrumb breadcrumbs header masthead footer sidebar side aside widget widgets related recommended "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments commentlist reply replies respond disqus pagination pager toolbar copyright legal skip hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Class words of what is never content, and words beside them that tell a wrapper ("has-sidebar", "sidebar-layout").
NEVER = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sidebar comment comments commentlist reply replies respond disqus cookie cookies consent gdpr newsletter popup modal widget widgets nav navbar navigation menu menus topbar breadcrumb breadcrumbs footer pager pagination toolbar promo promos promotion".split())
WRAPPER = frozenset("has no not with without is layout page wrapper wrap container content main grid site body two one left right".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Elements that structure a page; paragraphs, headings, lists and tables are blocks inside them.
CONTAINERS = frozenset("html body div section main article center form td fieldset details aside header footer nav".split())
# Class words that tell a comment, a teaser or an advert that is marked up as an article.
NO_ARTICLE = frozenset("ad ads advert adverts advertisement sponsored promo comment comments reply replies related recommended teaser".split())
# Class words that may tell what a block of an article is about.
MATTER = frozenset("related recommended legal search side social alert notice notices copyright skip login share sharing".split())
# Elements that a start tag closes when they are open, up to the nearest of the scope elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = ("h1", "h2", "h3")
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
SPACES = re.compile(r"\s+")


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    skipped: bool = False
    heading: bool = False
    #: 2 inside an article, 1 inside the main part, else 0.
    mark: int = 0
    #: Number of that article or main part in the page.
    section: int = 0
    #: Number of the innermost open element that a class or id names as boilerplate, and of the innermost container; -1: none.
    named: int = -1
    box: int = -1


def _is_boilerplate(tag: str, attrs: dict[str, str | None], in_main: bool) -> bool:
    """By its element, role or visibility; an article also by its class."""
    if tag in BOILERPLATE:
        return not (tag == "header" and in_main)
    if "hidden" in attrs or HIDDEN.search(attrs.get("style") or "") or (attrs.get("role") or "").strip().lower() in ROLES or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if tag == "article":
        return not NO_ARTICLE.isdisjoint(_class_words(attrs))
    return tag not in ("html", "body", "main", "h1") and ("class" in attrs or "id" in attrs) and _never(attrs)


def _never(attrs: dict[str, str | None]) -> bool:
    """Whether a name in class or id calls the element what is never content."""
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = _words(name)
        if not NEVER.isdisjoint(words) and WRAPPER.isdisjoint(words):
            return True
    return False


def _class_words(attrs: dict[str, str | None]) -> set[str]:
    return _words(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")


def _words(names: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower()))


def _named_boilerplate(tag: str, attrs: dict[str, str | None], in_article: bool) -> set[str]:
    """The words of class and id that name an element as boilerplate; a form is one by its element, unless it wraps the page."""
    if tag == "form":
        return {tag}
    if tag in ("html", "body", "main", "h1", "article") or not ("class" in attrs or "id" in attrs):
        return set()
    return _class_words(attrs) & (CLASS_WORDS - {"header"} if in_article else CLASS_WORDS)


class PageLines(HTMLParser):
    """Blocks of text in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = [Line()]
        self.open: list[tuple[str, bool, int, bool]] = []  # element, starts boilerplate, starts the main part (1) or the article (2), is named boilerplate
        self.named: list[int] = []
        self.named_above: list[int] = []  # of each named element: the named element around it
        self.boxes: list[int] = []
        self.box_above: list[int] = []
        self.matter: list[bool] = []  # of each named element: in an article, by words that may name its matter
        self.boiler = self.links = self.silent = 0
        self.marks = [0, 0, 0]
        self.sections = [0, 0, 0]
        self.names: Counter[str] = Counter()  # of the open elements

    def _break(self) -> None:
        if self.lines[-1].parts:
            self.lines.append(Line())

    def _push(self, tag: str, boiler: bool, mark: int, named: bool) -> None:
        self.open.append((tag, boiler, mark, named))
        if tag in CONTAINERS:
            self.box_above.append(self.boxes[-1] if self.boxes else -1)
            self.boxes.append(len(self.box_above) - 1)
        self.names[tag] += 1
        self.boiler += boiler
        self.sections[mark] += not self.marks[mark]  # elements inside one of their kind belong to it
        self.marks[mark] += 1
        self.links += tag == "a"
        self.silent += tag in SKIP

    def _pop(self) -> None:
        tag, boiler, mark, named = self.open.pop()
        self.names[tag] -= 1
        if named:
            self.named.pop()
        if tag in CONTAINERS:
            self.boxes.pop()
        self.boiler -= boiler
        self.marks[mark] -= 1
        self.links -= tag == "a"
        self.silent -= tag in SKIP

    def _close(self, names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        """Close the nearest open element of ``names``, if it stands above every element of ``scope``."""
        if not any(self.names[n] for n in names):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._break()
        self.lines[-1].tags += 1
        if tag in CLOSES_P:
            self._close({"p"}, frozenset({"article", "main", "section", "div", "td", "th", "body", "blockquote", "li", "form", "aside", "nav", "header", "footer"}))
        if tag in CLOSES:
            self._close(CLOSES[tag], frozenset({"ul", "ol", "dl", "table", "select", "article", "main", "body"}))
        if tag in VOID:
            return
        own = dict(attrs)
        boiler = _is_boilerplate(tag, own, self.marks[1] + self.marks[2] > 0)
        role = (own.get("role") or "").strip().lower()
        mark = 0
        if not boiler and not self.boiler:
            mark = 2 if tag == "article" or role == "article" or (own.get("itemprop") or "").lower() == "articlebody" else 1 if tag == "main" or role == "main" else 0
        words = set() if boiler or self.boiler else _named_boilerplate(tag, own, self.marks[2] > 0)
        if words:
            self.named_above.append(self.named[-1] if self.named else -1)
            self.named.append(len(self.matter))
            self.matter.append(self.marks[2] > 0 and words <= MATTER)
        self._push(tag, boiler, mark, bool(words))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._break()
        self.lines[-1].tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._break()
        self.lines[-1].tags += 1
        if tag not in VOID:
            # an end tag reaches over unclosed inline elements, but not out of a section of the page
            self._close({tag}, frozenset() if tag in BLOCK or tag in SKIP else frozenset({"article", "main", "section", "div", "td", "body", "nav", "aside", "footer", "header", "form", "p", "li"}))

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        line = self.lines[-1]
        if not line.parts:
            if data.isspace():
                return
            line.skipped, line.mark = self.boiler > 0, 2 if self.marks[2] else 1 if self.marks[1] else 0
            line.heading = any(self.names[h] for h in HEADINGS)
            line.section, line.named, line.box = self.sections[line.mark], self.named[-1] if self.named else -1, self.boxes[-1] if self.boxes else -1
        line.parts.append(data)
        line.linked += len(data) * (self.links > 0)


def two_means(values: np.ndarray) -> float:
    """Threshold between the two clusters of one-dimensional values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        above = values > middle
        if above.all() or not above.any():
            return middle
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_mask(chars: np.ndarray, tags: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Content lines: smoothed text-to-tag ratio above the clusters' threshold."""
    ratio = np.log1p(chars / np.maximum(tags, 1)) + MARK_WEIGHT * marks
    reach = int(3 * SIGMA + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(ratio, kernel)[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    if smooth.max() - smooth.min() < ONE_CLUSTER:
        return np.ones(len(smooth), bool)
    return smooth > two_means(smooth)


def _content(lines: list[tuple[Line, str]]) -> np.ndarray:
    """Indices of the content lines."""
    chars = np.array([len(t) - 0.9 * x.linked for x, t in lines])
    marks = np.array([x.mark for x, _ in lines])
    return np.flatnonzero(content_mask(np.maximum(chars, 0), np.array([x.tags for x, _ in lines]), marks))


def without_named(lines: list[tuple[Line, str]], page: PageLines) -> list[tuple[Line, str]]:
    """The lines but those of elements that a class or id names as boilerplate, where the page agrees."""
    above, matter, n = page.named_above, page.matter, len(page.matter)
    size, mark = [0] * n, [0] * n
    for x, text in lines:
        if x.named >= 0:
            size[x.named] += len(text)
            mark[x.named] = max(mark[x.named], x.mark)
    for k in range(n - 1, -1, -1):  # an element has a larger number than the one around it
        if above[k] >= 0:
            size[above[k]] += size[k]
            mark[above[k]] = max(mark[above[k]], mark[k])
    total = sum(len(text) for _, text in lines)
    wide = [2 * z > total for z in size]

    def along(own: list[bool]) -> list[bool]:
        """Whether an element and all named ones around it are so."""
        for k in range(n):
            own[k] = own[k] and (above[k] < 0 or own[above[k]])
        return own

    passed = along([matter[k] or wide[k] for k in range(n)])
    outside = max((x.mark for x, _ in lines if x.named < 0 or passed[x.named]), default=0)
    stay = [not matter[k] and (wide[k] or mark[k] > outside) for k in range(n)]
    if any(matter):
        # inside an article the mark is the article's own: only the ratios tell
        for i in _content(lines).tolist():
            x, text = lines[i]
            if len(text) > 2 * x.linked and len(text) >= LEAST_TEXT:
                k = x.named
                while k >= 0 and not (matter[k] and stay[k]):
                    stay[k] = stay[k] or matter[k]
                    k = above[k]
    stay = along(stay)
    return [(x, text) for x, text in lines if x.named < 0 or stay[x.named]]


def region(lines: list[tuple[Line, str]], content: np.ndarray, above: list[int]) -> list[tuple[Line, str]]:
    """The lines of the innermost container that holds all content lines, and the headings right before it.

    Lines that are mostly links and no headings are lists of links: smoothing may lift them beside the text.
    """
    told = [k for k in content.tolist() if lines[k][0].heading or 2 * lines[k][0].linked < len(lines[k][1])] or content.tolist()
    # containers are numbered in page order: walking up from the larger number meets at the common one
    box = lines[told[0]][0].box
    for k in told:
        other = lines[k][0].box
        while box != other:
            box, other = (above[box], other) if box > other else (box, above[other])
    inside = [box < 0] * (len(above) + 1)  # the last entry stands for no container
    for k in range(len(above)):
        inside[k] = k == box or (above[k] >= 0 and inside[above[k]]) or box < 0
    own = set(told)
    kept = [k for k, (x, text) in enumerate(lines) if inside[x.box] and (k in own or x.heading or 2 * x.linked < len(text))]
    begin = kept[0]
    while begin and lines[begin - 1][0].heading:
        begin -= 1
    return [lines[k] for k in [*range(begin, kept[0]), *kept]]


UNFINISHED = re.compile("<[a-zA-Z/!?]")


def parsed(html: str) -> PageLines:
    """The page; a tag after the last ``>`` has no end, so it ends the page."""
    page, end = PageLines(), html.rfind(">") + 1
    cut = UNFINISHED.search(html, end)
    page.feed(html[: cut.start()] if cut else html)
    page.close()
    return page


def extract(html: str | None) -> str:
    if not html:
        return ""
    page = parsed(html)
    lines = [(x, SPACES.sub(" ", "".join(x.parts)).strip()) for x in page.lines if not x.skipped]
    lines = without_named([(x, text) for x, text in lines if text], page)
    if not lines:
        return ""
    marks = np.array([x.mark for x, _ in lines])
    content = _content(lines)
    best = marks[content].max()
    if best:
        own = {lines[k][0].section for k in content.tolist() if marks[k] == best}
        lines = [(x, text) for x, text in lines if x.mark == best and x.section in own]
    else:
        lines = region(lines, content, page.box_above)
    return "\n".join(text for _, text in lines)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) as n_chars")
