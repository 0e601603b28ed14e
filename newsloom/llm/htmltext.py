"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

Method.  The standard library's HTML parser streams events; block-level tags and line breaks end a line.  Each line
gets its text-to-tag ratio (characters over tags since the line before, anchors' text left out); lines inside menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments have ratio zero.  An element is
such furniture by its tag, attributes or names, unless it turns out to hold the article or most of the text.  The ratios
are smoothed by a Gaussian, and runs of lines above the threshold (the deviation of the smoothed ratios) are the
content clusters.  The deepest container that holds all clusters is the content region (an article or main element
around it if there is one); all its lines are returned but the marked ones, so neither a cluster nor a short paragraph
beside one is lost.  Outside article and main, lines that are nothing but links are left out too, and the text lines
before and after the region, up to the next such line, belong to it (headlines and leads below the threshold).

Scale.  One pass, no shuffle; a page is parsed on its own, with time and memory linear in its length.

Edge cases.  Null or empty html gives an empty text.  Unclosed and stray tags are tolerated; unknown marked sections are
comments; a tag or comment that is never ended is dropped with all behind it.  White space inside a
line becomes one space, lines are joined by a newline, character references are decoded.  Repeated rows and null ids
are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type

SIGMA = 1.0
# fixed values: HTML element names by role, and words that mark furniture in class, id and role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p "
                  "pre section select summary table tbody td tfoot th thead title tr ul br".split())
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
FURNITURE = frozenset("head nav menu footer aside form script style noscript template iframe object svg canvas button "
                      "select option textarea dialog title".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "summary", "html", "head"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored "
                  "sponsors cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
                  "subscription signup share sharing social related recommended recommendations breadcrumb breadcrumbs "
                  "comment comments respond disqus replies nav navbar navigation menu menubar sidebar rail footer "
                  "pagination pager widget widgets login search toolbar skip copyright masthead topbar "
                  "complementary contentinfo alert dialog toc hidden".split())
HEADER_MARKS = frozenset(("header", "banner"))
COMMENT_MARKS = frozenset("comment comments respond disqus replies".split())
# of MARKS, words with another meaning: as a part of a longer name they need evidence
WEAK = frozenset("ad ads social related share sharing notice notices search alert rail hidden login respond comment replies promo "
                 "promotion sponsor sponsored widget skip toc overlay recommended subscribe signup pager modal".split())
# elements whose text is never read; other furniture is judged once the page is known
NEVER = frozenset("head script style noscript template iframe object svg canvas button select option textarea title".split())
FEW_WORDS, LINKED = 25, 0.3       # evidence against a weakly named container
_SEGMENT = re.compile(r"[\s_-]+")
_SCOPES = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "option": 5}
_NO_SCOPE = (-1,) * 6
_LISTS = frozenset("ul ol dl table select article body".split())


class _Mark:
    """An element that may be furniture: how it is named, and what it holds."""
    __slots__ = ("up", "weak", "comments", "bare", "keeps_articles", "chars", "linked", "words", "article")

    def __init__(self, up, weak=False, comments=False, bare=False, keeps_articles=True):
        self.up, self.weak, self.comments, self.bare, self.keeps_articles = up, weak, comments, bare, keeps_articles
        self.chars = self.linked = self.words = 0
        self.article = False


class _Lines(HTMLParser):
    """Collects (pieces of text, tags, innermost container, noise) for each line; every step costs a constant, or is paid
    for by the elements it closes, so a page takes time linear in its length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []                      # (tag, innermost container, mark, unread, scopes)
        self.opened: dict[str, int] = {}                 # open elements by tag
        self.parent, self.name = [0], [""]               # container tree; 0 is the page
        self.marks: list[_Mark] = []
        self.lines: list[tuple] = []
        self.buffer: list[tuple[str, int, bool]] = []    # (text, mark, inside a link)
        self.tags = self.noise = 0
        self.at: tuple = (0, -1, False, _NO_SCOPE)

    def updatepos(self, i, j):
        return j                                          # line numbers are not needed

    def parse_marked_section(self, i, report=1):
        """<![CDATA[...]]> is skipped; any other marked section is a comment up to the next '>'."""
        end = self.rawdata.find("]]>", i) if self.rawdata.startswith("<![CDATA[", i) else -1
        return end + 3 if end >= 0 else self.parse_bogus_comment(i, 0)

    def finish(self):
        """The end of the page: text that could still have become a reference is text, a tag or comment that never ends is
        dropped with all behind it."""
        rest, self.rawdata = self.rawdata, ""
        if rest and not re.match(r"<[a-zA-Z/!?]", rest):
            self.handle_data(unescape(rest))
        self._end_line()

    def _end_line(self):
        if self.noise or any(not t.isspace() for t, _, _ in self.buffer):
            self.lines.append((self.buffer, self.tags, self.at[0], self.noise))
            self.buffer, self.tags, self.noise = [], 0, 0
        else:
            self.buffer.clear()

    def _cut(self, i):
        """Close the open elements from number i on."""
        for name, *_ in self.open[i:]:
            self.opened[name] -= 1
        del self.open[i:]
        self.at = self.open[-1][1:] if self.open else (0, -1, False, _NO_SCOPE)

    def _close_implied(self, tag):
        scopes = self.at[3]
        if tag in CLOSES_P and scopes[0] >= 0:
            self._cut(scopes[0])
            scopes = self.at[3]
        if tag in _SCOPES and tag != "p":
            at = scopes[_SCOPES[tag]]
            if tag == "tr" and at < 0:
                at = scopes[_SCOPES["td"]]
            if at >= 0:
                self._cut(at)

    def _mark(self, tag, attrs):
        """A _Mark if the element may be furniture by its tag, its attributes or its names."""
        up, in_article = self.at[1], self.opened.get("article", 0) + self.opened.get("main", 0) > 0
        names = [n for k, v in attrs if k in ("class", "id", "role") and v for n in v.lower().split()]
        comments = any(w in COMMENT_MARKS for n in names for w in _SEGMENT.split(n))
        if tag in ("article", "main", "body", "html"):
            named = any(w in ("comment", "comments") for n in names for w in _SEGMENT.split(n))
            return _Mark(up, comments=True) if named else None
        if tag in FURNITURE or tag == "header" and not in_article:
            return _Mark(up, comments=comments, bare=tag == "dialog", keeps_articles=tag in ("form", "header"))
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", ""):
                return _Mark(up, comments=comments)
        weak = False
        for name in names:
            parts = _SEGMENT.split(name)
            ends = [w for w in (parts[0], parts[-1]) if w in MARKS or not in_article and w in HEADER_MARKS]
            if name in MARKS or len(parts) > 1 and len(ends) == 2 or any(w not in WEAK for w in ends):
                return _Mark(up, comments=comments)
            weak = weak or bool(ends)
        return _Mark(up, weak=True, comments=comments) if weak and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") else None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
            self._close_implied(tag)
        if tag in VOID:
            return
        box, mark, unread, scopes = self.at
        if tag in CONTAINER:
            self.parent.append(box)
            self.name.append(tag)
            box = len(self.parent) - 1
        if tag in ("article", "main") and mark >= 0 and not unread:
            self.marks[mark].article = True
        unread = unread or tag in NEVER
        found = None if unread else self._mark(tag, attrs)
        if found:
            self.marks.append(found)
            mark = len(self.marks) - 1
        if tag in CONTAINER or tag in _LISTS:
            keep = list(scopes)
            if tag in CONTAINER:
                keep[0] = -1
            if tag in _LISTS:
                keep[1:] = [-1] * 5
            scopes = tuple(keep)
        if tag in _SCOPES:
            at = _SCOPES[tag]
            scopes = (*scopes[:at], len(self.open), *scopes[at + 1:])
        self.at = (box, mark, unread, scopes)
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.open.append((tag, *self.at))

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
        if self.opened.get(tag):
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            self._cut(i)

    def handle_data(self, data):
        if self.at[2]:
            self.noise += 1                               # leaves a line of ratio zero, without its text
        else:
            self.buffer.append((data, self.at[1], self.opened.get("a", 0) > 0))

    def judged(self) -> list[tuple[str, int, int, int, bool]]:
        """(text, tags, link characters, innermost container, marked) of each line, without the furniture.

        A container is no furniture, whatever its name, if it holds the article (an article or main element; for forms,
        headers and names) or more than half of a page's text (without one; comments excepted).  One that is only named
        by part of a name, by a word with another meaning, is furniture if it is mostly links or has few words.
        """
        marks, total, free = self.marks, 0, False
        for pieces, _, box, _ in self.lines:
            for text, mark, linked in pieces:
                n = len(text.strip())
                total += 0 if linked else n
                if mark >= 0:
                    m = marks[mark]
                    m.chars += n
                    m.linked += n if linked else 0
                    m.words += len(text.split())
        for m in reversed(marks):                         # an element's mark comes after those around it
            if m.up >= 0:
                up = marks[m.up]
                up.chars, up.linked, up.words = up.chars + m.chars, up.linked + m.linked, up.words + m.words
                up.article = up.article or m.article and m.keeps_articles and not m.comments
        has_article = any(n in ("article", "main") for n in self.name)
        off: list[bool] = []
        for m in marks:
            gone = not (m.article and m.keeps_articles and not m.comments)
            if gone and not m.comments and not m.bare and not has_article and (m.chars - m.linked) * 2 > total:
                gone = False
            if gone and m.weak and m.words >= FEW_WORDS and m.linked <= LINKED * m.chars:
                gone = False
            off.append(gone or m.up >= 0 and off[m.up])
        lines, tags, noise = [], 0, 0
        for pieces, own_tags, box, own_noise in self.lines:
            kept = [p for p in pieces if p[1] < 0 or not off[p[1]]]
            text = " ".join("".join([t for t, _, _ in kept]).split())
            links = sum(len(t) for t, _, linked in kept if linked)
            tags, noise = tags + own_tags, own_noise + len(pieces) - len(kept)
            if text or noise:
                lines.append((text, tags, links, box, not text))
                tags = 0
        return lines


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.finish()
    lines = page.judged()
    if not lines:
        return ""
    weight = np.array([0 if marked else max(0, len(text) - links) for text, _, links, _, marked in lines], float)
    ratio = weight / np.array([max(1, tags) for _, tags, _, _, _ in lines])
    level = smooth(ratio)
    content = (level > level.std()) & (weight > 0)
    if not content.any():
        content = np.array([not marked for *_, marked in lines])
    count = np.zeros(len(page.parent), int)
    for (*_, box, _), inside in zip(lines, content):
        count[box] += inside
    for box in range(len(count) - 1, 0, -1):             # children come after their parents
        count[page.parent[box]] += count[box]
    region = max(b for b in range(len(count)) if count[b] == count[0]) if count[0] else 0
    around = region
    while around and page.name[around] not in ("article", "main"):
        around = page.parent[around]
    region = around or region
    inside, whole = [False] * len(count), [not weight.any()] * len(count)
    inside[region], whole[region] = True, around > 0 or not weight.any()
    for box in range(region + 1, len(count)):
        inside[box] = inside[page.parent[box]]
        whole[box] = whole[page.parent[box]] or page.name[box] in ("article", "main")
    first = min((i for i, x in enumerate(lines) if inside[x[3]]), default=0)
    last = max((i for i, x in enumerate(lines) if inside[x[3]]), default=-1)
    if not around:                                       # text beside the region, up to the next line of links
        while first and (lines[first - 1][4] or weight[first - 1] > 0):
            first -= 1
        while last + 1 < len(lines) and (lines[last + 1][4] or weight[last + 1] > 0):
            last += 1
    return "\n".join(text for (text, _, _, box, marked), w in zip(lines[first:last + 1], weight[first:last + 1])
                     if not marked and (whole[box] or w > 0))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row."""
    schema = T.StructType([T.StructField("id", field_type(pages, id_col)), T.StructField("url", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("h"))
    return src.mapInArrow(run, schema)
