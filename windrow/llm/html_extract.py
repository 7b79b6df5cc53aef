"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; each block (the text between block-level tags) is a line with a
text-to-tag ratio: its characters outside links for each tag met. Ratios are smoothed by a Gaussian, lines above a threshold form content
clusters, and the regions that hold clusters are the article: every <article> that has one, else <main>, else the smallest
container with all clusters and the lines that adjoin it. A region is taken whole from its first line to its last, short
and linked lines too.

Only what the markup says outright overrides ratios: tags (nav, aside, footer, form and the like), roles and `hidden`. Names
(class, id) are a hint: a container all of whose name's words are of the kind that menus, adverts or notices bear loses
its lines, unless it holds a third of the page's smoothed ratios, for then it is content whatever its name is; only reader
comments go by their name alone. Names of headings and inline elements say nothing.

Time is linear in a page's length, however deep its elements are nested. Null and empty pages, and pages without text, give
an empty string. Each row is treated alone, repeated rows alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import read, trimmed

_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes noscript ol option p pre search section "
    "select summary table tbody td template tfoot th thead title tr ul".split()
)
#: Elements whose nesting matters. Others (p, inline) are often left open.
_HOLDS = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form head header html main menu nav noscript ol "
    "search section select table template td th tr title ul li button iframe object svg canvas math textarea".split()
)
_OUT_TAGS = frozenset("aside button canvas dialog fieldset footer form head iframe menu nav noscript object search select svg template textarea title".split())
_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of names that hint at what is not the article, and words that may stand beside them.
_HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs consent cookie cookies dialog "
    "disclaimer footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promos promotion promoted recommended related rss search share sharing sidebar sidebars signup skip skyscraper "
    "social sponsor sponsored sponsors subscribe subscription survey tags toolbar topbar widget widgets".split()
)
_REPLIES = frozenset("comment comments disqus replies respond reviews".split())
_NEUTRAL = frozenset("area bar block bottom box button buttons container content group inner item items left links list main outer page panel right section site text top wrap wrapper".split())
_NAMED = frozenset("aside div dl fieldset ol p section table td tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WHOLE = frozenset("html body main article".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HELD_SHARE = 1 / 3


def name_hint(names: str) -> int:
    """2 if a name is that of reader comments, 1 if one consists of boilerplate words and neutral ones, else 0."""
    best = 0
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)} - _NEUTRAL
        if words and words <= _HINTS | _REPLIES:
            best = max(best, 2 if words & _REPLIES else 1)
    return best


class _Lines(HTMLParser):
    """Collects lines: text, tags met, link characters, whether out by markup, and the innermost open container.

    Containers are numbered as they open, so those inside one have the numbers from its own to its `last`.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.kinds, self.parents, self.last, self.hints = ["page"], [0], [0], [0]
        self.open: list[tuple[str, int, bool]] = []  # tag, number, whether out before it
        self.scopes: list[Counter] = [Counter()]  # open tags since each of html, body, main, article
        self.text: list[str] = []
        self.tags = self.links = self.inside_link = self.articles = 0
        self.out = False
        self.paragraph = 0  # a paragraph's own container: paragraphs aren't kept open, as they are often not closed

    def here(self) -> int:
        return self.paragraph or (self.open[-1][1] if self.open else 0)

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, max(1, self.tags), self.links, self.out, self.here()))
            self.text = []
        self.tags = self.links = 0

    def number(self, tag: str, hint: int) -> int:
        for values, value in ((self.kinds, tag), (self.parents, self.open[-1][1] if self.open else 0), (self.last, len(self.last)), (self.hints, hint)):
            values.append(value)
        return len(self.kinds) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        breaks = tag in _BREAKS or tag in _HOLDS
        if breaks:
            self.flush()
            self.paragraph = 0
        self.tags += 1
        if tag == "br":
            self.text.append("\n")
        elif tag == "a":
            self.inside_link = 1
        if tag in ("script", "style"):
            self.push(tag, True, 0)
        elif breaks:
            given = {k: v or "" for k, v in attrs}
            out = tag in _OUT_TAGS or given.get("role", "").lower() in _OUT_ROLES or "hidden" in given or (tag == "header" and not self.articles)
            hint = name_hint(f"{given.get('class', '')} {given.get('id', '')}") if tag in _NAMED or tag == "article" else 0
            if tag in _HOLDS:
                self.push(tag, out, hint)
            elif hint:
                self.paragraph = self.number(tag, hint)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1][0] == tag and tag in ("svg", "iframe", "canvas", "object"):
            self.pop(len(self.open) - 1)

    def push(self, tag: str, out: bool, hint: int) -> None:
        if tag == "li" and self.scopes[-1]["li"]:  # an open item ends where the next begins
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in ("ul", "ol", "menu"):
                    break
                if self.open[k][0] == "li":
                    self.pop(k)
                    break
        self.open.append((tag, self.number(tag, hint), self.out))
        self.scopes[-1][tag] += 1
        if tag in _WHOLE:
            self.scopes.append(Counter())
        self.articles += tag == "article"
        self.out = self.out or out

    def pop(self, k: int) -> None:
        while len(self.open) > k:
            tag, number, self.out = self.open.pop()
            self.last[number] = len(self.last) - 1
            if tag in _WHOLE:
                self.scopes.pop()
            self.scopes[-1][tag] -= 1
            self.articles -= tag == "article"

    def handle_endtag(self, tag: str) -> None:
        if tag in _BREAKS or tag in _HOLDS:
            self.flush()
            self.paragraph = 0
        self.tags += 1
        if tag == "a":
            self.inside_link = 0
        if (tag in _HOLDS or tag in ("script", "style")) and (self.scopes[-1][tag] or tag in _WHOLE and any(s[tag] for s in self.scopes)):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.pop(k)
                    break

    def close(self) -> None:
        super().close()
        self.flush()
        self.pop(0)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment that never ends takes the rest of the page."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        if self.inside_link:
            self.links += len(data)


def ratios(lines: list[tuple[str, int, int, bool, int]], sigma: float) -> np.ndarray:
    """Smoothed text-to-tag ratios of the lines; boilerplate and link text count nothing."""
    raw = np.array([0.0 if out else max(0, len(text) - links) / tags for text, tags, links, out, _ in lines])
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel)[reach : reach + len(raw)]
    return np.convolve(raw, kernel)[reach : reach + len(raw)] / weight


def clusters(smooth: np.ndarray, usable: list[int]) -> list[int]:
    """The lines whose smoothed ratio reaches the threshold: the mean, or half of the greatest if that is less."""
    threshold = min(smooth.mean(), smooth[usable].max() / 2)
    return [k for k in usable if smooth[k] >= threshold]


def _sums(parser: _Lines, own: dict[int, float]) -> list[float]:
    """What each container holds, with all inside it."""
    held = [0.0] * len(parser.parents)
    for c, v in own.items():
        held[c] += v
    for c in range(len(held) - 1, 0, -1):
        held[parser.parents[c]] += held[c]
    return held


def _named_out(parser: _Lines, sigma: float) -> list[tuple[str, int, int, bool, int]]:
    """The lines, with those out that names rule out."""
    lines = parser.lines
    hinted = [c for c, h in enumerate(parser.hints) if h]
    if not hinted or not lines:
        return lines
    smooth, own = ratios(lines, sigma), Counter()
    for k, line in enumerate(lines):
        if not line[3]:
            own[line[4]] += smooth[k]
    held = _sums(parser, own)
    gone = sorted((c, parser.last[c]) for c in hinted if parser.hints[c] == 2 or held[c] < _HELD_SHARE * held[0])
    marks = np.zeros(len(parser.parents) + 1, np.int64)
    for first, last in gone:
        marks[first] += 1
        marks[last + 1] -= 1
    inside = np.cumsum(marks) > 0
    out = [(t, tags, links, out or bool(inside[c]), c) for t, tags, links, out, c in lines]
    return out if any(not line[3] for line in out) else lines


def main_text(html: str, sigma: float = 1.0) -> str:
    """The article of one page: blocks joined by an empty line."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = _named_out(parser, sigma)
    usable = [k for k, line in enumerate(lines) if not line[3]]
    if not usable:
        return ""
    cluster = clusters(ratios(lines, sigma), usable)
    own = Counter()
    for k in cluster:
        own[lines[k][4]] += len(lines[k][0])
    held = _sums(parser, own)
    for kind in ("article", "main"):
        named = [c for c, tag in enumerate(parser.kinds) if tag == kind and held[c]]
        if named:  # one inside another adds nothing
            marks = np.zeros(len(held) + 1, np.int64)
            for c in named:
                marks[c] += 1
                marks[parser.last[c] + 1] -= 1
            inside = np.cumsum(marks) > 0
            return "\n\n".join(lines[k][0] for k in usable if inside[lines[k][4]])
    # The innermost container with all clustered text, and what adjoins it; before and after the clusters, lists of links go.
    region = max(c for c, h in enumerate(held) if h == held[0])
    linked = [line[3] or line[2] >= 0.8 * len(line[0]) for line in lines]
    listed = [x and (k > 0 and linked[k - 1] or k + 1 < len(lines) and linked[k + 1]) for k, x in enumerate(linked)]
    chosen = [k for k in usable if region <= lines[k][4] <= parser.last[region] and (cluster[0] <= k <= cluster[-1] or not listed[k])]
    first, last = chosen[0], chosen[-1]
    while first and not linked[first - 1]:
        first -= 1
    while last + 1 < len(lines) and not linked[last + 1]:
        last += 1
    return "\n\n".join(lines[k][0] for k in [*range(first, chosen[0]), *chosen, *range(chosen[-1] + 1, last + 1)])


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with a column of main text; the html column stays out."""
    fields = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f"{', ' if fields else ''}`{text_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) if x else "" for x in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], [*names, text_col])

    return pages.select(*names, html_col).mapInArrow(trimmed(run), schema)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
