"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard-library parser's events give lines: the text of one block element
with the number of tags in it. Lines inside elements that never hold article
text (by tag, role, or names of class and id) are left out. A name counts if all
its words tell such a use or a place; an element left out by name alone stays if it
holds the page's ``article`` or ``main``, or, without those, most of the text. The
ratio of text to tags of each line is smoothed by a Gaussian and clustered in two by a threshold;
regions with lines of the upper cluster are content. Being in an ``article``
or ``main`` element is a prior that raises a line's level; such an element is one
region, so its short lines stay. Elsewhere a region is what one ``div``,
``section`` or the body holds: its paragraphs, lists and tables, and ``div``
elements with text of their own. Where the clusters lie close together all lines
are upper. Lines between content lines stay, and so do headings right before them.
Lines of links in the lower cluster go wherever they are, but for a single ``p``
between lines of a content region.

White space inside a block becomes one space; blocks follow page order, joined by
two line feeds; nothing is shortened. Null and empty pages give an empty text; so
do pages of links without an article. Very long pages are fed to the parser in
slices and cost memory in proportion. Each row is read by itself, so repeated rows
are read alike; other columns, whatever their names, are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkernel import small_batches

SIGMA, SLICE = 1.0, 1 << 16
#: What being in an article or main element adds to a line's level, as a ratio four times as high would.
PRIOR = float(np.log(4))
#: Clusters are apart if their mean levels differ by this much.
APART = 1.5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style head title noscript template svg math iframe object canvas audio video map "
    "nav header footer aside form button select textarea option datalist dialog menu search fieldset".split()
)
REGION = frozenset(("article", "main"))
#: Elements that hold regions of lines.
HOLDS = frozenset("body center details div section".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names whose elements are not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc header masthead topbar footer sidebar aside widget widgets "
    "comment comments commentlist discussion disqus replies reply respond cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login related recommended share sharing social pagination pager skip hidden".split()
)
#: Words that only place or shape what NAMES names: ``sidebar-left`` is a sidebar, ``content-sidebar-wrap`` and ``no-sidebar`` aren't.
PLACES = frozenset(
    "left right top bottom upper lower first last inner outer primary secondary main site page post entry article global mobile desktop "
    "wrap wrapper container box area list section bar block item items link links button buttons form title text icon icons slot unit zone thread js".split()
)
#: An article or main element itself is left out by fewer words.
OWN = frozenset("ad ads comment comments reply related promo sponsored widget".split())
#: Elements that an element start closes: {start: what it ends}.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


class _Events(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, left out, region, number
        self.lines: list[tuple[str, int, int, str, int, int]] = []  # text, tags, region, block tag, link characters, holder
        self.named: list[int] = []  # numbers of the open elements that are left out by name
        self.within: list[tuple[int, ...]] = []  # those around each line
        self.around: list[tuple[int, ...]] = []  # and around each region
        self.text: list[str] = []
        self.tags = self.linked = self.regions = self.dropping = self.links = self.opened = 0
        self.region = -1
        self.block = "body"

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.tags, self.region, self.block, self.linked, self._holder()))
                self.within.append(tuple(self.named))
            self.text = []
        self.tags = self.linked = 0

    def _holder(self) -> int:
        """The number of the element that holds the block of the text; 0 for the body."""
        inner = True
        for tag, _, _, number in reversed(self.stack):
            if tag == "body":
                break
            if not inner and tag in HOLDS:
                return number
            inner = inner and tag not in BLOCK
        return 0

    def _pop(self, at: int) -> None:
        for tag, out, _, number in self.stack[at:]:
            self.dropping -= out
            while self.named and self.named[-1] >= number:
                self.named.pop()
            self.links -= tag == "a"
        del self.stack[at:]
        self.region = next((r for _, _, r, _ in reversed(self.stack) if r >= 0), -1)

    def _left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body"):
            return False
        if tag == "header" and self.region >= 0:
            return False  # an article's own heading
        if tag in DROPPED:
            return True
        for name, value in attrs:
            if value is None:
                if name == "hidden":
                    return True
            elif name == "role":
                if value.strip().lower() in ROLES:
                    return True
            elif name == "aria-hidden":
                if value.strip().lower() == "true":
                    return True
            elif name == "style":
                if "display:none" in value.replace(" ", "").lower():
                    return True
        return False

    def _named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body") or tag == "header" and self.region >= 0:
            return False
        for name, value in attrs:
            if name in ("class", "id") and value:
                for token in value.split():
                    words = {w.lower() for w in _WORDS.findall(token)}
                    found = words & NAMES
                    if found and all(w in NAMES or w in PLACES or w.isdigit() for w in words) and (tag not in REGION or found & OWN):
                        return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name == "p" or name in CLOSES.get(tag, ()):
                    self._pop(k)
                    break
                if name in BLOCK:
                    break
            self.block = tag
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        out = self._left_out(tag, attrs)
        named = not out and not self.dropping and self._named(tag, attrs)
        region = -1
        if tag in REGION and not named and not out and not self.dropping and self.region < 0:
            region = self.region = self.regions
            self.regions += 1
            self.around.append(tuple(self.named))
        self.dropping += out
        self.links += tag == "a"
        self.opened += 1
        if named:
            self.named.append(self.opened)
        self.stack.append((tag, out, region, self.opened))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break
            if self.stack[k][0] in ("td", "th", "article", "main", "body") and tag not in ("table", "tr", "tbody", "article", "main", "body", "html"):
                break

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def _smoothed(x: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(x)), k, "full")[reach : reach + len(x)]
    return np.convolve(x, k, "full")[reach : reach + len(x)] / weight


def _cut(x: np.ndarray) -> float:
    """The threshold of two-means clustering in one dimension."""
    cut = x.mean()
    for _ in range(20):
        low, high = x[x < cut], x[x >= cut]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return float(min(cut, x.max()))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    events = _Events()
    for at in range(0, len(html), SLICE):
        events.feed(html[at : at + SLICE])
    events.close()
    events.flush()
    lines = _unnamed(events)
    if not lines:
        return ""
    ratio = np.array([max(0, len(t) - 2 * linked) / max(1, tags) for t, tags, _, _, linked, _ in lines], float)
    inside = np.array([r >= 0 for _, _, r, _, _, _ in lines])
    region = np.array([-1 - r if r >= 0 else holder for _, _, r, _, _, holder in lines])
    plain = np.log1p(ratio) + PRIOR * inside
    level = _smoothed(np.log1p(ratio)) + PRIOR * inside
    cut = _cut(level)
    upper = level >= cut
    linked = ratio == 0
    low_links = linked & ~upper
    if upper.all() or level[upper].mean() - level[~upper].mean() < APART:
        upper[:] = True
        cut = 0.0
    # smoothing lifts lines beside another region: they alone don't make theirs content
    seed = upper & ~linked & (plain >= cut)
    if not seed.any():
        seed = upper & ~linked
    if not seed.any():
        # a page of links: nothing is content but what an article holds
        return "\n\n".join(lines[k][0] for k in np.flatnonzero(inside))
    content = np.isin(region, region[seed])
    place = np.flatnonzero(seed)
    own = content.copy()
    own[place[0] : place[-1] + 1] = True
    keep = own & ~linked | content & inside & ~low_links
    for k in np.flatnonzero(content & low_links):
        beside = [j for j in (k - 1, k + 1) if 0 <= j < len(lines) and region[j] == region[k] and not linked[j]]
        keep[k] = lines[k][3] == "p" and len(beside) == 2
    for k in range(len(lines) - 2, -1, -1):
        if keep[k + 1] and not keep[k] and lines[k][3] in HEADING:
            keep[k] = True
    return "\n\n".join(lines[k][0] for k in np.flatnonzero(keep))


def _unnamed(events: _Events) -> list[tuple[str, int, int, str, int, int]]:
    """The lines that aren't left out by name."""
    size = [0] * events.regions
    total, inside = 0, {}
    for line, within in zip(events.lines, events.within):
        total += len(line[0])
        if line[2] >= 0 and within == events.around[line[2]]:
            size[line[2]] += len(line[0])
        for number in within:
            inside[number] = inside.get(number, 0) + len(line[0])
    free = any(n and not around for n, around in zip(size, events.around))
    stay: set[int] = set()
    if not free and any(size):
        stay.update(events.around[size.index(max(size))])
    elif not free:
        stay.update(k for k, n in inside.items() if 2 * n > total)
    return [line for line, within in zip(events.lines, events.within) if stay.issuperset(within)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return small_batches(pages).select("page_id", "url", "html").mapInArrow(run, schema)
