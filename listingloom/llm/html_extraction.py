"""Main text of web pages by differencing against the page with the nearest URL.

A page is read as a sequence of text lines, one per block. Its lines are aligned with those of
the page next to it by path on its host, by longest common subsequence, and lines that both
share are deleted as the host's template. Markup is evidence on top of that: lines in menus,
headers, footers, asides, forms, adverts and comments go whether shared or not, and lines of an
article element stay, as articles of a host may share a passage.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from listingloom.llm.tables import by_slices, stored

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head script style noscript template iframe object svg canvas math audio video select option button "
    "textarea datalist title".split()
)
CHROME = frozenset("nav footer aside form menu dialog".split())
CONTENT = frozenset("article main".split())
_CHROME_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|"
    r"header|masthead|footer|side-?bars?|aside|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|"
    r"subscribe|signup|login|search|share|sharing|social|related|recommend\w*|widget|comments?|commentlist|"
    r"respond|replies|disqus|pagination|pager|toolbar|skip-?link)(?:$|[-_\s\d])",
    re.I,
)
_CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split()
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: Zones of a line.
OPEN, TEMPLATE, ARTICLE = 0, 1, 2


class _Page(HTMLParser):
    """Reads the lines of a page, and what its elements link to; without ``zones`` only what is shown."""

    def __init__(self, zones: bool = True):
        super().__init__(convert_charrefs=True)
        self.zones = zones
        self.open: list[tuple[str, int | None]] = [("", OPEN)]
        self.lines: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.links: list[tuple[str, str]] = []

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns of the source aren't counted: nothing asks for them."""
        return j

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.open[-1][1]))
        self.parts.clear()

    def _zone(self, tag: str, attrs: dict[str, str | None]) -> int | None:
        """None where nothing is shown; otherwise the zone of what stands in the element."""
        now = self.open[-1][1]
        if now is None or tag in UNSEEN:
            return None
        if "hidden" in attrs or _HIDDEN.search(attrs.get("style") or ""):
            return None
        if not self.zones:
            return OPEN
        if now == TEMPLATE or tag in CHROME or (attrs.get("role") or "").lower() in _CHROME_ROLES:
            return TEMPLATE
        if tag == "header" and now != ARTICLE:
            return TEMPLATE
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if tag not in ("html", "body", "header") and tag not in CONTENT:
            found = _CHROME_NAMES.search(names)
            if found and not (now == ARTICLE and "header" in found[0].lower()):
                return TEMPLATE
        return ARTICLE if tag in CONTENT else now

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for name, value in attrs:
            if value and name in ("href", "src"):
                self.links.append((f"{tag}/@{name}", value))
        if self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.open.pop()
        if tag in BLOCKS:
            self.flush()
            self._close_implied(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            zone = self._zone(tag, dict(attrs))
            if zone != self.open[-1][1]:
                self.flush()
            self.open.append((tag, zone))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, an item ends the item before it."""
        ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
        for name in (*ends.get(tag, ()), "p"):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == name:
                    del self.open[i:]
                    break
                if self.open[i][0] in BLOCKS:
                    break
        if tag == "body":
            self.open = [x for x in self.open if x[0] != "head"]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in UNSEEN:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if self.open[i][1] != self.open[i - 1][1]:
                    self.flush()
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1][1] is not None:
            self.parts.append(data)


def read_page(html: str | None, zones: bool = True) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """Lines of a page with the zone of each, and its links with their attribute, in order.

    Without ``zones`` all that is shown is open; a change of zone then ends no line.
    """
    reader = _Page(zones)
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.lines, reader.links


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """Lines of a page, in order, and the zone of each; white space is one space."""
    return read_page(html)[0]


def line_hashes(lines: list[tuple[str, int]]) -> list[int]:
    """A signed 64-bit hash per line."""
    found = (xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in lines)
    return [h - (1 << 64) if h >> 63 else h for h in found]


def common(a: list[int], b: list[int]) -> set[int]:
    """Indices in ``a`` of a longest common subsequence with ``b``, bit-parallel over ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    mine = [i for i, x in enumerate(a) if x in where]
    full = (1 << len(b)) - 1
    v, rows = full, []
    for i in mine:
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, r, c = set(), len(rows), len(b)
    while r and c:
        if rows[r - 1] >> (c - 1) & 1:
            c -= 1
            continue
        r -= 1
        if not r or rows[r - 1] >> (c - 1) & 1:
            out.add(mine[r])
            c -= 1
    return out


def url_parts(url: str | None) -> tuple[str, str]:
    """Host and path; what can't be read as a URL has no host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _alike(a: str, b: str) -> int:
    """Leading characters that two paths share."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def kept_lines(lines: list[tuple[str, int]], found: list[set[int]]) -> list[str]:
    """Lines that stay, given the lines shared with each page to compare with, nearest first.

    Lines outside articles that the nearest page shares go. If that leaves nothing, the next nearest
    page is tried; without another nothing is taken to be shared. Lines of an article stay.
    """
    for shared in [*found, set()]:
        kept = [t for i, (t, zone) in enumerate(lines) if zone == ARTICLE or (zone == OPEN and i not in shared)]
        if kept:
            return kept
    return []


def main_lines(lines: list[tuple[str, int]], partners: list[list[int]]) -> list[str]:
    """``kept_lines``, given the line hashes of the pages to compare with, nearest first."""
    hashes = line_hashes(lines)
    return kept_lines(lines, [common(hashes, p) for p in partners])


LINES = "array<struct<text:string,place:int,article:boolean>>"


def page_lines(pages: DataFrame, texts: bool = True) -> DataFrame:
    """``page_id, url``, host and path, ``hashes`` of all lines, and the ``lines`` that are no template.

    Each of those has its ``place`` among all lines of the page. ``digest`` is that of the hashes.
    Without ``texts`` the ``lines`` are left out.
    """

    def start() -> Callable[..., list]:
        def work(htmls: list[str | None], urls: list[str | None]) -> list:
            parts = [url_parts(u) for u in urls]
            read = [lines_of(x) for x in htmls]
            found = [[h for h, _ in parts], [p for _, p in parts], list(map(line_hashes, read))]
            if not texts:
                return found
            kept = [[(t, i, z == ARTICLE) for i, (t, z) in enumerate(lines) if z != TEMPLATE] for lines in read]
            return [*found, [[dict(zip(("text", "place", "article"), x)) for x in lines] for lines in kept]]

        return work

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    add = "host string, path string, hashes array<bigint>" + (f", lines {LINES}" if texts else "")
    found = by_slices(rows, ["page_id", "url"], add, start, ["html", "url"])
    return found.withColumn("digest", F.xxhash64("hashes"))


def neighbours(rows: DataFrame) -> DataFrame:
    """``host, digest, shared`` of the pages of ``rows`` (host, path, hashes, digest) that have a host.

    ``shared`` has the numbers of the lines that are shared with each page beside it on its host,
    nearest first; the first and last page of a host have the next two, or before two. Pages of a
    host with equal lines are one row, at the least of their paths, so the page beside it always
    differs. Rows are put in order of host and path by ranges; each range finds its own
    neighbours, and the ends of ranges, two rows each, find theirs among themselves and are broadcast.
    """

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for host, path, hashes, before, after in zip(*(batch[c] for c in ("host", "path", "hashes", "before", "after"))):
                sides = [[x for x in side if x is not None and x["host"] == host] for side in (after, before)]
                beside = [side[0] for side in sides if side] if all(sides) else [*sides[0], *sides[1]]
                beside.sort(key=lambda x: -_alike(path, x["path"]))
                mine = list(map(int, hashes))
                out.append([sorted(common(mine, list(map(int, x["hashes"])))) for x in beside])
            yield pd.Series(out, dtype="object")

    order = ["host", "path", "digest"]
    texts = rows.where("host <> ''").groupBy("host", "digest").agg(F.min("path").alias("path"), F.min("hashes").alias("hashes"))
    texts = stored(texts.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "texts")
    page = F.struct("host", "path", "hashes")

    def beside(along: WindowSpec) -> tuple[Column, Column]:
        return tuple(F.array(f(page, 1).over(along), f(page, 2).over(along)) for f in (F.lag, F.lead))

    along = Window.partitionBy("range").orderBy(*order)
    before, after = beside(along)
    at, n = F.row_number().over(along), F.count("*").over(Window.partitionBy("range"))
    texts = texts.select("*", before.alias("before"), after.alias("after"), (at <= 2).alias("top"), (at > n - 2).alias("end"))
    # Of each range the first two and last two rows, in one order: what precedes the first and follows the last.
    left, right = beside(Window.orderBy(*order))
    ends = texts.where("top or end").select("host", "digest", left.alias("left"), right.alias("right"))
    texts = texts.join(F.broadcast(ends), ["host", "digest"], "left")
    beside_it = F.struct(
        "host", "path", "hashes",
        F.when(F.col("top"), F.col("left")).otherwise(F.col("before")).alias("before"),
        F.when(F.col("end"), F.col("right")).otherwise(F.col("after")).alias("after"),
    )
    shared = F.pandas_udf(align, "array<array<int>>")(beside_it).alias("shared")
    return texts.select("host", "digest", shared)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Null and empty pages, and pages without a line outside the template, have an empty text. A
    page alone on its host has nothing to be compared with, nor has one without a host: a null,
    relative or unreadable URL. Repeated rows are read each. Columns other than ``page_id``, ``url``
    and ``html`` are not read. Each page is parsed twice, once for the hashes of its lines and once for
    the lines: they are moved once and never stored, and the HTML is neither.
    """
    near = neighbours(page_lines(pages, texts=False).select("host", "path", "hashes", "digest"))
    # Apart, the parts of the lines are smaller to move than one by one.
    apart = [F.col(f"lines.{c}").alias(c) for c in ("text", "place", "article")]
    rows = page_lines(pages).select("page_id", "url", "host", "digest", *apart)
    both = rows.join(near, ["host", "digest"], "left").withColumn("lines", F.arrays_zip("text", "place", "article"))

    def left(shared: Column) -> Column:
        gone = lambda x: F.coalesce(F.array_contains(shared, x["place"]), F.lit(False))
        return F.filter("lines", lambda x: x["article"] | ~gone(x))

    nearest, next_ = left(F.get("shared", F.lit(0))), left(F.get("shared", F.lit(1)))
    kept = F.when(F.size(nearest) > 0, nearest).when(F.size(next_) > 0, next_).otherwise(F.col("lines"))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
