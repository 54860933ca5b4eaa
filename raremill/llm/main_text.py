"""Main text of web pages by differencing pages of near URLs (operator 11).

A page becomes lines, one per block of its markup, each with its place: inside the page's article
(``article``, ``main``), inside an element that says it is something else (menu, header,
footer, sidebar, notice, advert, form, script, style, comments: by element, role, class or id),
or neither. All pages are differenced: the pages
of a host are ordered by URL path, a page is paired with its nearest neighbours of other paths on both
sides, the lines of both are aligned by their longest common subsequence, and those
they share are the template's. Neighbours that share more than ``copy_share`` of the page's own
text are copies of it and say nothing about the template; the next one is taken instead. Of a page that
marks no article the lines of the third kind that no neighbour shares are the main text. Where all that it may look at
share so much, it is one of many copies, or most of it is template: the lines that more than half of the
host's different pages have go then (of more than ``neighbours`` such pages). Where a page marks
its article, the marks are an exact check of that verdict: a line that marked articles of neighbours have too stays, and
one that all of the (four) neighbours have outside their articles alone is a stray of the template and goes. Fewer
neighbours are less sure, as they name the page's title in their menus: of lines that all of them have outside alone
those at the article's end go that they have behind theirs, as an article that is not closed takes them in.

Only line checksums and lengths travel to the neighbours: the page that stands for a path once, and blocks of the
order carry as many neighbours beyond their edges as a page may look at, so that a host of any size, and a path of any
number of pages, is spread over many tasks.

Null and empty pages have an empty text. Pages whose URL is null or has no host have no
neighbours; repeated rows, also of one id, are rows of their own with equal texts; of several pages of
one path the one with the least checksums stands for the path. Very long lines and pages are whole: lines are
compared by bit-parallel rows, in parts where the table would not fit. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raremill.llm.tasks import map_rows, stored

#: Neighbours looked at on each side, and those differenced with.
REACH, NEIGHBOURS = 8, 2
#: Paths in a block of the order.
BLOCK = 256

# Elements and words that name what is not the article.
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_DROPPED = frozenset(
    "head nav footer aside form menu dialog button select datalist fieldset svg math template noscript iframe object "
    "audio video canvas map applet".split()
) | _RAW
_ROLES = frozenset("navigation banner contentinfo search complementary form dialog alertdialog menu menubar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo nav navbar navigation menu "
    "breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "comment comments disqus replies share sharing social related masthead".split()
)
_COMMENTS = frozenset("comment comments disqus replies".split())
_ARTICLE = frozenset(("article", "main"))
_BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 header hgroup ul ol li dl dt dd table caption colgroup thead "
    "tbody tfoot tr td th blockquote pre figure figcaption address details summary center legend optgroup option "
    "search".split()
) | _DROPPED
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(("hr",))
# elements that a sibling of the same family ends
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(
    r"""<(?:!--(?:(?!-->)[\s\S])*+(?:-->|\Z)|[!?][^>]*+>?|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?)"""
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

OPEN, ARTICLE, OTHER = 0, 1, 2


# --- lines of a page ----------------------------------------------------------


def _says(attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes name something other than an article; whether comments."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False, False
    other = comments = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            found = {w.lower() for w in _WORD.findall(value)}
            other = other or not found.isdisjoint(_WORDS)
            comments = comments or not found.isdisjoint(_COMMENTS)
        elif name == "role":
            other = other or value.lower() in _ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            other = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            other = True
    return other, comments


class _Page:
    """Open elements and the lines so far. An open element is (name, other, comments): whether it
    keeps its text out of the article."""

    def __init__(self):
        self.open: list[list] = []
        self.text: list[str] = []
        self.lines: list[tuple[str, int]] = []
        self.articles = 0

    def place(self) -> int:
        if any(other for _, other, _ in self.open):
            return OTHER
        return ARTICLE if any(name in _ARTICLE for name, _, _ in self.open) else OPEN

    def end_line(self) -> None:
        if self.text:
            line = " ".join(entities.unescape("".join(self.text)).split())
            self.text.clear()
            if line:
                self.lines.append((line, self.place()))

    def start(self, name: str, attributes: str) -> None:
        if name in _VOID:
            if name in _BREAKS:
                self.end_line()
            else:
                self.text.append(" " if name == "br" else "")
            return
        block = name in _BLOCKS
        other, comments = _says(attributes)
        inside = any(n in _ARTICLE for n, _, _ in self.open)
        other = other or name in _DROPPED or (name == "header" and not inside)
        if name in ("html", "body"):
            other = False
        if not block and not other:
            return
        self.end_line()
        ends = _ENDS.get(name, {"p"} if block else ())
        if self.open and self.open[-1][0] in ends:
            self.open.pop()
        if name in _ARTICLE:
            # a class word of an element around the page's first article is about its layout
            if not self.articles and not comments:
                other = False
                for around in self.open:
                    if around[0] not in _DROPPED and not around[2]:
                        around[1] = False
            self.articles += not comments
        self.open.append([name, other, comments])

    def end(self, name: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == name:
                self.end_line()
                del self.open[at:]
                return
        if name in _BLOCKS:
            self.end_line()


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """(text, place) of each block with text, in page order."""
    if not page:
        return []
    out, at, size = _Page(), 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            out.text.append(page[at:])
            break
        out.text.append(page[at : found.start()])
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if found.group(1):
            out.end(name)
            continue
        out.start(name, found.group(3))
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = close.end() if close else size
            out.end(name)
    out.end_line()
    return out.lines


# --- common lines ---------------------------------------------------------------


def _rows(a: list, b: list) -> list[int]:
    """After each line of ``a`` a number whose zero bits mark where the length of the longest
    common subsequence with ``b`` rises."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        hit = where.get(x, 0)
        both = row & hit
        row = ((row + both) | (row - both)) & full
        out.append(row)
    return out


def common_lines(a: list, b: list, most_bits: int = 1 << 28) -> list[int]:
    """Places in ``a`` of one longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    head, tail = list(range(start)), list(range(len(a) - end, len(a)))
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    held, present = set(b), set(a)
    kept = [i for i, x in enumerate(a) if x in held]
    a, b = [a[i] for i in kept], [y for y in b if y in present]
    return head + [start + kept[i] for i in _aligned(a, b, most_bits)] + tail


def _aligned(a: list, b: list, most_bits: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > most_bits:
        return _halved(a, b, most_bits)
    rows, out, j = _rows(a, b), [], len(b)
    for i in range(len(a) - 1, -1, -1):
        mask = (1 << j) - 1
        here = j - (rows[i] & mask).bit_count()
        before = j - (rows[i - 1] & mask).bit_count() if i else 0
        if here > before:
            out.append(i)
            # the last column where the length with this line still rises
            j = (~rows[i] & mask).bit_length() - 1
    return out[::-1]


def _halved(a: list, b: list, most_bits: int) -> list[int]:
    """The same in two halves of ``a``, met where the lengths add up to most."""
    middle = len(a) // 2
    upper = _last_row(a[:middle], b)
    lower = _last_row(a[middle:][::-1], b[::-1])[::-1]
    at = max(range(len(b) + 1), key=lambda j: upper[j] + lower[j])
    left = _aligned(a[:middle], b[:at], most_bits)
    return left + [middle + i for i in _aligned(a[middle:], b[at:], most_bits)]


def _last_row(a: list, b: list) -> list[int]:
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | (1 << j)
    row = full = (1 << len(b)) - 1
    for x in a:
        both = row & where.get(x, 0)
        row = ((row + both) | (row - both)) & full
    bits, out = bin(row | (1 << len(b)))[3:][::-1], [0]
    for bit in bits:
        out.append(out[-1] + (bit == "0"))
    return out


# --- pages ------------------------------------------------------------------------

_PARSED = (
    "row long, page_id long, url string, host string, path string, text string, sums array<long>, sizes array<int>, "
    "marked boolean"
)
TEXT_SCHEMA = "page_id long, url string, text string, n_chars long"
_URL = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]+)([^?#]*)")
_ENDING = re.compile(r"(?:/index)?\.(?:html?|php|aspx?|jsp)$|/+$")


def place_of(url: str | None) -> tuple[str | None, str | None]:
    """Host and path of a URL: without query, fragment, index page or closing slash."""
    found = _URL.match(url or "")
    if not found:
        return None, None
    host = found.group(1).rpartition("@")[2].lower()
    return host, _ENDING.sub("", found.group(2).strip()) or "/"


def _sums(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]


def _parsed(pages: DataFrame) -> DataFrame:
    """Pages with their own lines as text: those of the marked article, or all that may be differenced. ``sizes``
    holds the lengths of own lines, 0 for the others."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(6)]
            for url, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = page_lines(page)
                kinds = {kind for _, kind in found}
                marked = ARTICLE in kinds or OPEN not in kinds
                own = ARTICLE if marked else OPEN
                row = (
                    *place_of(url), "\n".join(x for x, kind in found if kind == own), _sums([x for x, _ in found]),
                    [len(x) if kind == own else 0 for x, kind in found], marked,
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], _names(_PARSED))

        return step

    return map_rows(pages.select(F.monotonically_increasing_id().alias("row"), "*"), make, _PARSED, rows=64)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


_ORDERED = "row long, host string, path string, sums array<long>, sizes array<int>, marked boolean, part int, k long, first boolean"


def _ordered(parsed: DataFrame) -> DataFrame:
    """Pages in the order of their paths: ``at`` numbers the paths, and the first page of each
    (``first``) stands for it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, k = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            places, first = [], []
            for own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                first.append(own != last)
                k += own != last
                last = own
                places.append(k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(first), pa.int32()), pa.array(places, pa.int64()), pa.array(first, pa.bool_())],
                names,
            )

    names = _names(_ORDERED)
    # pages of one path may go on in the next part
    order = ("host", "path", "sums", "row")
    rows = parsed.where("host is not null").select("row", "host", "path", "sums", "sizes", "marked")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.mapInArrow(number, _ORDERED), "ordered", "zstd")
    place = F.struct("host", "path")
    parts = rows.groupBy("part").agg((F.max("k") + 1).alias("size"), F.min(place).alias("begins"), F.max(place).alias("ends"))
    # one row per part
    by_part = Window.orderBy("part")
    parts = parts.withColumn("goes_on", F.coalesce(F.col("begins") == F.lag("ends").over(by_part), F.lit(False)))
    start = F.sum(F.col("size") - F.col("goes_on").cast("long")).over(by_part) - F.col("size")
    starts = parts.select("part", start.alias("start"), "goes_on")
    met = rows.join(F.broadcast(starts), "part")
    first = F.col("first") & ~(F.col("goes_on") & (F.col("k") == 0))
    return met.select("row", "host", "sums", "sizes", "marked", (F.col("start") + F.col("k")).alias("at"), first.alias("first"))


#: Pages of a block that one task differences; a block whose paths have more is dealt to several.
_MOST = 4096


def _kept(parsed: DataFrame, copy_share: float, neighbours: int, reach: int, block: int) -> DataFrame:
    """(row, kept) of each page of which lines go: which of its own lines stay when it is differenced with the
    neighbours among the ``reach`` nearest other paths of its host on each side; null if none of those tells."""
    pages = _ordered(parsed).withColumn("block", F.floor(F.col("at") / block).cast("long"))
    sizes = pages.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / _MOST).cast("long").alias("deals"))
    homes = F.array_distinct(F.transform(
        F.array(F.lit(0), F.lit(-reach), F.lit(reach)), lambda d: F.floor((F.col("at") + d) / block).cast("long")
    ))
    paths = pages.where("first").select("host", "sums", "sizes", "marked", "at", F.explode(homes).alias("block")).join(sizes, "block")
    paths = paths.select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), "at",
        F.lit(None).cast("long").alias("row"), "host", "sums", "sizes", "marked",
    )
    own = pages.join(sizes, "block").select(
        "block", F.pmod("row", "deals").alias("deal"), "at", "row", "host", "sums", "sizes", "marked"
    )
    # a block's paths come before its pages
    order = ("block", "deal", F.col("row").asc_nulls_first(), "at")
    sent = paths.unionByName(own).repartition("block", "deal").sortWithinPartitions(*order)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, {}
        for batch in batches:
            rows, kept = [], []
            for block_, deal, at, row, host, sums, lengths, marked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (block_, deal):
                    key, known = (block_, deal), {}
                if row is None:
                    known[at] = host, (sums, lengths, marked)
                    continue
                near = (known[j][1] for d in range(1, reach + 1) for j in (at - d, at + d) if known.get(j, (None,))[0] == host)
                gone = template_lines(sums, lengths, marked, near, copy_share, neighbours)
                if gone is None or gone:
                    rows.append(row)
                    kept.append(None if gone is None else [i not in gone for i, size in enumerate(lengths) if size])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(kept, pa.list_(pa.bool_()))], ["row", "kept"])

    return sent.mapInArrow(task, "row long, kept array<boolean>")


def template_lines(
    sums: list[int], sizes: list[int], marked: bool, near: Iterable[tuple[list[int], list[int], bool]], copy_share: float, neighbours: int
) -> set[int] | None:
    """Places of a page's own lines that are its template's by the neighbours in ``near``, given as checksums, sizes and
    whether they mark their article; None if all of them are copies of a page without marks.
    In a marked article the marks of the neighbours decide: a line goes if all of them have it outside
    their articles, and none inside; if they are fewer than ``neighbours``, from the article's end alone."""
    size = sum(sizes)
    shared: Counter[int] = Counter()
    inside: set[int] = set()
    behind: list[set[int]] = []
    copies = 0
    for other, lengths, article in near:
        own = [i for i in common_lines(sums, other) if sizes[i]]
        if sum(sizes[i] for i in own) > copy_share * size:
            copies += 1
            continue
        shared.update(own)
        theirs = [j for j, length in enumerate(lengths) if length and article]
        if marked and own:
            held = {other[j] for j in theirs}
            inside.update(i for i in own if sums[i] in held)
        behind.append(set(other[theirs[-1] + 1 :] if theirs else other))
        if len(behind) == neighbours:
            break
    if not marked:
        return None if copies and not behind else set(shared)
    outside = {i for i, n in shared.items() if n == len(behind) and i not in inside}
    if len(behind) == neighbours:
        return outside
    # the article's first line, mostly its title, is no end
    ends = [i for i, length in enumerate(sizes) if length][:0:-1]
    return set(takewhile(lambda i: i in outside and all(sums[i] in lines for lines in behind), ends))


def _by_host(parsed: DataFrame, kept: DataFrame, neighbours: int) -> DataFrame:
    """(row, kept) of the pages that their neighbours do not tell about: lines go that more than half of the
    host's different pages have."""
    asked = parsed.join(kept.where("kept is null").select("row"), "row", "left_semi").select("row", "host", "sums", "sizes")
    asked = stored(asked, "asked")
    pages = parsed.join(asked.select("host").distinct(), "host", "left_semi").select("host", "sums").distinct()
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct("sums")).alias("line"))
    lines = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held")).join(counts, "host")
    goes = lines.where((F.col("pages") > neighbours) & (2 * F.col("held") > F.col("pages"))).select("host", "line", F.lit(True).alias("goes"))
    own = asked.select("row", "host", F.posexplode(F.arrays_zip("sums", "sizes")).alias("i", "x")).where("x.sizes > 0")
    own = own.select("row", "host", "i", F.col("x.sums").alias("line")).join(goes, ["host", "line"], "left")
    stays = F.sort_array(F.collect_list(F.struct("i", F.col("goes").isNull().alias("stays"))))
    return own.groupBy("row").agg(F.transform(stays, lambda x: x["stays"]).alias("kept"))


def main_texts(
    pages: DataFrame,
    copy_share: float = 0.8,
    neighbours: int = 2 * NEIGHBOURS,
    reach: int = REACH,
    block: int = BLOCK,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: its main text, blocks joined by line feeds."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    parsed = stored(_parsed(rows), "pages", "zstd")
    kept = stored(_kept(parsed, copy_share, neighbours, reach, block), "kept")
    if kept.where("kept is null").head(1):
        kept = kept.where("kept is not null").unionByName(_by_host(parsed, kept, neighbours))
    met = parsed.select("row", "page_id", "url", "text").join(kept, "row", "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: F.col("kept")[i])
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
