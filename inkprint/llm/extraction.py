"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path, so the page nearest to a page is the one before
or after it: of those on its host, the one whose path shares the longer beginning (the one
before on a tie), but a copy of the page only if both are copies.  The text lines of the
two pages are aligned by their longest common subsequence; shared lines are the host's
template and are deleted.

What a pair cannot show is taken from the markup.  Lines inside elements that are named as
menus, headers, footers, sidebars, notices, adverts, forms or comments never are main text,
whether or not the other page has them (adverts rotate).  If a page marks its
article (``article``, else ``main``, else an element classed as content), only that is main
text; a shared line of a marked ``article`` or ``main`` is deleted unless it is a paragraph,
heading, list item, quotation or cell made of more text than links, since articles share
short lines and are copied whole.  Elsewhere shared lines go, except the running text of a pair
whose running text is three quarters alike: two copies of an article are no template.

A line is the text of a block element: character references decoded, white space runs
one space, trimmed.  ``br`` is white space.  Lines of main text are joined by two line breaks;
nothing else is dropped or cut.

*Scale.*  URLs alone give bounds of key ranges (a sample of them, whose size is bounded)
and the first and last key of each range; both are lists of one entry a range.  Pages move
once, to the task of their range, and the first and last of a range also to the neighbouring
one.  A task reads its sorted pages as a stream and holds three of them, so a host with
most of the pages is cut into ranges like any other.

Null html and pages without any text give an empty text.  A page whose URL is null or has
no host has no partner, nor has a host's only page: it keeps what its markup allows.
Pages with the same URL are ordered by id, then html; repeated rows are copies of each
other.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html as markup
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import table

#: Pages of a range, as far as there are not more than ``RANGES`` of them; sampled keys a range.
PAGES_PER_RANGE, RANGES, SAMPLED = 1_000, 32_768, 8
#: Pairs with at least this share of running text alike are copies.
COPY = 0.75
#: Bits of an alignment table that are held at once.
_TABLE_BITS = 1 << 28

# HTML element names by what they mean here, and the words of class, id and
# role attributes that name what is not main text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td template tfoot th thead title tr ul""".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_JUNK = frozenset("button dialog fieldset form head header input menu nav select search svg datalist".split())
_LASTING_JUNK = frozenset("aside footer noscript template object".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_JUNK_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promotion
    promotions banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager paging toc
    header masthead topbar footer footnav bottombar sidebar sidebars sidenav aside rail widget widgets cookie cookies consent
    gdpr ccpa notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup signin login
    register share sharing sharebar social follow related recommended recommendations recirc trending popular search form
    copyright legal disclaimer skip toolbar""".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist commentary commenters reply replies respond disqus discussion".split())
_CONTENT_WORDS = frozenset("article articlebody content contents maincontent post postbody entry story".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|</(?P<end>[a-zA-Z][^\s/<>]*)[^<>]*>?"
    r"|<(?P<start>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<broken>[a-zA-Z][^\s/<>]*)(?P<rest>[^<>]*)>?",
    re.S,
)
_ATTR = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|style|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Line(NamedTuple):
    text: str
    junk: bool
    level: int  # 3 in an article, 2 in main, 1 in an element classed as content, 0 elsewhere
    prose: bool  # running text: a paragraph or the like, more text than links
    links: float


class _State(NamedTuple):
    junk: bool = False
    lasting: bool = False  # junk that an article inside does not end
    level: int = 0
    header: bool = False  # in the header of an article
    heading: bool = False
    prose: bool = False
    link: bool = False


def _entered(s: _State, tag: str, attrs: str) -> _State:
    """The state inside an element."""
    words: set[str] = set()
    hidden = body = False
    role = ""
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                words.update(w.lower() for w in _WORD.findall(value))
            elif name == "role":
                role = value.strip().lower()
            elif name == "itemprop":
                body = value.strip().lower() == "articlebody"
            elif name == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            else:
                hidden = hidden or name == "hidden" or value.lower() == "true"
    if tag in ("html", "body"):
        return s
    lasting = s.lasting or hidden or tag in _LASTING_JUNK or bool(words & _COMMENT_WORDS) or role == "complementary"
    if tag == "article" or body or role == "article":
        return s._replace(junk=lasting, lasting=lasting, level=3)
    if tag == "main" or role == "main":
        return s._replace(junk=lasting, lasting=lasting, level=max(s.level, 2))
    header = s.header or (tag == "header" and s.level >= 2)
    junk = s.junk or lasting or role in _ROLES or bool(words & _JUNK_WORDS) or (tag in _JUNK and not header) or tag == "nav"
    level = max(s.level, 1) if tag in ("div", "section", "td") and words & _CONTENT_WORDS and not junk else s.level
    return _State(junk, lasting, level, header, s.heading or tag in _HEADING, s.prose or tag in _PROSE, s.link or tag == "a")


@lru_cache(maxsize=4096)
def _bare(s: _State, tag: str) -> _State:
    return _entered(s, tag, "")


def lines(page: str) -> list[Line]:
    """The text lines of a page, in order."""
    out: list[Line] = []
    stack: list[tuple[str, _State]] = []
    opened: Counter = Counter()
    state = _State()
    pieces: list[tuple[str, bool]] = []
    kind: _State | None = None

    def flush() -> None:
        nonlocal kind
        if kind is not None:
            text = "".join(p for p, _ in pieces)
            text = " ".join((markup.unescape(text) if "&" in text else text).split())
            if text:
                links = 0.0
                if any(link for _, link in pieces):
                    links = sum(len(p.strip()) for p, link in pieces if link) / max(sum(len(p.strip()) for p, _ in pieces), 1)
                junk = kind.junk or (kind.header and not kind.heading)
                out.append(Line(text, junk, kind.level, kind.prose and links < 0.5, links))
        pieces.clear()
        kind = None

    def add(text: str) -> None:
        nonlocal kind
        if kind is None and text.strip():
            kind = state
        if kind is not None and (kind.junk or not state.junk):  # advert inside a sentence: not part of it
            pieces.append((text, state.link))

    def close_to(at: int) -> None:
        nonlocal state
        for name, _ in stack[at:]:
            opened[name] -= 1
        state = stack[at][1]
        del stack[at:]

    at = 0
    for found in iter(lambda: _TAG.search(page, at), None):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = (found["start"] or found["broken"] or found["end"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            if tag in _BLOCK:
                flush()
            if tag == "br":
                add(" ")
            elif opened[tag]:
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        attrs = found["attrs"] or found["rest"] or ""
        if tag in _RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = ended.start() if ended else len(page)
            if ended:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag in _BLOCK:
            flush()
            ending, bounds = _CLOSES.get(tag, (set(), set()))
            for i in range(len(stack) - 1, -1, -1):  # what this element ends: an open paragraph, the item before
                name = stack[i][0]
                if name == "p" or name in ending:
                    close_to(i)
                    if not ending:
                        break
                elif name in bounds or (not ending and name in _BLOCK):
                    break
        if tag == "br":
            add(" ")
        if tag in _VOID:
            continue
        stack.append((tag, state))
        opened[tag] += 1
        if attrs.rstrip().endswith("/") and tag not in _BLOCK:
            close_to(len(stack) - 1)
            continue
        if "=" in attrs or "hidden" in attrs:
            state = _entered(state, tag, attrs)
        else:
            state = _bare(state, tag)
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _ones(a: list, b: list) -> list[int]:
    """Rows of the alignment table of ``a`` and ``b`` as bits: a 0 where the length of the
    longest common subsequence grows along ``b``."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, []
    for line in a:
        hit = row & where.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        out.append(row)
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for line in a:
        hit = row & where.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer((full ^ row).to_bytes((len(b) + 7) // 8, "little"), dtype=np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits[: len(b)], dtype=np.int64)])


def _aligned(a: list, b: list, offset: int, out: list[int]) -> None:
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.append(offset)
        return
    if len(a) * len(b) > _TABLE_BITS:  # halves of a, with b cut where the two parts share most
        mid = len(a) // 2
        cut = int((_lengths(a[:mid], b) + _lengths(a[:mid - 1 : -1], b[::-1])[::-1]).argmax())
        _aligned(a[:mid], b[:cut], offset, out)
        _aligned(a[mid:], b[cut:], offset + mid, out)
        return
    rows, i, j = _ones(a, b), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append(offset + i)


def shared(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    out = [*range(begin), *range(len(a) - end, len(a))]
    both = set(a[begin : len(a) - end]) & set(b[begin : len(b) - end])
    left = [i for i in range(begin, len(a) - end) if a[i] in both]
    found: list[int] = []
    _aligned([a[i] for i in left], [x for x in b[begin : len(b) - end] if x in both], 0, found)
    return {*out, *(left[k] for k in found)}


class _Page(NamedTuple):
    id: object
    url: str | None
    host: str
    path: str
    lines: list[Line]
    level: int
    own: bool  # of this range, not of the one beside


def _candidates(page: _Page) -> list[int]:
    return [i for i, x in enumerate(page.lines) if not x.junk and x.level >= page.level]


def _alike(page: _Page, same: set[int]) -> float:
    """Share of the page's running text in shared lines."""
    running = [(len(page.lines[i].text), i in same) for i in _candidates(page) if page.lines[i].prose]
    return sum(n for n, is_shared in running if is_shared) / max(sum(n for n, _ in running), 1)


def main_lines(page: _Page, others: list[_Page]) -> tuple[list[str], _Page | None, int]:
    """(lines of main text, partner, shared lines) given the pages beside it, nearest first."""
    mine = [x.text for x in page.lines]
    partner, same, copy = None, set(), False
    for other in others:
        found = shared(mine, [x.text for x in other.lines])
        is_copy = _alike(page, found) >= COPY
        if partner is None or (copy and not is_copy):
            partner, same, copy = other, found, is_copy
        if not copy:
            break
    kept = []
    for i in _candidates(page):
        line = page.lines[i]
        if i in same and not (line.prose and (page.level >= 2 or copy)):
            continue
        if partner is None and not page.level and line.links >= 0.8:
            continue
        kept.append(line.text)
    return kept, partner, len(same)


def _nearest(page: _Page, before: _Page | None, after: _Page | None) -> list[_Page]:
    def common(other: _Page) -> int:
        n = 0
        for x, y in zip(page.path, other.path, strict=False):
            if x != y:
                break
            n += 1
        return n

    return sorted((o for o in (before, after) if o is not None and page.host and o.host == page.host), key=common, reverse=True)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Page]]:
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("range", "own", "page_id", "url", "host", "path", "html")]
        for i in range(batch.num_rows):
            at, own, page_id, url, host, path, text = (c[i].as_py() for c in columns)
            found = lines(text or "")
            level = max((x.level for x in found if not x.junk), default=0)
            yield at, _Page(page_id, url, host, path, found, level, own)


_COLUMNS = ("page_id", "url", "text", "n_chars", "n_lines", "n_shared", "partner")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages come sorted by range and key; a page is done when the next one is known."""
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(_COLUMNS))

    def done(before: _Page | None, page: _Page, after: _Page | None) -> None:
        nonlocal size
        if page.own:
            kept, partner, n = main_lines(page, _nearest(page, before, after))
            text = "\n\n".join(kept)
            out.append((page.id, page.url, text, len(text), len(page.lines), n, partner.id if partner else None))
            size += len(text)

    at = before = page = None
    for where, following in _read(batches):
        if page is not None:
            done(before, page, following if where == at else None)
        before = page if where == at else None
        at, page = where, following
        if len(out) >= 1000 or size > 1 << 23:
            yield batch()
            out.clear()
            size = 0
    if page is not None:
        done(before, page, None)
    if out:
        yield batch()


def keyed(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path and the key that orders them."""
    site = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(url, site + r"([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(url, site + r"[^/?#]*([^?#]*)", 1).alias("path"),
        F.col("html").cast("string").alias("html"),
    ).withColumn("key", F.concat_ws("\u0001", "host", "path", F.col("url"), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")))


def _place(bounds: list[str], beside: dict[str, list[int]] | None = None) -> callable:
    """The ranges of a key: its own, and those beside that need it."""
    if beside is None:

        @F.pandas_udf("int")
        def own(keys: pd.Series) -> pd.Series:
            return keys.map(lambda k: bisect_right(bounds, k)).astype("int32")

        return own

    @F.pandas_udf("array<int>")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: [bisect_right(bounds, k), *beside.get(k, ())])

    return place


def ranges(keys: DataFrame, pages_per_range: int = PAGES_PER_RANGE) -> tuple[list[str], dict[str, list[int]]]:
    """(upper bounds of the key ranges, ranges beside that need a key).

    A sample by the keys' hash gives the bounds: they change which task does a page, never
    its result.  Both have one entry a range, and there are at most ``RANGES``."""
    n = keys.count()
    count = min(RANGES, math.ceil(n / pages_per_range))
    if count <= 1:
        return [], {}
    part = min(1.0, SAMPLED * count / n)
    least = int((1.0 - 2.0 * part) * (1 << 63)) if part < 1 else -(1 << 63)
    sample = sorted(r.key for r in keys.filter(F.xxhash64("key") >= F.lit(max(least, -(1 << 63)))).select("key").distinct().collect())
    bounds = sorted({sample[len(sample) * k // count] for k in range(1, count)}) if sample else []
    place = _place(bounds)
    ends = keys.withColumn("range", place("key")).groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    edges = sorted((r.range, r.first, r["last"]) for r in ends.collect())
    beside: dict[str, list[int]] = {}
    for (a, _, last), (b, first, _) in zip(edges, edges[1:], strict=False):
        beside.setdefault(last, []).append(b)
        beside.setdefault(first, []).append(a)
    return bounds, beside


def main_text(pages: DataFrame, pages_per_range: int = PAGES_PER_RANGE) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared, partner) of every page: partner is the
    page it was compared with, n_shared how many of its n_lines lines that one has too."""
    given = keyed(pages)
    bounds, beside = ranges(given.select("key"), pages_per_range)
    where: Column = _place(bounds, beside)("key")
    placed = (
        given.withColumn("ranges", where)
        .select("*", F.posexplode("ranges").alias("k", "range"))
        .select("page_id", "url", "host", "path", "html", "key", "range", (F.col("k") == 0).alias("own"))
    )
    dealt = placed.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "key", "html")
    schema = "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, n_shared bigint, partner bigint"
    return dealt.mapInArrow(_extract, schema)


def op13_nearest_url_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages"))
