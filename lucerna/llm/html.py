"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in URL-path order and each is paired with the neighbour
that shares the longer path prefix.  The text lines (blocks) of the pair are
aligned by longest common subsequence, and shared lines are deleted: they belong
to the template, not to the page.  An exact check on the markup follows.  It
keeps a shared line that stands in the page's article (two articles may share a
sentence), and deletes lines in menus, headers, footers, sidebars, adverts,
forms, notices and comments that happen to differ from the neighbour's.

A host, or one path with many query strings, may hold a third of all pages, so
pages are not grouped by either: sampled splitters cut the (host, path, page id)
order into buckets, and each bucket also receives the lines of the last page
before it and the first page after it, so every pair is found whatever the cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Element and class names by the part they play in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ZONES = frozenset("head nav footer aside form menu dialog button select label title search".split())
MAIN = frozenset("article main".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer disqus footer masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar widget widgets".split())
OUTSIDE_WORDS = frozenset("header top topbar".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTAINERS = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form head header li main menu "
    "nav ol search section select table td title tr ul button label span p".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NEUTRAL, SIDE, OWN = 0, 1, 2


def _zone(tag: str, attributes: str, in_main: bool) -> int:
    """What opening this element makes of the text inside: NEUTRAL says as before."""
    if tag in ZONES or tag == "header" and not in_main:
        return SIDE
    if attributes and not attributes.isspace():
        got = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
        if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
            return SIDE
        words = set(re.split(r"[^a-z]+", got.get("class", "") + " " + got.get("id", "")))
        if tag not in ("body", "html") and (words & SIDE_WORDS or got.get("role") in SIDE_ROLES
                                            or not in_main and tag not in MAIN and words & OUTSIDE_WORDS):
            return SIDE
        if got.get("role") in ("main", "article"):
            return OWN
    return OWN if tag in MAIN else NEUTRAL


def page_lines(html: str) -> list[tuple[str, int]]:
    """(text, part) of each non-empty block in page order; part NEUTRAL, SIDE or OWN."""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    stack: list[tuple[str, int]] = []
    part, at, n = NEUTRAL, 0, len(html)

    def flush() -> None:
        if words:
            line = " ".join(unescape("".join(words)).split())
            if line:
                out.append((line, part))
            words.clear()

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            words.append(html[at:])
            break
        if lt > at:
            words.append(html[at:lt])
        nxt = html[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = TAG.match(html, lt)
        if not m:
            if not (nxt.isalpha() or nxt == "/"):
                words.append("<")
                at = lt + 1
                continue
            end = html.find(">", lt)  # an unclosed quote: the tag ends at the next >
            if end < 0:
                break
            closing, tag, attributes, at = nxt == "/", "".join(re.findall(r"^</?([a-zA-Z]\w*)", html[lt:lt + 40])), "", end + 1
        else:
            closing, tag, attributes, at = bool(m[1]), m[2], m[3], m.end()
        tag = tag.lower()
        if tag in RAW and not closing:
            if attributes.endswith("/"):
                continue
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
            close = html.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag not in CONTAINERS or tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][1] != part:
                        flush()
                    part = stack[k][1]
                    del stack[k:]
                    break
            continue
        if tag in ("p", "li", "td", "tr") and stack and stack[-1][0] == tag:
            part = stack.pop()[1]  # these elements close an open one of their kind
        zone = _zone(tag, attributes, part == OWN or any(p == OWN for _, p in stack))
        if zone == SIDE or part == SIDE:
            new = SIDE
        else:
            new = OWN if OWN in (zone, part) else NEUTRAL
        if new != part:
            flush()
        stack.append((tag, part))
        part = new
    flush()
    return out


def line_hashes(lines: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in lines]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` that a longest common subsequence aligns with ``b`` (bit-parallel)."""
    if not a or not b:
        return []
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, [full]
    for y in b:
        u = row & places.get(y, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:  # a zero bit i of row j: the i-th line adds one to the common length
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def main_text(lines: list[tuple[str, int]], neighbour: list[int] | None) -> tuple[str, int]:
    """Main text and number of lines the differencing deleted.

    If the neighbour holds every line (a copy of the page), the pair tells nothing
    about the template, and only the markup decides.
    """
    shared: set[int] = set()
    if neighbour is not None:
        shared = set(shared_lines(line_hashes(lines), neighbour))
        if len(shared) == len(lines):
            shared = set()
    has_main = any(p == OWN for _, p in lines)
    kept, gone = [], 0
    for i, (text, part) in enumerate(lines):
        if i in shared and part != OWN:
            gone += 1
        elif part != SIDE and (part == OWN or not has_main):
            kept.append(text)
    return "\n\n".join(kept), gone


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path without scheme, host, query, fragment, a file ending or a last slash."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*|[?#].*$", "")
    return F.regexp_replace(bare, r"(\.x?html?|\.php|/)+$", "")


def _edge_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [line_hashes(page_lines(h or "")) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("bucket", "last", "host", "path")), pa.array(hashes, pa.list_(pa.int64()))],
            ["bucket", "last", "host", "path", "lines"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (bucket, side, host, path) order; ghosts (side 0 and 2) only serve as neighbours."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in
                           ("bucket", "side", "host", "path", "lines", "page_id", "url", "html")), strict=True):
                lines = None if r[1] != 1 else page_lines(r[7] or "")
                yield r[0], r[2], r[3], r[4] if lines is None else line_hashes(lines), r[5], r[6], lines
        yield (None,) * 7

    out: list[tuple] = []
    size = 0
    before = now = None
    for after in rows():
        if now is not None and now[6] is not None:
            best, longest = None, -1
            for other in (before, after):
                if other is not None and other[:2] == now[:2] and other[3] != now[3]:
                    n = _prefix(other[2], now[2])
                    if n > longest:
                        best, longest = other[3], n
            text, gone = main_text(now[6], best)
            out.append((now[4], now[5], text, gone))
            size += len(text)
            if size > 4 << 20 or len(out) >= 2000:
                yield _out(out)
                out, size = [], 0
        before, now = now, after
    if out:
        yield _out(out)


def _out(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = (list(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string()),
                                       pa.array(d, pa.int64())], ["page_id", "url", "text", "n_shared"])


def _splitters(keys: DataFrame, pages_per_bucket: int) -> list[str]:
    """Bucket borders of the order of places from a hash sample of some five per border.

    The number of buckets grows with the pages, so that none holds much more than ``pages_per_bucket``.
    """
    total = keys.count()
    buckets = max(1, total // pages_per_bucket)
    if buckets == 1:
        return []
    every = max(1, total // (5 * buckets))
    sample = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).select("place").collect())
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)} if sample else set())


def extract(pages: DataFrame, pages_per_bucket: int = 500) -> DataFrame:
    """``(page_id, url, text, n_shared)`` per row of ``pages(page_id, url, html)``.

    The text is the page's main text: character references decoded, white space in
    a block one blank, blocks joined by a blank line.  ``n_shared`` counts the
    lines that differencing deleted.  A null html is empty and has the empty text;
    a null url counts as the empty one (such pages are neighbours of each other);
    pages equal line by line are no neighbours; rows are returned as often as they
    come, other columns are ignored, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                         host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # page ids as fixed-width text that sorts like the numbers, null first
    tie = F.coalesce(F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))
    keyed = keyed.withColumn("place", F.concat_ws("\x01", "host", "path", tie))
    borders = _splitters(keyed.select("place"), pages_per_bucket)
    shared = spark.sparkContext.broadcast(borders)

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bisect_right(shared.value, p) for p in batch.column("place").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.int32())],
                                             [*batch.schema.names[:-1], "bucket"])

    dealt = keyed.mapInArrow(bucket_of, "page_id long, url string, html string, host string, path string, bucket int")
    order = F.struct("host", "path", F.coalesce("page_id", F.lit(-(1 << 63))).alias("tie"), "html")
    edges = dealt.groupBy("bucket").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    ends = edges.select("bucket", F.explode(F.array(
        F.struct(F.lit(False).alias("last"), F.col("first").alias("p")),
        F.struct(F.lit(True).alias("last"), F.col("last").alias("p")))).alias("e"))
    ends = (ends.select("bucket", "e.last", "e.p.host", "e.p.path", "e.p.html")
            .mapInArrow(_edge_lines, "bucket int, last boolean, host string, path string, lines array<long>"))
    # two rows a bucket: the neighbouring non-empty bucket of each by one small ordered pass
    w = Window.orderBy("bucket")
    ghosts = (ends.where("last").select(F.lead("bucket").over(w).alias("bucket"), F.lit(0).alias("side"), "host", "path", "lines")
              .unionByName(ends.where("not last").select(F.lag("bucket").over(w).alias("bucket"), F.lit(2).alias("side"),
                                                         "host", "path", "lines"))
              .where("bucket is not null"))
    rows = dealt.withColumns({"side": F.lit(1), "lines": F.lit(None).cast("array<long>")}).unionByName(
        ghosts.withColumns({"page_id": F.lit(None).cast("long"), "url": F.lit(None).cast("string"),
                            "html": F.lit(None).cast("string")}))
    return (rows.repartition(len(borders) + 1, "bucket").sortWithinPartitions("bucket", "side", "host", "path", "page_id", "html")
            .select("bucket", "side", "host", "path", "lines", "page_id", "url", "html")
            .mapInArrow(_difference, "page_id long, url string, text string, n_shared long"))
