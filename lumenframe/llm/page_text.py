"""Operator 9: main text of web pages by nearest-URL page differencing.

A page is parsed once and becomes a list of text lines, one per block, each with
its region: *article* (inside ``article`` or ``main``), *furniture* (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, by element
or by class, id or role), or *open*.  End tags that may be left out are implied
as browsers do: a paragraph ends where a block begins, an item, row or cell
where the next one begins, and an end tag closes nothing outside the table cell
that it stands in, one of an inline element nothing outside its block.  A name
marks furniture if all its words say so ("related-posts", but neither
"related-work" nor "share-price").  Pages are ordered by host, then path; each is
paired with the neighbour of the same host whose path shares the longer start.
The two pages' lines, all of them, are aligned by their longest common
subsequence, and lines that they share are deleted, as templates repeat and
texts don't.  A neighbour with which a page shares 0.8 of the words in their
lines that aren't furniture is a copy, and passed over: what two copies have in
common is no template.

Every page goes through this.  An exact check by the regions follows, as articles
hold lines that others hold too, and menus change from page to page: article
lines that were deleted come back, furniture that was left goes, and so do the
open lines of a page with an article.  ``n_shared`` and ``n_restored`` tell what
differencing deleted of a page and what of that the check brought back.

The order is global, so pairs depend on neither partitions nor hot hosts: rows
get dense numbers from range-sorted partitions, and runs of CHUNK numbers, with
the row before and the row after, are compared by line hashes only.

Null html or pages without text give an empty string; null urls form a host of
their own; pages of equal url are neighbours in the order of page_id; a page
that repeats in all columns gets the same text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._text import slices, small_batches
from lumenframe.llm.url_filter import host_of, path_of
from lumenframe.operators.numbering import numbered
from lumenframe.storage import cut_lineage

ARTICLE, FURNITURE, OPEN = 0, 1, 2
COPY_PERCENT = 80
CHUNK = 1024
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_BROKEN = re.compile(r"</?[a-zA-Z!?][^<>]*\Z")
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template textarea title iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav header footer aside form menu dialog button select".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an end tag, or the end of a paragraph, doesn't reach beyond.
_SCOPE = frozenset("html table td th caption template".split())
_PARAGRAPH_SCOPE = _SCOPE | {"button"}
#: Blocks that begin inside a paragraph without ending it.
_INSIDE_P = frozenset("caption tbody td tfoot th thead tr legend optgroup option select body head html".split())
#: Of a start tag: the open elements that it ends, and those beyond which it doesn't look for them.
_ITEM = _BLOCK - {"p", "div", "address"}
_ENDS = {
    "li": ({"li"}, _ITEM - {"li"}),
    "dt": ({"dt", "dd"}, _ITEM - {"dt", "dd"}),
    "dd": ({"dt", "dd"}, _ITEM - {"dt", "dd"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    **{x: ({"tbody", "thead", "tfoot", "caption"}, {"table"}) for x in ("tbody", "thead", "tfoot")},
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Words of class, id and role that mark furniture.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply search share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words beside them that say where or what a piece of the page is, not what it is about.
_PLACES = frozenset(
    "active area article articles bar block body bottom box btn button buttons card center column container content desktop fixed form global group header heading icon icons inner item items label large left link links list main mobile modal open outer page panel popup post posts primary region right rounded row secondary section signup site slot small sticky strip text title toggle top unit wide wrap wrapper".split()
)
#: Elements whose names say more than their class, and marks that say nothing inside an article, where a header is its own.
_WHOLE = frozenset("html body".split())
_OWN = frozenset("header masthead banner".split())
#: All that tells an article, or a main element, to be furniture.
_OF_ARTICLES = frozenset("ad ads advert advertisement comment comments promo related replies reply sponsored".split())
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(attributes: str, marks: frozenset[str]) -> bool:
    """Whether a class, id or role is a mark, alone or beside words of place only."""
    for found in _NAMED.findall(attributes):
        for name in "".join(found).split():
            words = set(filter(None, re.split(r"[^a-z]+", _HUMP.sub("-", name).lower())))
            if not words.isdisjoint(marks) and words <= marks | _PLACES:
                return True
    return False


class _Page:
    """Open elements and lines of a page while it is read."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.beside: list[str] = []  # of inline furniture, such as a button
        self.stack: list[tuple[str, bool, bool]] = []
        self.furniture = self.article = 0

    def add(self, text: str) -> None:
        (self.beside if self.furniture else self.text).append(text)

    def flush(self) -> None:
        for text, region in ((self.text, ARTICLE if self.article else OPEN), (self.beside, FURNITURE)):
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                self.lines.append((joined, region))

    def end(self, names, beyond) -> None:
        """Close the innermost open element of ``names`` and all inside it, unless one of ``beyond`` stands between."""
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag in names:
                for _, furniture, article in self.stack[k:]:
                    self.furniture -= furniture
                    self.article -= article
                del self.stack[k:]
                return
            if tag in beyond:
                return

    def close(self, tag: str) -> None:
        if tag in _HEADINGS:
            self.end(_HEADINGS, _SCOPE)
        elif tag in _SCOPE:
            self.end({tag}, {"table"} - {tag})
        else:
            self.end({tag}, _SCOPE if tag in _BLOCK else _BLOCK)

    def open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK and tag not in _INSIDE_P:
            self.end({"p"}, _PARAGRAPH_SCOPE)
        if tag in _ENDS:
            self.end(*_ENDS[tag])
        if tag in _VOID:
            return
        region = tag in ("article", "main")
        marks = frozenset() if tag in _WHOLE else _OF_ARTICLES if region else _MARKS - _OWN if self.article else _MARKS
        furniture = (tag in _SKIP and not (tag == "header" and self.article > 0)) or _marked(attributes, marks)
        self.stack.append((tag, furniture, region))
        self.furniture += furniture
        self.article += region


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(text, region) of each block with text, in page order."""
    if not html:
        return []
    cut = _BROKEN.search(html)
    if cut:
        html = html[: cut.start()]
    page = _Page()
    at, size, raw_until = 0, len(html), None
    while at < size:
        if raw_until:
            end = re.compile(rf"</{raw_until}\s*>", re.I).search(html, at)
            at, raw_until = (end.end() if end else size), None
            continue
        found = _TOKEN.search(html, at)
        if not found:
            page.add(html[at:])
            break
        page.add(html[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag == "br":
            page.add(" ")
            continue
        if tag in _BLOCK:
            page.flush()
        if closing:
            page.close(tag)
        elif tag in _RAW:
            raw_until = None if found[3].endswith("/") else tag
        elif not (found[3].endswith("/") and tag not in _BLOCK):
            page.open(tag, found[3])
    page.flush()
    return page.lines


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, key in enumerate(a):
        for j in where.get(key, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


_PLACED = "page_id long, url string, digest long, host string, path string"
_LINES = f"{_PLACED}, texts array<string>, places array<int>, article boolean, keys array<long>, words array<int>"


def _line_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: the texts that the check can leave, of its article or else open, with their places; key of every line, and its words, none of furniture."""
    for batch in slices(batches, "html"):
        texts, places, article, keys, words = [], [], [], [], []
        for html in batch.column("html").to_pylist():
            lines = page_lines(html)
            article.append(any(r == ARTICLE for _, r in lines))
            own = [i for i, (_, r) in enumerate(lines) if r == (ARTICLE if article[-1] else OPEN)]
            texts.append([lines[i][0] for i in own])
            places.append(own)
            keys.append([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in lines])
            words.append([0 if r == FURNITURE else len(t.split()) for t, r in lines])
        columns = [batch.column(c) for c in ("page_id", "url", "digest", "host", "path")]
        made = [pa.array(x, t) for x, t in ((texts, pa.list_(pa.string())), (places, pa.list_(pa.int32())), (article, pa.bool_()), (keys, pa.list_(pa.int64())), (words, pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays([*columns, *made], names=["page_id", "url", "digest", "host", "path", "texts", "places", "article", "keys", "words"])


def _start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shared_with(keys: list[int], words: list[int], others: list[tuple[list[int], list[int]]]) -> list[int]:
    """Places of lines that are shared with the first of ``others`` (keys, words) that isn't a copy."""
    size = sum(words)
    for other, other_words in others:
        lost = shared_lines(keys, other)
        shared = sum(words[i] for i in lost)
        if not shared or 100 * shared < COPY_PERCENT * (size + max(sum(other_words), shared) - shared):
            return lost
    return []


def _pair_pass(size: int):
    """Of each page of a chunk: the places of lines that it shares with its neighbour. Rows of other chunks are neighbours only."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = rows.sort_by("no").to_pylist()
        page, digest, gone = [], [], []
        for k, r in enumerate(found):
            if r["no"] // size != key[0].as_py():
                continue
            near = [x for x in (*found[max(0, k - 1) : k], *found[k + 1 : k + 2]) if x["host"] == r["host"]]
            near.sort(key=lambda x: -_start(x["path"], r["path"]))
            lost = shared_with(r["keys"], r["words"], [(x["keys"], x["words"]) for x in near])
            if lost:
                page.append(r["page_id"]), digest.append(r["digest"]), gone.append(lost)
        return pa.table({"page_id": pa.array(page, pa.int64()), "digest": pa.array(digest, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32()))})

    return run


def deleted_lines(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """``page_id, digest, gone``: places of the lines that a page shares with its neighbour, where there are any."""
    keyed = lines.select("page_id", "digest", "host", "path", "keys", "words")
    placed = numbered(keyed, "host", "path", "page_id", "digest", name="no")
    chunk = lambda step: F.floor((F.col("no") + step) / size).cast("long")
    runs = placed.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(-1), chunk(0), chunk(1)))))
    gone = runs.groupBy("chunk").applyInArrow(_pair_pass(size), "page_id long, digest long, gone array<int>").dropDuplicates(["page_id", "digest"])
    return cut_lineage(gone, "page-deletions")


def main_text(pages: DataFrame, max_broadcast: int = 1 << 22) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, n_restored`` of each row. Up to ``max_broadcast`` places of deleted lines (4 bytes, and 16 a page) are sent to all executors."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    small_batches(pages)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.xxhash64(url, html).alias("digest"), host_of(url).alias("host"), path_of(url).alias("path"))
    lines = cut_lineage(own.mapInArrow(_line_pass, _LINES), "page-lines")
    gone = deleted_lines(lines)
    size = gone.agg(F.coalesce(F.sum(F.size("gone") + 4), F.lit(0))).first()[0]
    gone = gone.withColumnRenamed("page_id", "gone_id").withColumnRenamed("digest", "gone_digest")
    few = F.broadcast(gone) if size <= max_broadcast else gone
    joined = lines.select("page_id", "url", "digest", "texts", "places", "article").join(few, F.expr("page_id <=> gone_id and digest = gone_digest"), "left")
    left = F.when(F.col("gone").isNull() | F.col("article"), F.col("texts")).otherwise(F.filter("texts", lambda t, i: ~F.array_contains("gone", F.get("places", i))))
    shared = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    restored = F.when(F.col("gone").isNotNull() & F.col("article"), F.size(F.array_intersect("places", "gone"))).otherwise(0).cast("long")
    texts = joined.select("page_id", "url", F.array_join(left, "\n").alias("text"), shared.alias("n_shared"), restored.alias("n_restored"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_restored")
