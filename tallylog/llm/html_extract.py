"""Main text of web pages: page structure first, repeated runs of the host for what it leaves open.

1. A page is taken apart into blocks (paragraphs, headings, list items, ...). Scripts, styles,
   comments in the markup, menus, page headers and footers, sidebars, forms, notices, adverts and
   readers' comments are left out by their elements, roles or class and id words. A page that
   marks its main part (article, main, role=main, articleBody) gives the blocks within.
2. Every page has two token streams: the words of these blocks, and those of the blocks that were
   left out. Both streams of all pages of a host form its suffix array: all suffixes, sorted by
   their first `run` tokens taken as three characters of several tokens each. Neighbours whose
   characters all agree share `run` tokens or more; an interval of such neighbours from more than
   one page is a long repeated run, and so is an interval of blocks that are the same as a whole (a
   menu has few words), which are sorted with them. Where a page marks no main part, tokens that
   either covers are boilerplate and the unique runs stay; where it marks one, they are counted.
   Shorter runs inside a block are ordinary phrases, however many pages the host has.

The repeated runs must not decide inside a marked main part: passages and whole articles that
pages of a host share would go, although they are main text. And unique adverts would stay if
they alone decided. So structure has the first word.

The suffix array is never in one place. Spark sorts it by ranges, with the page in the order, so a
host with a third of all pages, or a menu on all of them, is spread over all tasks; each compares
the neighbours it holds, and the intervals at the edges of tasks are compared once more.

Null or empty html gives empty text. White space is what Unicode says. Null urls and urls without
a host form one host. Null and repeated ids: pages are told apart by id, url and html; equal rows
are one page for "more than one page" and each gives a row. Other columns are ignored. An empty
table gives an empty result. A page is parsed whole, in time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import cut, split_join, text_slices
from tallylog.llm.words import prefix_sums, split_words, stretches

#: Tokens that a run must have to count as repeated, unless it is a whole block.
RUN_TOKENS = 24

# Elements whose content is no text, elements that are page furniture, elements without an end.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title")
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
MAIN = {"article", "main"}
# Words of class, id and role: readers' comments, also around an article; other furniture.
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
FURNITURE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
TELLING = {"class", "id", "role", "itemprop", "hidden"}
#: First parts of names that tell an advert whatever follows: "ad-box".
ADVERT = {"ad", "ads", "advert", "adverts", "advertisement", "promo", "promoted", "sponsor", "sponsored"}
OPEN, INSIDE, HINTED, OUT = 0, 1, 2, 3


def _zone(tag: str, attrs: str, outer: int) -> int:
    """Zone of an element from its tag and attributes and the zone around it.

    Outside a marked main part any word of a class, id or role counts. Within one, ids are anchors
    of headings and sections and decide nothing, and a class or role counts as a whole name.
    """
    words: set[str] = set()
    names: set[str] = set()
    if attrs:
        for name, value in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name not in TELLING:
                continue
            if name == "hidden":
                return OUT
            words.update(re.split(r"[\s_\-]+", value))
            if name != "id":
                names.update(value.split())
            if name == "itemprop" and value == "articlebody":
                words.add("main")
    if outer == OUT or tag in FURNITURE:
        return OUT
    if outer == INSIDE:
        advert = any(re.split(r"[_\-]", name)[0] in ADVERT for name in names)
        return OUT if advert or names & COMMENT_WORDS or names & FURNITURE_WORDS else INSIDE
    if words & COMMENT_WORDS:
        return OUT
    if tag in MAIN or "main" in words and tag not in INLINE:
        return INSIDE  # furniture words around or on it name a page layout
    if tag not in ("html", "body") and words & FURNITURE_WORDS:
        return HINTED
    return outer


def all_blocks(html: str) -> list[tuple[int, str]]:
    """Zone and text of every block of a page, in page order."""
    blocks: list[tuple[int, str]] = []
    pending: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at = OPEN, 0

    def flush() -> None:
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            if text:
                blocks.append((zone, text))
            pending.clear()

    # places in the stack: of each tag, of all block elements, and of those that closing tags of
    # inline elements, paragraphs and list items do not reach out of
    places: dict[str, list[int]] = {}
    solid: list[int] = []
    walls: list[int] = []

    def close(index: int) -> None:
        nonlocal zone
        while len(stack) > index:
            places[stack.pop()[0]].pop()
        for held in (solid, walls):
            while held and held[-1] >= index:
                held.pop()
        zone = stack[-1][1] if stack else OPEN

    for token in TOKEN.finditer(html):
        if token.start() > at:
            pending.append(html[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if token["raw"]:
                pending.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            pending.append(" ")
            continue
        inline = tag in INLINE
        if token["end"]:
            if not inline:
                flush()
            i = places[tag][-1] if places.get(tag) else -1
            if i < 0 or (inline or tag in ("p", "li")) and walls and walls[-1] > i:
                continue
            if inline and stack[i][1] != (stack[i - 1][1] if i else OPEN):
                flush()
            close(i)
            continue
        if not inline:
            flush()
            # a block ends an open paragraph, a list item the one before it
            if solid and (stack[solid[-1]][0] == "p" or tag == "li" == stack[solid[-1]][0]):
                close(solid[-1])
        if tag in VOID or token["attrs"].endswith("/"):
            continue
        inner = _zone(tag, token["attrs"], zone)
        if inner != zone and inline:
            flush()
        places.setdefault(tag, []).append(len(stack))
        if not inline:
            solid.append(len(stack))
            if tag != "p":
                walls.append(len(stack))
        stack.append((tag, inner))
        zone = inner
    pending.append(html[at:])
    flush()
    return blocks


def split_blocks(html: str) -> tuple[list[str], list[str], bool]:
    """The main blocks of a page, those left out, and whether the main ones come from a marked part."""
    blocks = all_blocks(html)
    marked = any(z == INSIDE for z, _ in blocks)
    within = (INSIDE,) if marked else (OPEN,)
    return [text for z, text in blocks if z in within], [text for z, text in blocks if z not in within], marked


def page_blocks(html: str) -> tuple[list[str], bool]:
    """The main blocks of a page in page order, and whether they come from a marked main part."""
    main, _, marked = split_blocks(html)
    return main, marked


def _blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, blocks, rest (blocks left out) and marked of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [split_blocks(html.as_py()) for html in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([b for b, _, _ in found], pa.list_(pa.string())),
                        pa.array([r for _, r, _ in found], pa.list_(pa.string())),
                        pa.array([m for _, _, m in found], pa.bool_()),
                    ],
                    ["page_id", "url", "blocks", "rest", "marked"],
                )

    return pages.mapInArrow(run, "page_id long, url string, blocks array<string>, rest array<string>, marked boolean")


def host_of(url: Column) -> Column:
    """The host in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


#: What orders suffixes: host, and the characters of the first `run` tokens or of a whole block.
SUFFIX = ["host", "length", "c0", "c1", "c2"]


def suffix_array(pages: DataFrame, run: int = RUN_TOKENS) -> DataFrame:
    """Suffixes of the token streams of (host, page, blocks), and whole blocks, in order over the
    partitions: `SUFFIX`, page, place. `length` is `run`, or the tokens of a block. `host` is a string
    or a long. Streams with a true `left_out`, if there is this column, have places below 0.

    A suffix shorter than `run` begins no long run and is left out.
    """
    cuts = [run * i // 3 for i in range(4)]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                listed = batch.column(2).to_pylist()
                texts = pa.array([" ".join(x) for x in listed], pa.string())
                block_row = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
                block_size = np.array([len(b.encode().split()) for x in listed for b in x], np.int64)
                for low, high, data, offsets in text_slices(texts):
                    words = split_words(data, offsets)
                    sums = prefix_sums(words.hashes)
                    first = words.windows(run)[0]
                    # whole blocks, one after the other, from the page's first token on
                    own = (block_row >= low) & (block_row < high) & (block_size > 0)
                    size = block_size[own]
                    at = np.cumsum(size) - size
                    none = np.zeros(len(at), np.uint64)
                    of_block = [stretches(sums, at, at + size, seed=3), none, none]
                    of_run = [stretches(sums, first + a, first + b) for a, b in zip(cuts, cuts[1:])]
                    length = np.concatenate([np.full(len(first), run), size]).astype(np.int64)
                    first = np.concatenate([first, at])
                    row = low + np.searchsorted(words.word_at, first, "right") - 1
                    characters = [pa.array(np.concatenate(c).view(np.int64)) for c in zip(of_run, of_block)]
                    place = first - words.word_at[row - low]
                    left_out = batch.column(3).to_numpy(zero_copy_only=False)[row]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row)),
                            pa.array(length),
                            *characters,
                            batch.column(1).take(pa.array(row)),
                            pa.array(np.where(left_out, -1 - place, place)),
                        ],
                        [*SUFFIX, "page", "place"],
                    )

    left_out = F.col("left_out") if "left_out" in pages.columns else F.lit(False).alias("left_out")
    shape = f"host {dict(pages.dtypes)['host']}, length long, c0 long, c1 long, c2 long, page long, place long"
    found = pages.select("host", "page", "blocks", left_out).mapInArrow(suffixes, shape)
    # the salt spreads pages that are the same row many times
    order = [*SUFFIX, "page", "place", "_salt"]
    salt = (128 * F.rand(3)).cast("tinyint")  # few bits: it is shuffled with every row
    return found.withColumn("_salt", salt).repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")


def repeated_runs(array: DataFrame) -> DataFrame:
    """(page, place, length) of the suffixes whose interval holds more than one page. The sorted
    suffixes are read once; of the first and the last interval of each partition, which may go on
    in the next one, what is needed to compare them is kept."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None  # of the interval that may go on, its least and greatest page
        least, greatest, at_first = 0, 0, True
        held: list[pa.RecordBatch] = []  # its rows, while they are of one page

        def made(rows: pa.RecordBatch, edge: pa.Array | None = None) -> pa.RecordBatch:
            edge = pa.nulls(rows.num_rows, edge_type) if edge is None else edge
            return pa.RecordBatch.from_arrays([*rows.columns, edge], ["page", "place", "length", "edge"])

        def at_edge(key: tuple, least: int, greatest: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["page", "place", "length"]
            known = pa.RecordBatch.from_pydict({"page": [least, greatest], "place": [0, 0], "length": [key[1]] * 2}, pa.schema([(n, pa.int64()) for n in names]))
            for rows, open_ in ((known, False),) if least != greatest else ((r, True) for r in held):
                edge = {"host": key[0], "c0": key[2], "c1": key[3], "c2": key[4], "open": open_}
                yield made(rows, pa.array([edge], edge_type).take(pa.array(np.zeros(rows.num_rows, np.int64))))

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(0).dictionary_encode().indices, *batch.columns[1:5]]
            columns = [c.to_numpy(zero_copy_only=False) for c in codes]
            page = batch.column(5).to_numpy()
            new = np.ones(len(page), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(page)) - 1
            low = page[first].copy()
            keys = lambda i: tuple(c[i].as_py() for c in batch.columns[:5])  # noqa: B023, E731
            rows = batch.select(["page", "place", "length"])
            if key is not None and key != keys(0):
                if at_first:
                    yield from at_edge(key, least, greatest, held)
                at_first, held = False, []
            elif key is not None:
                low[0] = least
            several = low != page[last]  # pages ascend within an interval
            if several[0]:
                yield from map(made, held)
                held = []
            else:
                held.append(rows.slice(0, int(last[0]) + 1))
            yield made(rows.filter(pa.array(np.repeat(several, last - first + 1))))
            if len(first) > 1:
                if at_first:
                    yield from at_edge(keys(0), int(low[0]), int(page[last[0]]), held)
                at_first, held = False, [] if several[-1] else [rows.slice(int(first[-1]))]
            key, least, greatest = keys(len(page) - 1), int(low[-1]), int(page[-1])
        if key is not None:
            yield from at_edge(key, least, greatest, held)

    host = dict(array.dtypes)["host"]
    edge_type = pa.struct([("host", pa.int64() if host == "bigint" else pa.string()), *[(c, pa.int64()) for c in ("c0", "c1", "c2")], ("open", pa.bool_())])
    shape = f"page long, place long, length long, edge struct<host: {host}, c0: long, c1: long, c2: long, open: boolean>"
    found = cut(array.select(*SUFFIX, "page", "place").mapInArrow(inside, shape))
    edges = found.where("edge is not null").select("edge.*", "length", "page", "place")
    over = edges.groupBy(*SUFFIX).agg(F.min("page").alias("_low"), F.max("page").alias("_high")).where("_low != _high")
    more = edges.where("open").join(over.select(SUFFIX), SUFFIX, "left_semi")
    return found.where("edge is null").select("page", "place", "length").unionByName(more.select("page", "place", "length"))


def unique_runs(pages: DataFrame, run: int = RUN_TOKENS) -> DataFrame:
    """(page_id, url, text, n_repeated) of pages given with blocks, rest and marked. n_repeated: the
    tokens of the blocks that repeat on another page of the host, in whole blocks or in runs of
    `run` or more tokens; the text is without them unless the page marks its main part."""
    joined = F.array_join("blocks", " ")
    pages = pages.select(
        "page_id", "url", F.xxhash64(host_of(F.col("url"))).alias("host"), "blocks", "rest", "marked",
        F.xxhash64("page_id", "url", joined).alias("page"),
    )
    streams = pages.select("host", "page", F.inline(F.array(
        F.struct("blocks", F.lit(False).alias("left_out")),
        F.struct(F.col("rest").alias("blocks"), F.lit(True).alias("left_out")),
    )))
    # places of a page: no more than twice its tokens
    places = repeated_runs(suffix_array(streams, run)).where("place >= 0")
    covered = places.groupBy("page").agg(F.collect_set(F.struct("place", "length")).alias("places"))

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for blocks, marked, places in zip(*(c.to_pylist() for c in batch.columns[2:])):
                tokens = " ".join(blocks).encode().split()
                edge = np.zeros(len(tokens) + 1, np.int64)
                for p in places or ():
                    edge[p["place"]] += 1
                    edge[p["place"] + p["length"]] -= 1
                keep = np.cumsum(edge[:-1]) == 0
                counts.append(int(len(keep) - keep.sum()))
                texts.append(" ".join(blocks) if marked else b" ".join(t for t, k in zip(tokens, keep) if k).decode())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_repeated"])

    whole = split_join(pages.select("page", "page_id", "url", "blocks", "marked"), covered, ["page"], "left")
    return whole.select("page_id", "url", "blocks", "marked", "places").mapInArrow(shortened, "page_id long, url string, text string, n_repeated long")


def extract_text(pages: DataFrame, run: int = RUN_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_repeated (see `unique_runs`) of every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    # held, as the suffix array samples its streams before it sorts them
    found = unique_runs(cut(_blocks(rows)), run)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
