"""Main text of pages, by structure and a suffix array of each host's pages.

A page is parsed into blocks of text, each in one of three zones: main (inside article or main), chrome (menus, headers,
footers, sidebars, notices, adverts, forms, comments) and plain. Pages with a main zone keep its blocks; what lies outside it
counts as chrome. Pages without one keep their plain blocks. Chrome goes.

Token streams of a host's pages are concatenated, with an end after each block, and their suffixes sorted. Neighbours that
agree in SPAN tokens or more, or in a whole block, are long substrings. Each task sorts the suffixes of its pages; one row for each
distinct substring of SPAN tokens (any longer repeat is covered by such ones, so no other length is needed) then goes to
where its host's rows are merged by hash, and those of two distinct pages or more are left. So no task
holds a host, and the texts are the same however the pages are dealt. Pages of equal articles count as one page throughout.

A page without a main zone loses the runs that stand on another page of its host: its unique runs are kept (all, if there
are none). A block of a main zone goes only if it stands as chrome on two pages or more and in the main zones of two distinct
articles or more: a notice that some pages set into the article. Paragraphs that articles share stay, as do copies of a page.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; null ids and repeated rows are
extracted row by row; an empty table gives no rows; further columns are ignored. A task holds an Arrow batch of pages; a very
long page is parsed in one pass.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_schema, ddl, sliced, small_batches, stored, texts

#: Tokens of the shortest substring that counts, as a power of two.
SPAN = 8

# Element names and words of class, id and role.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = set("script style noscript template svg math head title iframe object select textarea button canvas audio video".split())
CHROME = set("nav footer aside form menu dialog".split())
CONTAINERS = set("article aside body center details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
CHROME_WORDS = set("ad ads adv advert advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split())
MAIN_WORDS = set("article main content maincontent entry post story".split())

PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


def zone_of(name: str, rest: str, inside: str) -> str:
    """Zone that an element opens: its own, or that around it."""
    if inside == "chrome" or name in CHROME:
        return "chrome"
    if name == "header":
        return inside if inside == "main" else "chrome"
    if rest:
        found = set()
        for m in NAMED.finditer(rest):
            found.update(WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
        if found & CHROME_WORDS:
            return "chrome"
        if name in ("div", "section") and found & MAIN_WORDS and "main" in found | {inside}:
            return "main"
    return "main" if name in ("article", "main") else inside


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block in page order; references decoded, white space made single blanks, blanks trimmed."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    zone, silent, at = "plain", "", 0

    def close() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((zone, text))
            parts.clear()

    while at < len(page):
        if silent:  # up to the element's end
            end = re.compile(rf"</{silent}\s*>", re.I).search(page, at)
            at, silent = (end.end() if end else len(page)), ""
            continue
        m = PARTS.match(page, at)
        if m is None:  # a quote that never ends
            parts.append(page[at])
            at += 1
            continue
        at = m.end()
        if m["text"] is not None:
            parts.append(m["text"])
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in SILENT:
            if not m["end"] and not (m["rest"] or "").endswith("/"):
                silent = name
            continue
        if name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            if not m["end"] and m["rest"] and zone_of(name, m["rest"], zone) == "chrome" != zone and name in ("span", "a"):
                silent = name
            continue
        close()
        if name in CONTAINERS:
            if not m["end"]:
                stack.append((name, zone))
                zone = zone_of(name, m["rest"], zone)
            elif any(n == name for n, _ in stack):
                while stack:
                    n, zone = stack.pop()
                    if n == name:
                        break
        elif not m["end"] and m["rest"] and zone != "chrome" and zone_of(name, m["rest"], zone) == "chrome":
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else at
    close()
    return out


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Rank of each suffix by its first SPAN tokens (equal ranks agree in all of them), by prefix doubling."""
    rank, length = tokens.astype(np.int64), 1
    while length < SPAN:
        after = np.concatenate([rank[length:], np.full(min(length, len(rank)), -1)])[: len(rank)]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        fresh = np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]).cumsum()
        rank = np.empty_like(rank)
        rank[order] = fresh
        length *= 2
    return rank


def page_hash(blocks_: list[str]) -> int:
    """Identity of a page's article: a hash of its blocks; 0 if there are none."""
    return int.from_bytes(hashlib.blake2b("\n".join(blocks_).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if blocks_ else 0


def split_page(html: str) -> tuple[bool, list[str], list[str]]:
    """Whether a page has a main zone, its blocks to keep, and all others."""
    found = blocks(html)
    zone = "main" if any(z == "main" for z, _ in found) else "plain"
    return zone == "main", [t for z, t in found if z == zone], [t for z, t in found if z != zone]


class Hashes:
    """64-bit hashes of runs of tokens; remembers those of the tokens."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def tokens(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.array([self.known[w] for w in words], np.uint64)

    def windows(self, words: list[str]) -> np.ndarray:
        """Of each SPAN tokens in a row."""
        n = len(words) - SPAN + 1
        if n < 1:
            return np.empty(0, np.int64)
        token, out = self.tokens(words), np.zeros(n, np.uint64)
        for s in range(SPAN):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + token[s : s + n]
        return (out ^ (out >> np.uint64(32))).view(np.int64)


def block_hash(block: str) -> int:
    """Of a block as a whole, another than that of any run of tokens."""
    return int.from_bytes(hashlib.blake2b(block.encode("utf-8", "surrogatepass"), digest_size=8, person=b"block").digest(), "little", signed=True)


PARSED = arrow_schema(page_id="long", url="string", host="long", article="long", zoned="boolean", kept="string", other="string")
PIECES = arrow_schema(host="long", hash="long", kind="int", lo="long", hi="long")
ASKED = arrow_schema(row="long", host="long", hash="long")
EXTRACTED = arrow_schema(page_id="long", url="string", text="string", n_chars="long")
#: Kinds of substrings: SPAN tokens in chrome and on a page without a main zone, and whole blocks in chrome and in a main zone.
CHROME_RUN, PLAIN_RUN, CHROME_BLOCK, MAIN_BLOCK = range(4)


def lines(text: str) -> list[str]:
    """Blocks, stored as lines; a block has no line feed of its own."""
    return text.split("\n") if text else []


def rows_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = [split_page(x) for x in texts(batch.column(3))]
        yield rows_of(PARSED, [*batch.columns[:3], [page_hash(k) for _, k, _ in split], [z for z, _, _ in split], ["\n".join(k) for _, k, _ in split], ["\n".join(o) for _, _, o in split]])


def distinct_runs(streams: list[tuple[int, list[list[str]]]], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct run of SPAN tokens in the streams (article, blocks), and the least and greatest of its articles."""
    seen: dict[str, int] = {}
    tokens: list[int] = []
    owner, starts, found = [], [], []
    for article, blocks_ in streams:
        for words in blocks_:
            if len(words) < SPAN:
                continue
            starts.append(np.arange(len(tokens), len(tokens) + len(words) - SPAN + 1))
            found.append(hashes.windows(words))
            owner.append(np.full(len(found[-1]), article, np.int64))
            tokens += [seen.setdefault(w, len(seen)) for w in words]
    if not starts:
        return (np.empty(0, np.int64),) * 3
    at, h, o = np.concatenate(starts), np.concatenate(found), np.concatenate(owner)
    rank = suffix_order(np.array(tokens, np.int64))[at]
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    return h[order][first], np.minimum.reduceat(o[order], first), np.maximum.reduceat(o[order], first)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each host, kind and distinct substring of a batch, by a suffix array for each host."""
    hashes = Hashes()
    for batch in batches:
        hosts: dict[int, list[list[tuple]]] = {}
        for host, article, zoned, kept, other in zip(*(batch.column(c).to_pylist() for c in ("host", "article", "zoned", "kept", "other")), strict=True):
            of = hosts.setdefault(host, [[], [], [], []])
            of[CHROME_RUN].append((article, [x.split() for x in lines(other)]))
            of[CHROME_BLOCK] += [(block_hash(x), article) for x in lines(other)]
            if zoned:
                of[MAIN_BLOCK] += [(block_hash(x), article) for x in lines(kept)]
            else:
                of[PLAIN_RUN].append((article, [x.split() for x in lines(kept)]))
        out: list[list] = [[], [], [], [], []]
        for host, of in hosts.items():
            for kind in range(4):
                if kind in (CHROME_RUN, PLAIN_RUN):
                    h, lo, hi = distinct_runs(of[kind], hashes)
                else:
                    both = np.array(sorted(of[kind]), np.int64).reshape(-1, 2)
                    first = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0]])) if len(both) else np.empty(0, np.int64)
                    h, lo, hi = (both[first, 0], np.minimum.reduceat(both[:, 1], first), np.maximum.reduceat(both[:, 1], first)) if len(both) else (np.empty(0, np.int64),) * 3
                for column, x in zip(out, (np.full(len(h), host, np.int64), h, np.full(len(h), kind, np.int32), lo, hi), strict=True):
                    column.append(x)
        if out[0]:
            yield rows_of(PIECES, [np.concatenate(c) for c in out])


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The substrings that decide on a page: its runs, or the blocks of its main zone."""
    hashes = Hashes()
    for batch in batches:
        out: list[list] = [[], [], []]
        for row, host, zoned, kept in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "zoned", "kept")), strict=True):
            found = [np.array([block_hash(x)]) for x in lines(kept)] if zoned else [hashes.windows(x.split()) for x in lines(kept)]
            if found:
                h = np.unique(np.concatenate(found))
                for column, x in zip(out, (np.full(len(h), row, np.int64), np.full(len(h), host, np.int64), h), strict=True):
                    column.append(x)
        if out[0]:
            yield rows_of(ASKED, [np.concatenate(c) for c in out])


def main_text(zoned: bool, kept: list[str], repeated: np.ndarray, hashes: Hashes) -> str:
    """Blocks without the repeated ones, or without the runs that repeated runs cover; all, if nothing would be left."""
    if not len(repeated):
        return "\n".join(kept)
    if zoned:
        gone = set(repeated.tolist())
        left = [x for x in kept if block_hash(x) not in gone]
        return "\n".join(left or kept)
    out = []
    for x in kept:
        words = x.split()
        hit = np.isin(hashes.windows(words), repeated)
        cover = np.zeros(len(words), bool)
        for s in range(SPAN if len(hit) else 0):
            cover[s : s + len(hit)] |= hit
        out.append(" ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c))
    return "\n".join([x for x in out if x] or kept)


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        got = [main_text(z, lines(k), np.array(r or [], np.int64), hashes) for z, k, r in zip(*(batch.column(c).to_pylist() for c in ("zoned", "kept", "repeated")), strict=True)]
        yield rows_of(EXTRACTED, [batch.column("page_id"), batch.column("url"), got, [len(x) for x in got]])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars."""
    small_batches(pages.sparkSession)
    url = F.col(url_col).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.xxhash64(host).alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = stored(rows.mapInArrow(sliced(parse), ddl(PARSED)).select(F.monotonically_increasing_id().alias("row"), "*"), "html-blocks")
    found = rows.select("host", "article", "zoned", "kept", "other").mapInArrow(sliced(pieces), ddl(PIECES))
    run, kind = F.col("kind") <= PLAIN_RUN, F.col("kind")
    merged = found.groupBy("host", "hash").agg(
        F.max((kind == PLAIN_RUN).cast("int")).alias("asked"),
        (F.min(F.when(run, F.col("lo"))) < F.max(F.when(run, F.col("hi")))).alias("runs"),
        (F.min(F.when(kind == CHROME_BLOCK, F.col("lo"))) < F.max(F.when(kind == CHROME_BLOCK, F.col("hi")))).alias("chrome"),
        (F.min(F.when(kind == MAIN_BLOCK, F.col("lo"))) < F.max(F.when(kind == MAIN_BLOCK, F.col("hi")))).alias("main"),
    )
    boiler = stored(merged.where("(asked = 1 and runs) or (chrome and main)").select("host", "hash"), "html-repeats")
    # stored tables: the planner knows their sizes, and broadcasts below its threshold only
    hits = rows.select("row", "host", "zoned", "kept").mapInArrow(sliced(asked), ddl(ASKED)).join(boiler, ["host", "hash"])
    hits = stored(hits.groupBy("row").agg(F.collect_list("hash").alias("repeated")), "html-hits")
    out = rows.select("row", "page_id", "url", "zoned", "kept").join(hits, "row", "left")
    return out.select("page_id", "url", "zoned", "kept", "repeated").mapInArrow(sliced(decide), ddl(EXTRACTED))
