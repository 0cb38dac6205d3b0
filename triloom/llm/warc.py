"""WARC archives with a two-level capture index.

Tasks write one archive each: a gzip member for every record, responses with their payload, revisits without. The index
lists the captures by reversed-host URL key (com,example,www)/path) and page in sorted, compressed blocks of lines; the sparse
directory has the first capture and the place of each block. A lookup binary-searches the directory, reads one block by
range, binary-searches it, and reads the record by range. Many lookups at once (all pages, in the query) go to the
part of the directory that their keys fall into, a part being what one task wrote, and are made there in order, so that each block
is fetched once.

Each attempt of a task writes files of its own, and the rows that name them are stored, so a lost executor costs
a repeated task and leaves at most an unnamed file.

Defined cases: a null html is an empty payload; a null url has the key ")"; a null page_id can't be referred to (equal
payloads without any id are all responses); rows with equal ids and payloads are all of the type that the smallest id has;
an empty table gives no rows; further columns are ignored. A very long payload is one record in a worker's memory.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Reader, Writer
from .runtime import arrow_schema, ddl, shared_path, sliced, small_batches, stored

BLOCK_LINES = 1000


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.example.com/a?b -> com,example,www)/a?b."""
    url = (url or "").strip()
    rest = url.split("://", 1)[1] if "://" in url else url
    try:
        host = urlsplit("//" + rest).hostname or ""
    except ValueError:
        host = ""
    tail = rest[min((k for k in (rest.find("/"), rest.find("?"), rest.find("#")) if k >= 0), default=len(rest)) :].split("#", 1)[0]
    return quote(",".join(reversed(host.split("."))) + ")" + tail, safe="/?&=:;,()+~!*'@$%[]#")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, date: str) -> tuple[bytes, str]:
    """A record as one gzip member, and its payload digest."""
    told = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Date": date, "WARC-Target-URI": quote(url or "", safe="/:?&=#;,()+~!*'@$%[]"), "WARC-Payload-Digest": f"sha1:{told}"}
    if refers is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Payload-Length": str(len(payload))}
    body = http + payload if refers is None else http
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    member = zlib.compressobj(4, zlib.DEFLATED, 31)
    return member.compress(text.encode() + body + b"\r\n\r\n") + member.flush(), told


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Write archives and index; returns the captures (key, page_id, file, offset, length) and the directory
    (first, file, offset, length, n_lines, first_page, part)."""
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    # of payloads met once nothing need be known; the rest is a stored table, whose size the planner sees
    repeated = stored(rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("sha", "least"), "repeated")
    rows = rows.join(repeated, "sha", "left")
    schema = arrow_schema(key="string", page_id="long", file="string", offset="long", length="long")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or Writer(folder, "archive.warc.gz")
            got: list[tuple] = []
            for page, url, payload, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member, _ = record(page, url, payload, None if least is None or page == least else least, date)
                got.append((url_key(url), page, out.uri, *out.append(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)
        if out:
            out.close()

    captures = stored(rows.select("page_id", "url", "html", "least").mapInArrow(sliced(archive), ddl(schema)), "captures")
    places = arrow_schema(first="string", file="string", offset="long", length="long", n_lines="long", first_page="long", part="long")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, got, part = None, [], [], TaskContext.get().partitionId()

        def put() -> None:
            nonlocal lines
            first, _, rest = lines[0].partition(" ")
            got.append((first, out.uri, *out.append(zlib.compress("\n".join(lines).encode())), len(lines), json.loads(rest)[0], part))
            lines = []

        for batch in batches:
            out = out or Writer(folder, "index.cdx.z")
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(f"{key} {json.dumps([page, file, offset, length])}")
                if len(lines) == BLOCK_LINES:
                    put()
        if lines:
            put()
        if out:
            out.close()
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), places, strict=True)], schema=places)

    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return captures, stored(ordered.mapInArrow(sliced(blocks), ddl(places)), "directory")


def block_lines(reader: Reader, file: str, offset: int, length: int) -> list[str]:
    return zlib.decompress(reader.read(file, offset, length)).decode().split("\n")


def lookup(directory: list[tuple], url: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a URL. directory: rows (first, file, offset, length, ...) sorted by first."""
    key, reader = url_key(url), Reader()
    k = max(0, bisect.bisect_left(directory, key, key=lambda r: r[0]) - 1)
    while k < len(directory) and directory[k][0] <= key:
        lines = block_lines(reader, *directory[k][1:4])
        at = bisect.bisect_left(lines, key + " ")
        while at < len(lines) and lines[at].startswith(key + " "):
            _, file, offset, length = json.loads(lines[at].split(" ", 1)[1])
            yield parse(Reader().read(file, offset, length))
            at += 1
        k += 1
    reader.close()


RECORDS = arrow_schema(page_id="long", url_key="string", payload_bytes="long", payload_digest="string", record_type="string", refers_to="long")


def told(member: bytes, page: int | None, key: str) -> tuple:
    """What a record says of its capture, as a row of RECORDS. The payload of a response is checked against its digest."""
    fields, payload = parse(member)
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != stated:
        raise ValueError(f"damaged record of page {page}")
    refers = int(fields["WARC-Refers-To"][len("<urn:page:") : -1]) if kind == "revisit" else None
    return page, key, len(payload) if kind == "response" else int(fields["X-Payload-Length"]), stated, kind, refers


def place_of(key: str, page: int | None) -> tuple:
    """Order of captures in the index; no page id comes first."""
    return key, page is not None, page or 0


def read(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of all wanted captures (key, page_id; each once, however often it is named), by binary searches and range reads:
    page_id, url_key, payload_bytes, payload_digest, record_type, refers_to."""
    # one row for each task that wrote blocks
    firsts = directory.groupBy("part").agg(F.min(F.struct("first", "first_page")).alias("f")).select("part", "f.*").collect()
    firsts = sorted((place_of(r["first"], r["first_page"]), r["part"]) for r in firsts)
    bounds, parts = [f for f, _ in firsts], [p for _, p in firsts]
    asked = arrow_schema(part="long", key="string", page_id="long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = place_of(key, page)
                # equal captures may lie in several parts
                out += [(parts[k], key, page) for k in range(max(0, bisect.bisect_left(bounds, at) - 1), bisect.bisect_right(bounds, at))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), asked, strict=True)], schema=asked)

    def find(wanted_: pa.Table, blocks: pa.Table) -> pa.Table:
        index, reader, out = Reader(), Reader(), []
        rows = sorted((place_of(r["first"], r["first_page"]), r["file"], r["offset"], r["length"]) for r in blocks.to_pylist())
        starts, held, loaded = [r[0] for r in rows], None, -1
        found: list[tuple] = []
        for at in sorted(place_of(r["key"], r["page_id"]) for r in wanted_.to_pylist()):
            k = max(0, bisect.bisect_left(starts, at) - 1)
            while k < len(rows) and starts[k] <= at:
                if k != loaded:
                    out += records(reader, found)
                    lines = [line.partition(" ") for line in block_lines(index, *rows[k][1:])]
                    entries = [(key, json.loads(x)) for key, _, x in lines]
                    held, loaded, found = ([place_of(key, x[0]) for key, x in entries], entries), k, []
                lo, hi = bisect.bisect_left(held[0], at), bisect.bisect_right(held[0], at)
                found += held[1][lo:hi]
                k += 1
        out += records(reader, found)
        index.close()
        reader.close()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(RECORDS), RECORDS, strict=True)], schema=RECORDS)

    requests = wanted.select("key", F.col("page_id").cast("long")).distinct().mapInArrow(sliced(deal), ddl(asked))
    return requests.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(find, ddl(RECORDS))


def records(reader: Reader, entries: list[tuple]) -> list[tuple]:
    """Rows of index entries (key, [page, file, offset, length]), read in the order of their places."""
    return [told(reader.read(file, at, size), page, key) for key, (page, file, at, size) in sorted(entries, key=lambda e: (e[1][1], e[1][2]))]
