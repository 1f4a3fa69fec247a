"""WARC archives: a writer that turns repeated payloads into revisits, and a reader that salvages damaged archives.

Writing: every record is a gzip member of its own. Spark's text writer puts the members down one after the other, with an empty
gzip member (valid between members) as its separator, so archives land in any store that Spark writes to. A row of that writer holds
records of some 4 MB together, and a larger record is followed by empty rows for its further bytes, so that a limit of rows per file
is one of bytes. Of pages with equal payloads the one with the largest id is the response, the others revisit it; payloads below ``min_bytes`` are all responses.

Reading: a gzip member must end and match its checksum, a record must have a version line, a length that fits and a matching
block digest. After a failed check the reader searches on from the next byte for a member or version line that passes, goes on
there, and logs the bytes between as a quarantined gap. A member's content is searched by version lines in the same way; of a
member that breaks off or fails its checksum, what came out before counts too, and the records whose own digests pass are kept.
Records and gaps inside a member have the member's offset and length (up to its last kept record, if it is broken).

Defined results: a null payload is empty; a null id or address is written without value and read as null; of repeated rows with
the responding id each is a response; white space and control characters in an address are percent-encoded; other columns are
ignored, so their names cannot clash; an empty table gives no records.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import lean, new_path, small_side

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member without content (fixed value: header, an empty final block, CRC and size of nothing).
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
VERSION_LINE, STARTS = re.compile(re.escape(VERSION)), re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
#: Fields that every record has.
REQUIRED = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"}
CHUNK = 1 << 14
#: A record's uncompressed size at most, which no value of a row can pass; a member that claims more fails its check.
MOST = 1 << 31


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; with refers_to a revisit, whose block is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", compressed: bool = True, level: int = 5, file_bytes: int = 128 << 20, row_bytes: int = 4 << 20) -> None:
    """Write a record per row to archives under path. Only ids and digests are grouped; payloads are shuffled only if the repeated digests are too many to broadcast."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    digest = F.sha1(F.encode("payload", "UTF-8"))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy(digest.alias("digest")).agg(F.max("page").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("digest", "keeper")
    marked = rows.withColumn("digest", digest).join(small_side(groups, 500_000), "digest", "left").select("page", "url", "payload", F.when(~F.col("page").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        row = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])
        held, size = [], 0
        for b in batches:
            for p, u, x, r in zip(*b.columns, strict=True):
                made = record(p.as_py(), u.as_py(), x.as_buffer().to_pybytes(), r.as_py(), date)
                made = member(made, level) if compressed else made
                if held and size + len(made) > row_bytes:
                    yield row([b"".join(held)])
                    held, size = [], 0
                held.append(made)
                size += len(made)
                if size > row_bytes:
                    yield row([made] + [b""] * (size // row_bytes))
                    held, size = [], 0
        if held:
            yield row([b"".join(held)])

    # with encoding ISO-8859-1 each character of the separator is a byte; rows are bytes already
    sep = EMPTY_MEMBER.decode("latin-1") if compressed else "\r\n"
    out = marked.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", sep).option("maxRecordsPerFile", max(1, file_bytes // row_bytes)).text(path)


def _headers(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}


class Heads:
    """Where headers end in a buffer that is read forwards.

    However many version lines lie before one header's end, it is searched once, and not read again while it must fail again.
    """

    def __init__(self, data: bytes) -> None:
        self.data, self.end, self.fails_before = data, None, 0

    def end_of(self, pos: int) -> int:
        """The place of the blank line that ends a header at pos, -1 if there is none or if that header is known to fail."""
        if pos < self.fails_before:
            return -1
        if self.end is None or 0 <= self.end < pos:
            self.end = self.data.find(b"\r\n\r\n", pos)
        return self.end


def parse(data: bytes, pos: int, heads: Heads | None = None, digests: bool = False) -> tuple[dict | None, int, str]:
    """The record at pos, the place after it, and what failed. With digests, a record without a block digest fails."""
    if data[pos : pos + 7] != VERSION:
        return None, pos, "version"
    heads = heads or Heads(data)
    head_end = heads.end_of(pos)
    if head_end < 0:
        return None, pos, "header"
    head = data[pos:head_end]
    h = _headers(head)
    start = head_end + 4
    # a later version line before the same end has fewer of these fields and the same length
    if not h.keys() >= REQUIRED:
        heads.fails_before = head_end
        return None, pos, "header"
    if not h[b"content-length"].isdigit():
        heads.fails_before = head_end
        return None, pos, "length"
    stop = start + int(h[b"content-length"])
    if stop + 4 > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
        heads.fails_before = head_end
        return None, pos, "length"
    block, d = data[start:stop], h.get(b"warc-block-digest", b"")
    if d.startswith(b"sha1:") and d[5:].decode("latin-1") != sha1(block):
        # while the digest's line is part of the header
        heads.fails_before = pos + max((m.start() for m in re.finditer(rb"\r\n\s*warc-block-digest\s*:", head, re.I)), default=0)
        return None, pos, "digest"
    if digests and not d.startswith(b"sha1:"):
        return None, pos, "digest"
    return h | {b"": block}, stop + 4, ""


def _before_error(data: memoryview, pos: int, at: int) -> bytes:
    """What comes out of the chunk at `at` of the member at pos before it fails.

    A failing call gives nothing back, so the chunk is read up to ever nearer places before the fault, the last bytes one by one.
    """
    chunk, safe, out = data[at : at + CHUNK], 0, []
    for step in (4096, 64, 0):
        d = zlib.decompressobj(31)
        for p in range(pos, at, CHUNK):
            d.decompress(data[p : p + CHUNK])
        out = [d.decompress(chunk[:safe])]
        with contextlib.suppress(zlib.error):
            for k in range(safe, len(chunk)) if not step else ():
                out.append(d.decompress(chunk[k : k + 1]))
            tail = chunk[safe:]
            while step and d.decompress(tail, step):
                tail = d.unconsumed_tail
                safe = max(0, len(chunk) - len(tail) - 16)  # what was taken in may be ahead of what came out
    return b"".join(out)


def inflate(data: memoryview, pos: int) -> tuple[bytes, int, bool]:
    """The content of the gzip member at pos, the place after it, and whether it is whole; else, what comes out before it breaks off or fails."""
    d, out, at, size = zlib.decompressobj(31), [], pos, 0
    try:
        while not d.eof:
            part = data[at : at + CHUNK]
            if not len(part):
                return b"".join(out), at, False
            out.append(d.decompress(part))
            size += len(out[-1])
            if size > MOST:
                return b"".join(out), at, False
            at += len(part)
    except zlib.error:
        return b"".join([*out, _before_error(data, pos, at)]), at, False
    return b"".join(out), at - len(d.unused_data), True


def place_of(data: memoryview, pos: int, size: int) -> int:
    """The first place at which so many bytes have come out of the member at pos."""
    d, at, out = zlib.decompressobj(31), pos, 0
    while out < size:
        before = d.copy()
        try:
            n = len(d.decompress(data[at : at + CHUNK]))
        except zlib.error:
            n = size
        if out + n < size:
            out, at = out + n, at + CHUNK
            continue
        while out < size:
            out, at = out + len(before.decompress(data[at : at + 1])), at + 1
    return at


def found_next(buffer: bytes, pos: int, members: bool = True) -> int:
    """The next place where a member or a version line may begin."""
    m = (STARTS if members else VERSION_LINE).search(buffer, pos)
    return m.start() if m else len(buffer)


def inside(content: bytes, whole: bool) -> tuple[list[tuple[dict | None, str]], int, str]:
    """Records and gaps of a member's content, the place after the last record, and what failed first. Of a broken member, up to the last record."""
    found = list(salvage(content, members=False, digests=not whole))
    last = max((k for k, x in enumerate(found) if x[2]), default=-1)
    bad = next((x[3] for x in found if x[2] is None), "")
    kept = found if whole else found[: last + 1]
    return [x[2:] for x in kept], sum(found[last][:2]) if last >= 0 else 0, bad


def salvage(buffer: bytes, *, members: bool = True, digests: bool = False) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, length, record or None, fault) of all bytes of an archive but empty members and blank lines between records."""
    data, heads, pos, lost, fault = memoryview(buffer), Heads(buffer), 0, -1, ""

    def step() -> tuple[list[tuple[dict | None, str]], int, str]:
        """What is found at pos, the place after it, and what failed there."""
        if members and data[pos : pos + 3] == MAGIC:
            content, after, whole = inflate(data, pos)
            got, size, bad = inside(content, whole)
            if not size and (bad or not whole):
                return [], pos, bad if whole else "member"
            return (got, after, "") if whole else (got, place_of(data, pos, size), "member")
        r, after, bad = parse(buffer, pos, heads, digests)
        return [] if r is None else [(r, "")], after, bad

    while pos < len(buffer):
        if data[pos] in b"\r\n" and lost < 0:
            pos += 1
            continue
        got, after, bad = step()
        if lost >= 0 and (got or not bad):
            if pos > lost:
                yield lost, pos - lost, None, fault
            lost = -1
        for r, inner in got:
            yield pos, after - pos, r, inner
        if bad:
            if lost < 0:
                lost, fault = after, bad
            # of a broken member with records, the next one may begin right after them
            pos = found_next(buffer, after if got else pos + 1, members)
            continue
        pos = after
    if 0 <= lost < len(buffer):
        yield lost, len(buffer) - lost, None, fault


def _page(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def _row(offset: int, length: int, r: dict | None, fault: str) -> tuple:
    if r is None:
        return offset, length, "gap", fault, None, None, None, None, None, None, None
    http, _, body = r[b""].partition(b"\r\n\r\n")
    kind = r.get(b"warc-type", b"").decode("latin-1")
    said = _headers(http).get(b"content-length", b"")
    size = len(body) if kind == "response" else int(said) if said.isdigit() else None
    told = r.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
    return offset, length, "record", None, _page(r.get(b"warc-record-id")), r[b"warc-target-uri"].decode() if b"warc-target-uri" in r else None, kind, sha1(body) if kind == "response" else told, size, _page(r.get(b"warc-refers-to")), body if kind == "response" else None


FIELDS = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("fault", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row per record (kind `record`) and per quarantined gap (kind `gap`, with the check that failed) of the archives under path.

    An archive is read by one task, which holds it whole: archives should be of some 100 MB (file_bytes when written).
    """
    names = FIELDS if with_payload else FIELDS[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*b.columns, strict=True):
                held, size = [], 0
                for x in salvage(content.as_buffer().to_pybytes()):
                    held.append((name.as_py(), *_row(*x))[: len(names)])
                    size += 500 + (len(held[-1][-1] or b"") if with_payload else 0)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), names, strict=True)], [n for n, _ in names])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), names, strict=True)], [n for n, _ in names])

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, ", ".join(f"{n} {kinds[t]}" for n, t in names))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to the shared folder and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path, with_payload=False).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
