"""WARC segment reassembly and chunked transfer decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import map_arrow, table

SEGMENT_BYTES = 2048
CHUNK_BYTES = 1000
#: Segment numbers and lengths that fit their columns; a record of any other number isn't a segment.
MOST_SEGMENT, MOST_LENGTH = (1 << 31) - 1, (1 << 63) - 1


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunk(data: bytes) -> bytes | None:
    """The body of a chunked message; None where the framing is broken or cut off. Chunk extensions and trailers are skipped.

    A size of more hexadecimal digits than any body's is broken framing as well.
    """
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            return None
        word = data[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", word):
            return None
        if len(word.lstrip(b"0")) > 16:
            return None
        n, at = int(word, 16), end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(data[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def records_of(page_id, url: str | None, html: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> list[bytes]:
    """The WARC records of one page: a response in chunked framing, cut into segments of ``segment`` bytes."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html.encode(), chunk)
    h = hashlib.md5(f"{page_id}|{url}".encode() + b"|" + html.encode()).hexdigest()
    ids = lambda n: f"<urn:uuid:{hashlib.md5(f'{h}/{n}'.encode()).hexdigest()}>"
    origin, parts = ids(1), [body[i : i + segment] for i in range(0, len(body), segment)]
    uri = [("WARC-Target-URI", re.sub(r"[\r\n]", " ", url))] if url is not None else []
    who = [("X-Page-Id", page_id)] if page_id is not None else []
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *uri, *who], body)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *uri, *who, ("WARC-Segment-Number", 1)], parts[0])]
    for n, p in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(body))] if n == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", ids(n)), ("WARC-Segment-Origin-ID", origin), *uri, ("WARC-Segment-Number", n), *last], p))
    return out


def parse(raw: bytes) -> tuple[dict, bytes] | None:
    """Headers (lower-case names) and block of a record, or None if it isn't one or is cut off."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        return None
    head = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            head[k.strip().lower().decode("ascii", "replace")] = v.strip().decode("utf-8", "replace")
    n = _whole(head.get("content-length"))
    if n is None:
        return None
    block = raw[end + 4 : end + 4 + n]
    return (head, block) if len(block) == n else None


def _whole(text: str | None, most: int = MOST_LENGTH) -> int | None:
    """A number of ASCII digits from 0 to ``most``, in at most 19 digits after leading zeros; else None."""
    if not text or not text.isascii() or not text.isdigit():
        return None
    text = text.lstrip("0") or "0"
    return n if len(text) < 20 and (n := int(text)) <= most else None


def _signed(text: str | None) -> int | None:
    if text and text[0] == "-":
        n = _whole(text[1:], MOST_LENGTH + 1)
        return None if n is None else -n
    return _whole(text)


def parsed(records: DataFrame, raw_col: str = "record") -> DataFrame:
    """(origin, page, uri, segment, total, block) of each segment of a record of any type.

    A continuation belongs to the record of its origin identifier; any other record begins its
    own. Left out, as they belong to no origin, are null and empty bytes, what isn't a whole WARC
    record, a record without an identifier, and a segment whose number is missing or isn't a
    whole number from 1 to 2^31 - 1. A length beyond 2^63 - 1 counts as none. Repeated records
    stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                p = parse(raw) if raw is not None else None
                if p is None:
                    continue
                h, block = p
                first = h.get("warc-type", "").lower() != "continuation"
                seg = _whole(h.get("warc-segment-number", "1" if first else None), MOST_SEGMENT)
                origin = h.get("warc-record-id") if first else h.get("warc-segment-origin-id")
                if not origin or not seg:
                    continue
                total = len(block) if first and "warc-segment-number" not in h else _whole(h.get("warc-segment-total-length"))
                rows.append((origin, _signed(h.get("x-page-id")), h.get("warc-target-uri"), seg, total, block))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["origin", "page", "uri", "segment", "total", "block"])

    return map_arrow(records.select(F.col(f"`{raw_col}`")), run, "origin string, page bigint, uri string, segment int, total bigint, block binary")


def reassemble(segments: DataFrame) -> DataFrame:
    """One row for each origin: (origin, page, uri, segments, ok, status, body).

    Segments are shuffled once by origin and come sorted by number, so that a worker holds one
    origin at a time. Repeated segments of one number count once (the first by content). ok needs
    numbers 1..n without a gap, a total length, and exactly that many bytes; otherwise body is
    null. A chunked HTTP message loses its framing; one with broken framing isn't ok. A block
    that is no HTTP message is its own body. An empty table gives no rows.
    """

    def finish(o) -> tuple:
        origin, page, uri, total, parts, numbers = o
        data = b"".join(parts)
        ok = total is not None and numbers == list(range(1, len(numbers) + 1)) and len(data) == total
        status = body = None
        if ok:
            head, sep, rest = data.partition(b"\r\n\r\n")
            m = re.match(rb"HTTP/\S+ (\d{3})", head)
            status = int(m[1]) if m else None
            if not (m and sep):
                body = data
            elif re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
                body = dechunk(rest)
                ok = body is not None
            else:
                body = rest
        return origin, page, uri, len(numbers), ok, status, body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
        names = ["origin", "page", "uri", "segments", "ok", "status", "body"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

        now, rows, size = None, [], 0
        for b in batches:
            for origin, page, uri, seg, total, block in zip(*(b.column(i).to_pylist() for i in range(6))):
                if now is None or now[0] != origin:
                    if now is not None:
                        rows.append(finish(now))
                        size += len(rows[-1][-1] or b"")
                        if size > 8 << 20:
                            yield out(rows)
                            rows, size = [], 0
                    now = [origin, None, None, None, [], []]
                if now[5] and now[5][-1] == seg:
                    continue
                now[1] = page if now[1] is None else now[1]
                now[2] = uri if now[2] is None else now[2]
                now[3] = total if total is not None else now[3]
                now[4].append(block)
                now[5].append(seg)
        if now is not None:
            rows.append(finish(now))
        if rows:
            yield out(rows)

    ordered = segments.repartition("origin").sortWithinPartitions("origin", "segment", "block")
    return map_arrow(ordered, run, "origin string, page bigint, uri string, segments int, ok boolean, status int, body binary")


def page_records(pages: DataFrame, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``record``: the WARC records of (page_id, url, html), of any length.

    Rows with a null html have none, and an empty one has a record; a null page_id or url leaves
    its header out; equal rows give equal records; other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                for r in records_of(i, u, h, segment, chunk) if h is not None else ():
                    out.append(r)
                    size += len(r)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return map_arrow(spread(pages.select("page_id", "url", "html")), run, "record binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through segmented, chunked WARC records and back; equal rows come back once."""
    done = reassemble(parsed(page_records(table(spark, sf_dir, "pages"))))
    return done.where("ok").select(F.col("page").alias("page_id"), F.col("uri").alias("url"), "segments", F.decode("body", "UTF-8").alias("html"))


OP6_SQL = """
WITH p AS (SELECT DISTINCT page_id, url, html FROM pages WHERE html IS NOT NULL),
n AS (SELECT *, CASE WHEN strlen(html) = 0 THEN 0 ELSE (strlen(html) - 1) // 1000 END AS q FROM p),
s AS (SELECT *, CASE WHEN strlen(html) = 0 THEN 0 ELSE strlen(html) - q * 1000 END AS r FROM n)
SELECT page_id, url, CAST((87 + q * (1000 + 3 + 4) + CASE WHEN r = 0 THEN 0 ELSE r + length(printf('%x', r)) + 4 END + 5 + 2047) // 2048 AS INTEGER) AS segments, html FROM s
"""
