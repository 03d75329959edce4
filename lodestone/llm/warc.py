"""WARC archives written and read by Spark, with segmented records reassembled.

The writer makes a record per page: an HTTP response in chunked transfer framing, or a revisit where a page of smaller id has the same payload.
Blocks longer than `segment` bytes go on in continuation records that name their origin and number. The reader takes an archive line by line and parses it by its
records' content lengths, once, groups segments by origin, orders them by number, verifies the total length and takes the chunked framing off. Segments are dealt and
sorted by origin and walked in batches, so a task holds one record's segments at a time.

Defined results: null html counts as an empty payload, null url as an empty one; a null page_id is written as `null` and read back as null; rows
repeated whole are archived each (a header of their own, X-Copy, tells their segments apart) and share their record type; an empty table gives empty archives
and no rows; other columns are ignored. Damaged records raise.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_by_key, staged

DATE = "2024-01-01T00:00:00Z"
CHUNK = 16384


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, chunk: int = CHUNK) -> bytes:
    """body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p := body[i : i + chunk]), p) for i in range(0, len(body), chunk)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing, trailers dropped."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + n])
        if len(out[-1]) != n or framed[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + n


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line end, which the text writer adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n"


def records_of(page_id: int | None, ordinal: str, url: str, html: str, refers_to: int | None, segment: int, copy: int = 0) -> list[bytes]:
    payload = html.encode("utf-8", "replace")
    rid = f"<urn:page:{'null' if page_id is None else page_id}:{ordinal}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    head: list[tuple[str, object]] = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("X-Page-Id", "null" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{sha1_32(payload)}")]
    if refers_to is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:{ordinal}>"), ("X-Refers-To-Page-Id", refers_to), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response")]
        return [record(more[:1] + head + more[1:], http)]
    block = http + chunked(payload)
    kind = [("WARC-Type", "response")]
    if len(block) <= segment:
        return [record([*kind, *head, ("Content-Type", "application/http;msgtype=response")], block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([*kind, *head, ("X-Copy", copy), ("WARC-Segment-Number", 1), ("Content-Type", "application/http;msgtype=response")], parts[0])]
    for k, p in enumerate(parts[1:], 2):
        own: list[tuple[str, object]] = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("X-Copy", copy), ("WARC-Segment-Number", k)]
        out.append(record(own + ([("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []), p))
    return out


#: About as many bytes as a record's own lines have.
HEAD = 512
KEY = ["_null", "_id", "_sha"]


def keyed(pages: DataFrame) -> DataFrame:
    """page_id (null told apart), digest, url and html of the payload of each page."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").isNull().alias("_null"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("_id"), F.sha1(F.encode(html, "utf-8")).alias("_sha"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))


def first_of_payload(pages: DataFrame, least: int) -> tuple[DataFrame, int]:
    """For each page and payload refers_to, the smallest page_id of that payload where the page is not it (else null), and the number of its rows; and that of all rows."""
    own = staged(keyed(pages).groupBy(*KEY).agg(F.max(F.octet_length("html")).alias("_n"), F.count("*").alias("_rows")))
    firsts = staged(own.groupBy("_sha").agg(F.min(F.when(~F.col("_null") & (F.col("_n") >= least), F.col("_id"))).alias("first"), F.count("*").alias("_pages")))
    joined = joined_by_key(own, firsts, ["_sha"], "_pages", own.count())
    total = own.agg(F.sum("_rows")).first()[0] or 0
    return staged(joined.select(*KEY, F.when((F.col("_n") >= least) & (F.col("_null") | (F.col("_id") != F.col("first"))), F.col("first")).alias("refers_to"), "_rows")), total


def write(pages: DataFrame, path: str, dedupe_from: int = 0, segment: int = 131072, per_archive: int = 1 << 30) -> None:
    """Archives of the pages (page_id, url, html) below path.

    dedupe_from: payloads of that many bytes at least are revisits after their first page; segment: most bytes of a record's block; per_archive: most
    bytes of an archive before compression, by so many records of at most a segment.
    """
    firsts, total = first_of_payload(pages, dedupe_from)
    p = joined_by_key(keyed(pages), firsts, KEY, "_rows", total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            held = 0
            for k in range(b.num_rows):
                page, url, text, sha, first, copy = (b.column(i)[k].as_py() for i in range(6))
                out += (own := records_of(page, sha, url, text, first, segment, copy))
                held += sum(map(len, own))
                if held > 16 << 20 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0

    lines = p.select(F.when(~F.col("_null"), F.col("_id")).alias("page_id"), "url", "html", "_sha", "refers_to", F.monotonically_increasing_id()).mapInArrow(run, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, per_archive // (segment + HEAD))).text(path)


def parsed(lines: Iterator[bytes]) -> Iterator[tuple]:
    """Records of archives, one after the other, from their bytes cut at each CR LF; one record is held at a time."""
    whole_number = lambda v: None if v in (None, "null") else int(v)
    for version in lines:
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {version[:40]!r}")
        h: dict[str, str] = {}
        for line in lines:
            if not line:
                break
            name, _, value = line.decode("utf-8").partition(":")
            h[name] = value.removeprefix(" ")
        n, held, size = int(h["Content-Length"]), [], 0
        while size < n + 2 and (line := next(lines, None)) is not None:
            held += [line, b"\r\n"]
            size += len(line) + 2
        if size != n + 2 or next(lines, None) != b"":
            raise ValueError(f"record {h.get('WARC-Record-ID')} is cut short")
        copy = h.get("X-Copy", "")
        yield h.get("WARC-Record-ID"), f"{h.get('WARC-Segment-Origin-ID', h.get('WARC-Record-ID'))} {copy}", whole_number(h.get("WARC-Segment-Number")), whole_number(h.get("WARC-Segment-Total-Length")), h["WARC-Type"], whole_number(h.get("X-Page-Id")), whole_number(h.get("X-Refers-To-Page-Id")), h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), whole_number(h.get("X-Payload-Length")), b"".join(held)[:n]


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PAGE_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def page_of(rec: tuple, payload: bool) -> tuple:
    """A page's row from its whole record."""
    rid, _, _, _, kind, page, first, digest, length, block = rec
    if kind == "revisit":
        return page, length, digest, kind, first, None
    head, _, framed = block.partition(b"\r\n\r\n")
    body = unchunked(framed) if b"transfer-encoding: chunked" in head.lower() else framed
    if digest and sha1_32(body) != digest:
        raise ValueError(f"the payload of {rid} does not have its digest")
    return page, len(body), sha1_32(body), kind, None, body if payload else None


def batch_of(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in names.split(", ")])


#: What moves from the parser to the reassembly: whole pages (segment 0) as they come out, segments of others with their blocks.
PART = "origin string, segment int, total long, " + PAGE
PART_KINDS = [pa.string(), pa.int32(), pa.int64(), *PAGE_KINDS]


def lines_of(archive: bytes) -> Iterator[bytes]:
    return iter(archive.removesuffix(b"\r\n").split(b"\r\n") if archive else [])


def read(spark: SparkSession, path: str, payload: bool = True, compressed: bool = True) -> DataFrame:
    """The pages in the archives below path: page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    compressed: whether they are, as what write() makes; such archives are of any size, others are read whole by one task each and have less than 2 GB.
    """
    if compressed:  # such an archive is one split, and its lines come in order
        lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").cast("binary"))
    else:
        lines = spark.read.format("binaryFile").load(path).select("content")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        cells = (x for b in batches for x in b.column(0).to_pylist())
        for rec in parsed(cells if compressed else (line for x in cells for line in lines_of(x))):
            if rec[2] is None:
                rows.append((rec[0], 0, None, *page_of(rec, payload)))
            else:
                rows.append((rec[1], rec[2], rec[3], rec[5], rec[8], rec[7], rec[4], rec[6], rec[9]))
            held += len(rec[9])
            if len(rows) >= 500 or held > 16 << 20:
                yield batch_of(rows, PART, PART_KINDS)
                rows, held = [], 0
        yield batch_of(rows, PART, PART_KINDS)

    def assembled(origin: str, recs: list[tuple]) -> tuple:
        block = b"".join(r[8] for r in recs)
        if [r[1] for r in recs] != list(range(1, len(recs) + 1)) or recs[-1][2] != len(block):
            raise ValueError(f"segments of {origin} are missing")
        _, _, _, page, length, digest, kind, first, _ = recs[0]
        return page_of((origin, None, None, None, kind, page, first, digest, length, block), payload)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by origin and segment."""
        recs: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if recs and (r[0] != recs[0][0] or not r[1]):
                    out.append(assembled(recs[0][0], recs))
                    recs = []
                if r[1]:
                    recs.append(r)
                else:
                    out.append(r[3:])
            yield batch_of(out, PAGE, PAGE_KINDS)
        if recs:
            yield batch_of([assembled(recs[0][0], recs)], PAGE, PAGE_KINDS)

    rows = lines.mapInArrow(parts, PART).repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(pages, PAGE)
    return rows if payload else rows.drop("payload")
