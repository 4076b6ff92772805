"""WARC segment reassembly.

Raw records are parsed on the map side; continuation records are brought to their origin record's identifier by one
shuffle that also orders them by segment number, and every origin is put together in one streaming pass: numbers must be 1, 2, ... n, the
last segment must state the total length, and the joined blocks must have it. An HTTP response's body is then freed from
chunked transfer framing.

Status of an origin:
  ok, or the first of these that holds: conflict (two different segments of one number), missing (a number of 1 .. n is not there),
  no_total (the last segment states no total length), length (joined length differs from it), chunked (framing is broken).
A record that is not segmented is an origin of its own.

Archives are read by archive_records(): plain files and such of gzip members.

Defined results: null or unparsable records are left out of reassembly (parse gives them the status "bad"; so are those whose lengths or numbers
are beyond 64 bits, segment numbers beyond 32); equal repeated segments count once, so rows that repeat a record change nothing; two
different segments of one number (a tie) are a conflict; an origin of empty blocks has an empty body; a body is null unless the status is ok;
an HTTP status that isn't three digits is null; null targets stay null; blocks of any length count whole; an empty table gives an empty table; other
columns are ignored. Of pages, every row is a record of its own: repeated rows stay, null ids, urls and html stay null (line breaks in a url are
percent-encoded, blanks around it dropped).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidframe.llm.common import c, ensure_workers, shuffle_partitions

RECORD = "origin string, segment int, total long, record_type string, target string, block binary, status string"
RESULT = "origin string, target string, n_segments int, length long, status string, http_status int, body binary"
_size = re.compile(rb"\s*([0-9A-Fa-f]+)\s*(?:;[^\r\n]*)?\Z")


class Broken(ValueError):
    pass


def number_of(value: str, below: int) -> int:
    if not (value.isascii() and value.isdigit() and len(value) < 20 and int(value) < below):
        raise Broken(f"no number, or none below {below}: {value[:40]}")
    return int(value)


def parse_record(raw: bytes) -> dict:
    """Headers and block of one raw WARC record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise Broken("no WARC header")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, found, value = line.partition(b":")
        if not found:
            raise Broken("no colon in a header line")
        name = key.strip().decode("latin-1").lower()
        headers[name] = value.strip().decode("utf-8", "replace")
    try:
        length = number_of(headers["content-length"], 2**63)
        number = number_of(headers.get("warc-segment-number", "0"), 2**31)
        total = number_of(headers["warc-segment-total-length"], 2**63) if "warc-segment-total-length" in headers else None
        kind, own = headers["warc-type"].lower(), headers["warc-record-id"]
    except KeyError as e:
        raise Broken(f"header missing: {e}") from None
    if len(rest) < length or rest[length:].strip(b"\r\n"):
        raise Broken("the block's length differs from Content-Length")
    origin = headers.get("warc-segment-origin-id") if kind == "continuation" else own
    if not origin or kind == "continuation" and number < 2:
        raise Broken("a continuation without origin or number")
    if not number:
        number, total = 1, length
    return {"origin": origin, "segment": number, "total": total, "record_type": kind, "target": headers.get("warc-target-uri"), "block": rest[:length]}


def unchunk(body: bytes) -> bytes:
    """The content of a chunked body; extensions and trailers are dropped."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        m = _size.match(body[at:end]) if end >= 0 else None
        if not m:
            raise Broken("no chunk size")
        size = int(m[1], 16)
        at = end + 2
        if not size:
            break
        if body[at + size : at + size + 2] != b"\r\n":
            raise Broken("a chunk isn't as long as its size")
        parts.append(body[at : at + size])
        at += size + 2
    if not body.startswith(b"\r\n", at) and b"\r\n\r\n" not in body[at:]:
        raise Broken("no end after the last chunk")
    return b"".join(parts)


def http_body(block: bytes) -> tuple[int | None, bytes]:
    """Status and body of an HTTP response; what doesn't begin as one is a body without status."""
    if not block.startswith(b"HTTP/"):
        return None, block
    head, found, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    code = lines[0].split(None, 2)
    status = int(code[1]) if len(code) > 1 and re.fullmatch(rb"[0-9]{3}", code[1]) else None
    for line in lines[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"transfer-encoding" and value.strip().lower().split(b",")[-1].strip() == b"chunked":
            body = unchunk(body)
    return status, body


def join_segments(segments: list[tuple[int, int | None, str | None, bytes]]) -> dict:
    """segments: (number, total, target, block), ordered by number."""
    by: dict[int, tuple[int | None, str | None, bytes]] = {}
    conflict = False
    for number, total, target, block in segments:
        if number in by:
            conflict |= by[number][2] != block or by[number][0] != total
        else:
            by[number] = (total, target, block)
    last = max(by)
    out = {"target": next((by[k][1] for k in sorted(by) if by[k][1] is not None), None), "n_segments": len(by), "length": sum(len(x[2]) for x in by.values()), "status": "ok", "http_status": None, "body": None}
    if conflict:
        out["status"] = "conflict"
    elif len(by) != last or min(by) != 1:
        out["status"] = "missing"
    elif by[last][0] is None:
        out["status"] = "no_total"
    elif by[last][0] != out["length"]:
        out["status"] = "length"
    else:
        try:
            out["http_status"], out["body"] = http_body(b"".join(by[k][2] for k in range(1, last + 1)))
        except Broken:
            out["status"] = "chunked"
    return out


def parse(records: DataFrame, raw: str = "record") -> DataFrame:
    """Parsed records; those that are null or broken have the status "bad" and nulls."""
    ensure_workers(records.sparkSession)
    fields = ("origin", "segment", "total", "record_type", "target", "block")
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.column(0).to_pylist():
                try:
                    rows.append(parse_record(r) | {"status": "parsed"} if r is not None else {"status": "bad"})
                except Broken:
                    rows.append({"status": "bad"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], k) for f, k in zip((*fields, "status"), (*kinds, pa.string()))], [*fields, "status"])

    return records.select(c(raw).cast("binary").alias("record")).mapInArrow(run, RECORD)


def reassemble(parsed: DataFrame) -> DataFrame:
    """One row an origin; parsed: see parse()."""
    spark = parsed.sparkSession
    ensure_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("origin", "target", "n_segments", "length", "status", "http_status", "body")
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary())

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], k) for x, k in zip(names, kinds)], list(names))

        current, held, rows = None, [], []
        for batch in batches:
            for origin, segment, total, target, block in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if origin != current and held:
                    rows.append({"origin": current} | join_segments(held))
                    held = []
                current = origin
                held.append((segment, total, target, block))
            if rows:
                yield packed(rows)
                rows = []
        if held:
            yield packed([{"origin": current} | join_segments(held)])

    rows = parsed.where("status = 'parsed'").select("origin", "segment", "total", "target", "block")
    return rows.repartition(shuffle_partitions(spark), "origin").sortWithinPartitions("origin", "segment").mapInArrow(run, RESULT)


SEGMENT = 2048  # bytes of a block in a segment of the records made from pages
CHUNK = 1000


def page_records(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """record: raw WARC records that hold each page (page_id, url, html) as a chunked HTTP response in segments.

    Each row has an origin of its own, of the form urn:page:ROW:ID:KIND:SEGMENT; ID is empty for a null page_id, KIND is null where html is.
    """
    ensure_workers(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, page, url, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                name = f"{row}:{'' if page is None else page}:{'null' if text is None else 'html'}"
                out += segments_of(name, url, (text or "").encode(), segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), c("page_id").cast("long").alias("page"), c("url").cast("string").alias("url"), c("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "record binary")


def segments_of(page: int | str, url: str | None, body: bytes, segment: int = SEGMENT, chunk: int = CHUNK) -> list[bytes]:
    framed = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + chunk]), body[i : i + chunk]) for i in range(0, len(body), chunk))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + framed + b"0\r\n\r\n"
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for k, part in enumerate(parts, 1):
        head = ["WARC/1.1", f"WARC-Type: {'response' if k == 1 else 'continuation'}", f"WARC-Record-ID: <urn:page:{page}:{k}>"]
        if url is not None:
            head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
        if len(parts) > 1:
            head.append(f"WARC-Segment-Number: {k}")
            if k > 1:
                head.append(f"WARC-Segment-Origin-ID: <urn:page:{page}:1>")
            if k == len(parts):
                head.append(f"WARC-Segment-Total-Length: {len(block)}")
        head.append(f"Content-Length: {len(part)}")
        out.append("\r\n".join(head).encode() + b"\r\n\r\n" + part + b"\r\n\r\n")
    return out


def pages_reassembled(pages: DataFrame) -> DataFrame:
    """page_id, url, status, http_status, html of pages cut into WARC segments and put together again."""
    whole = reassemble(parse(page_records(pages)))
    name = r"page:\d+:(-?\d*):(html|null):"
    html = F.when(F.regexp_extract("origin", name, 2) == "html", F.decode("body", "UTF-8"))
    return whole.select(F.expr(f"try_cast(regexp_extract(origin, r'{name}', 1) AS long)").alias("page_id"), F.col("target").alias("url"), "status", "http_status", html.alias("html"))


def members(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member of an archive; what isn't compressed is one piece. A broken member ends it as far as it is readable."""
    while data:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        z = zlib.decompressobj(31)
        try:
            out = z.decompress(data)
        except zlib.error:
            yield b"broken"
            return
        yield out if out or z.eof else b"broken"
        data = z.unused_data if z.eof else b""


def split_records(data: bytes) -> Iterator[bytes]:
    """Raw records of an uncompressed stretch of an archive; a stretch that can't be cut is a record of its own, which parse() finds bad."""
    at = 0
    while at < len(data):
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        head = data.find(b"\r\n\r\n", at)
        m = re.search(rb"\r\ncontent-length[ \t]*:[ \t]*([0-9]{1,18})[ \t]*\r\n", data[at : head + 2], re.I) if head >= 0 else None
        if not m or not data.startswith(b"WARC/", at):
            after = data.find(b"\r\nWARC/", at)
            end = after + 2 if after >= 0 else len(data)
        else:
            end = head + 4 + int(m[1])
        yield data[at:end]
        at = end


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """record: the raw records of WARC files (plain, or gzip members one after the other), each file by one task."""
    ensure_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held, size = [], 0
                for r in (r for piece in members(data) for r in split_records(piece)):
                    held.append(r)
                    size += len(r)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record binary")


ORACLE_SQL = "SELECT page_id, url, 'ok' AS status, 200 AS http_status, html FROM pages"
