"""WARC writer and salvage reader.

Writer.  Every record is a gzip member of its own (header block, blank line,
payload, two CRLFs), so that damage to one costs that one.  Members are joined to
files of ``file_bytes`` at most (a larger record is a file of its own), which
bounds what a task holds here and in the reader.  Files are written by Spark's
text writer, one row a file, on any file system; its line separator is an empty
gzip member, which ends the file as BGZF files end and is read as nothing.  Which
pages are revisits is settled on (page_id, digest) rows alone; payloads are not
shuffled while the revisits are ``BROADCAST_REVISITS`` at most, and are
joined by page_id and digest beyond.

Salvage reader.  Files are parsed record by record, in one pass: members are
inflated by chunks, so that time is linear in a file's bytes.  When a check fails
(version line, header, length, closing CRLFs, digest, compressed member), the
reader looks for the next valid member or version line, goes on from there and
logs the bytes between as a quarantined gap: (file, start, end, reason).  Nothing
after a bad record is lost with it.  A WARC-Block-Digest is checked against the
block, a WARC-Payload-Digest against what follows the HTTP header if the block
is an HTTP message, else against the block; digests may be hexadecimal or
Base32, and those of unknown algorithms are not checked.  Payload digests of
revisits and of truncated or segmented records speak of other bytes and are not
checked either.

Defined cases: a null html is an empty payload; a null page_id is written as an
empty one and read back as null; control characters in a url are
percent-encoded; an empty table gives an empty archive.  Rows with the same
page_id and html are one group like any other (the row with the largest page_id
responds; if two rows tie, both are responses).  Very long payloads are written
and read whole: a task holds one file and, of a member, what it inflates to.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
#: An empty gzip member: header, an empty last block, zero checksum and length.
EMPTY = GZIP + bytes(6) + b"\xff" + b"\x03\x00" + bytes(8)
VERSION = re.compile(rb"WARC/\d\.\d{1,2}\r\n")
RECORDS = "file string, kind string, start long, end long, reason string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, payload binary"
CHUNK = 1 << 16
#: A header block is no longer.
HEADER = 1 << 20
#: A revisit's row is under 100 bytes, so a broadcast table is under 10 MB.
BROADCAST_REVISITS = 100_000
ALGORITHMS = frozenset(("md5", "sha1", "sha256", "sha512"))


def plan_records(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, responder.

    ``responder`` is the page_id of the response that a revisit refers to; null
    for responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.encode("payload", "UTF-8"))})
    large = cut(rows.where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_digest"))
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("responder"), F.count("*").alias("n"))
    groups = groups.where("n > 1").drop("n")
    revisits = cut(large.join(groups, "payload_digest").where("page_id < responder").select("page_id", "payload_digest", "responder").distinct())
    if revisits.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    return rows.join(revisits, ["page_id", "payload_digest"], "left")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, responder: int | None, date: str) -> bytes:
    """One record with its closing CRLFs."""
    ident = lambda n: f"<urn:page:{'' if n is None else n}>"
    again = responder is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {ident(page_id)}", "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", "%20", url or ""), f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {ident(responder)}"] if again else []), "Content-Type: text/html",
        f"Content-Length: {0 if again else len(payload)}",
    ]
    return "\r\n".join(lines).encode() + END + (b"" if again else payload) + END


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 8 << 20, compress: bool = True) -> None:
    """Write ``pages`` as WARC files under ``path``, each of ``file_bytes`` at
    most unless a single record is larger.  Without ``compress``, records are
    plain (and the empty member at the end is left out)."""
    kind = pa.schema([("file", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], schema=kind)
        for rows in batches:
            for row in zip(*(rows.column(c) for c in ("page_id", "url", "payload", "payload_digest", "responder"))):
                page_id, url, payload, digest, responder = (x.as_py() for x in row)
                data = record(page_id, url, payload.encode(), digest, responder, date)
                if compress:
                    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = deflate.compress(data) + deflate.flush()
                if parts and size + len(data) > file_bytes:
                    yield batch()
                    parts, size = [], 0
                parts.append(data)
                size += len(data)
        if parts:
            yield batch()

    rows = plan_records(pages).select("page_id", "url", "payload", "payload_digest", "responder")
    # bytes as they are: Spark's text writer copies a string's bytes
    files = rows.mapInArrow(run, "file binary")
    if not compress:
        files = files.select(F.expr("substring(file, 1, octet_length(file) - 4)").alias("file"))
    writer = files.select(F.col("file").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "none")
    separator = EMPTY if compress else END
    writer.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """(start, end, content, reason) of the parts of a file.

    A file is a run of gzip members, or plain records.  A member that fails its
    check yields what came out of it with a reason, and the search goes on at
    the next place where a member starts.
    """
    view = memoryview(data)
    at = 0
    while at < len(data):
        if data[at : at + 3] != GZIP:
            end = _next_member(data, at) if at or not VERSION.match(data) else len(data)
            yield at, end, data[at:end], "plain"
            at = end
            continue
        inflate, out, reason, end = zlib.decompressobj(31), [], "", at
        try:
            while not inflate.eof and end < len(data):
                chunk = view[end : end + CHUNK]
                out.append(inflate.decompress(chunk))
                end += len(chunk) - len(inflate.unused_data)
            if not inflate.eof:
                reason = "member cut short"
        except zlib.error:
            out.append(_until_damage(view, at, end))
            reason = "member fails its check"
        if reason:
            end = _next_member(data, at + 3)
        yield at, end, b"".join(out), reason
        at = end


def _next_member(data: bytes, at: int) -> int:
    """Where the next gzip member starts.  Its magic number also occurs by
    chance: the first block must inflate to the beginning of a record, or to
    nothing at all."""
    while (at := data.find(GZIP, at)) >= 0:
        try:
            inflate = zlib.decompressobj(31)
            head = inflate.decompress(data[at : at + 4096], 64)
            if VERSION.match(head) or inflate.eof and not head:
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


def _until_damage(view: memoryview, start: int, bad: int) -> bytes:
    """What the chunk at ``bad`` of a member that begins at ``start`` gives
    before its damage: the member is inflated again up to there, then byte by
    byte."""
    inflate = zlib.decompressobj(31)
    for i in range(start, bad, CHUNK):
        inflate.decompress(view[i : min(i + CHUNK, bad)])
    out = []
    try:
        for i in range(bad, min(bad + CHUNK, len(view))):
            out.append(inflate.decompress(view[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _wrong(claim: str, data: bytes) -> bool:
    """Does a digest (algorithm:value, hexadecimal or Base32) not fit?"""
    name, colon, value = claim.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ALGORITHMS:
        return False
    own, value = hashlib.new(name, data).digest(), value.strip()
    return value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


def body(head: dict[str, str], block: bytes) -> bytes:
    """The payload: what follows the header of an HTTP message."""
    if not head.get("content-type", "").lower().startswith("application/http"):
        return block
    stop = re.search(rb"\r?\n\r?\n", block)
    return block[stop.end() :] if stop else b""


def parse(data: bytes, start: int) -> tuple[dict, bytes, int] | str:
    """Header, payload and end of the record at ``start``, or why there is none."""
    line = VERSION.match(data, start)
    if not line:
        return "no version line"
    stop = data.find(END, start, start + HEADER)
    if stop < 0:
        return "header has no end"
    head, name = {}, ""
    for x in data[line.end() : stop].split(b"\r\n") if stop > line.end() else ():
        if x[:1] in (b" ", b"\t") and name:  # a folded line
            head[name] += " " + x.strip().decode("utf-8", "replace")
            continue
        raw, colon, value = x.partition(b":")
        if not colon:
            return "bad header line"
        name = raw.strip().lower().decode("latin-1")
        head[name] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "no content length"
    begin = stop + 4
    end = begin + int(length)
    if end > len(data):
        return "record cut short"
    if data[end : end + 4] != END:
        return "length does not meet the record's end"
    block = data[begin:end]
    payload = body(head, block)
    partial = head.get("warc-type", "").lower() in ("revisit", "continuation") or "warc-truncated" in head or "warc-segment-number" in head
    if _wrong(head.get("warc-block-digest", ""), block) or not partial and _wrong(head.get("warc-payload-digest", ""), payload):
        return "digest differs"
    return head, payload, end + 4


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str, dict, bytes]]:
    """("record" or "gap", start, end, reason, header, payload).

    Offsets are those of the file; within a compressed member, those of the
    member's content with the member's start in the reason.  Of a damaged member,
    records that pass their own checks are recovered but for the last one, since
    nothing vouches for its header.
    """
    for start, end, content, why in members(data):
        where = "" if why == "plain" else f"; member at {start}"
        base = start if why == "plain" else 0
        hurt = why not in ("", "plain")
        at = 0
        while at < len(content):
            got = parse(content, at)
            if hurt and not isinstance(got, str) and got[2] == len(content):
                got = "record at a damaged member's end"
            if isinstance(got, str):
                nxt = VERSION.search(content, at + 1)
                stop = nxt.start() if nxt else len(content)
                yield "gap", base + at, base + stop, got + where, {}, b""
                at = stop
            else:
                yield "record", base + at, base + got[2], where[2:], got[0], got[1]
                at = got[2]
        if hurt:
            yield "gap", start, end, why, {}, b""


def _page(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def _digest(claim: str, payload: bytes) -> str:
    """The bare hexadecimal SHA-1: as claimed, or computed."""
    name, _, value = claim.partition(":")
    if name.strip().lower().replace("-", "") == "sha1":
        value = value.strip()
        if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
            return value.lower()
        if re.fullmatch(r"[A-Za-z2-7]{32}", value):
            return base64.b32decode(value.upper()).hex()
    return hashlib.sha1(payload).hexdigest()


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of every file under ``path``, by ``kind``.

    One task reads a file at a time; rows go on in batches of 256 and of some
    megabytes, so a task holds a file, one member's content and a batch.
    """
    schema = pa.schema([("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, held, name = [], 0, file.as_py()
                for kind, start, end, reason, head, payload in salvage(content.as_py()):
                    gap = kind == "gap"
                    size = head.get("x-payload-length", "")
                    again = head.get("warc-type") == "revisit"
                    rows.append((name, kind, start, end, reason or None, _page(head.get("warc-record-id")), head.get("warc-type"), _page(head.get("warc-refers-to")), None if gap else _digest(head.get("warc-payload-digest", ""), payload), None if gap else int(size) if again and size.isdigit() else len(payload), head.get("warc-target-uri"), payload if payloads and not gap else None))
                    held += len(payload) if payloads else 0
                    if len(rows) == 256 or held > 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
