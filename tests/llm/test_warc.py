"""The reader on usual archives, on damage of every kind, and on many members."""

import base64
import gzip
import hashlib
import random
import time
import zlib

from gridweave.llm import warc


def record(block, **fields):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "Content-Length": len(block), **{k.replace("_", "-"): v for k, v in fields.items()}}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def kinds(data):
    return [(k, why) for k, _, _, why, _, _ in warc.salvage(data)]


def test_digests_of_usual_archives():
    page = b"<p>hello</p>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    b32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    http = {"Content_Type": "application/http; msgtype=response"}
    good = [
        record(block, WARC_Payload_Digest=f"sha1:{b32(page)}", WARC_Block_Digest=f"sha1:{b32(block)}", **http), record(block, WARC_Payload_Digest=f"SHA-256:{hashlib.sha256(page).hexdigest()}", **http),
        record(page, WARC_Payload_Digest=f"sha1:{hashlib.sha1(page).hexdigest().upper()}"), record(page, WARC_Payload_Digest="blake3:00"), record(page, WARC_Payload_Digest="nonsense"),
        record(b"", WARC_Type="revisit", WARC_Payload_Digest=f"sha1:{b32(page)}"), record(page[:5], WARC_Truncated="length", WARC_Payload_Digest=f"sha1:{b32(page)}"), record(page, X_Folded="a\r\n b"),
    ]
    assert kinds(b"".join(good)) == [("record", "")] * len(good)
    got = [p for *_, p in warc.salvage(b"".join(good[:3]))]
    assert got == [page] * 3 and warc._digest(f"sha1:{b32(page)}", b"") == hashlib.sha1(page).hexdigest()
    for bad in (record(block, WARC_Block_Digest=f"sha1:{b32(page)}", **http), record(block, WARC_Payload_Digest=f"sha1:{b32(block)}", **http), record(page, WARC_Payload_Digest="md5:00")):
        assert kinds(bad + good[0]) == [("gap", "digest differs"), ("record", "")]


def test_time_is_linear_in_members():
    one = gzip.compress(record(b"x" * 200))
    start = time.perf_counter()
    assert sum(k == "record" for k, _ in kinds(one * 40_000)) == 40_000
    assert time.perf_counter() - start < 10
    start = time.perf_counter()
    kinds(b"WARC/1.1\r\n" * 20_000)
    kinds(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nno end" * 5_000)
    kinds((warc.GZIP + b"\x00") * 20_000)
    assert time.perf_counter() - start < 10


def test_random_damage_costs_only_what_it_touches(spark, tmp_path):
    rows = [(k, "u", f"page {k} " + "word " * (k % 50)) for k in range(400)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = sorted((tmp_path / "w").glob("part-*"))
    whole = b"".join(f.read_bytes() for f in files)
    assert whole.endswith(warc.EMPTY) and zlib.decompressobj(31).decompress(warc.EMPTY) == b""
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 400
    spans = [(a, b) for a, b, content, _ in warc.members(whole) if content]
    rng = random.Random(2)
    for _ in range(20):
        data = bytearray(whole)
        hurt = set()
        for _ in range(5):
            at = rng.randrange(len(data))
            data[at] ^= 1 << rng.randrange(8)
            hurt.add(at)
        lost = {k for k, (a, b) in enumerate(spans) if any(a <= x < b for x in hurt)}
        got = {warc._page(h["warc-record-id"]) for kind, _, _, _, h, _ in warc.salvage(bytes(data)) if kind == "record"}
        assert got >= set(range(400)) - lost


def test_large_records_make_files_of_their_own(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, "u", "".join(rng.choice("abcdefghijklmnop") for _ in range(n))) for k, n in enumerate((10, 50_000, 20, 50_001, 30))]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, file_bytes=10_000)
    assert len(list((tmp_path / "w").glob("part-*"))) == 5
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read_warc(spark, path).collect()} == {(k, t) for k, _, t in rows}
