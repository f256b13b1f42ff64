"""Archives and URL filters."""

import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from framewarden.llm import url_filters, warc
from framewarden.llm.common import fresh


def page(name, payload, kind="response", digest=None):
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def put(spark, name, data):
    path = fresh(spark, "archives").removeprefix("file:")
    import os

    os.makedirs(path)
    with open(f"{path}/{name}", "wb") as f:
        f.write(data)
    return path


def read(spark, path, block):
    records, gaps = warc.read_warc(spark, path, block=block)
    found = sorted((warc_id[10:-1], bytes(p), a, b) for warc_id, p, a, b in records.select("record_id", "payload", "start", "stop").collect())
    return found, sorted((g.start, g.stop, g.fault) for g in gaps.collect())


def damaged_archive(packed):
    rng = random.Random(1)
    good = [page(i, bytes(rng.choices(range(256), k=rng.randint(0, 400)))) for i in range(8)]
    good[2] = page(2, b"before\r\n\r\n" + page("nested", b"inside") + b"after")
    if packed:
        good = [gzip.compress(g, mtime=0) for g in good]
    broken = bytearray(good[5])
    broken[len(broken) // 2] ^= 255
    parts = [b"junk ", *good[:4], b"WARC/1.0\r\nno length\r\n\r\n", good[4], bytes(broken), good[6], good[7], good[1][:-9]]
    at, spans = 0, []
    for i, p in enumerate(parts):
        if i in (1, 2, 3, 4, 6, 8, 9):
            spans.append((at, at + len(p)))
        at += len(p)
    return b"".join(parts), spans, at


def test_salvage_of_plain_and_packed_archives(spark):
    for packed, name in ((False, "a.warc"), (True, "a.warc.gz")):
        data, spans, end = damaged_archive(packed)
        edges = [0, *[x for s in spans for x in s], end]
        want_gaps = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
        path = put(spark, name, data)
        for block in (97, 1000, 1 << 20):
            found, gaps = read(spark, path, block)
            assert [f[0] for f in found] == ["0", "1", "2", "3", "4", "6", "7"]
            assert sorted(f[2:] for f in found) == spans
            assert [g[:2] for g in gaps] == want_gaps
            assert all(fault for _, _, fault in gaps)
    assert read(spark, put(spark, "empty.warc", b""), 100) == ([], [])


def test_wrong_digest_is_quarantined(spark):
    data = page(1, b"abc") + page(2, b"xyz", digest="A" * 32) + page(3, b"def")
    found, gaps = read(spark, put(spark, "b.warc", data), 1 << 20)
    assert [f[0] for f in found] == ["1", "3"] and [g[2] for g in gaps] == ["payload digest differs"]


def record(name, content, kind="response", mime="application/http; msgtype=response", **digests):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\nContent-Type: {mime}\r\n"
    head += "".join(f"WARC-{k.title()}-Digest: {v}\r\n" for k, v in digests.items())
    return f"{head}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"


def test_odd_but_sound_records_are_rows(spark):
    http, body = b"HTTP/1.1 200 OK\r\n\r\n", b"body"
    sha1, sha256 = hashlib.sha1(body), hashlib.sha256(body)
    b32 = lambda h: base64.b32encode(h.digest()).decode()
    whole = "sha1:" + b32(hashlib.sha1(http + body))
    sound = {  # name: (record, payload, remark)
        0: (record(0, b"", "revisit", payload="sha1:" + "A" * 32), b"", None),
        1: (record(1, b"HTTP/1.1 200 OK\r\n"), b"", "no end of the HTTP header"),
        2: (record(2, b"no HTTP at all"), b"no HTTP at all", "no end of the HTTP header"),
        3: (record(3, http + body, payload="sha1:" + sha1.hexdigest()), body, None),
        4: (record(4, http + body, payload="SHA1:" + b32(sha1).lower()), body, None),
        5: (record(5, http + body, payload="sha-256:" + b32(sha256), block=whole), body, None),
        6: (record(6, http + body, payload="md5:" + hashlib.md5(body).hexdigest().upper()), body, None),
        7: (record(7, http + body, payload="crc32:1234", block="sha1:short"), body, "unknown block digest; unknown payload digest"),
        8: (record(8, http + body, payload="sha1:" + "A" * 32, block=whole), body, "payload digest differs, block digest agrees"),
        9: (record(9, b"plain", "resource", "text/plain", block="sha1:" + b32(hashlib.sha1(b"plain"))), b"plain", None),
    }
    broken = [
        record(20, http + body, block="sha256:" + sha256.hexdigest()), record(21, http + body, payload="md5:" + "0" * 32),
        record(22, b"", "revisit", block="sha1:" + "A" * 32), record(23, b"").replace(b"Length: 0", "Length: ²".encode()),
        record(24, b"").replace(b"Length: 0", b"Length: " + b"9" * 5000),
    ]
    for pack, name in ((bytes, "d.warc"), (gzip.compress, "d.warc.gz")):
        data, spans = b"", []
        for part in [x for pair in zip((r for r, _, _ in sound.values()), broken * 2) for x in pair]:
            packed = pack(part)
            if part not in broken:
                spans.append((len(data), len(data) + len(packed)))
            data += packed
        records, gaps = warc.read_warc(spark, put(spark, name, data), block=400)
        got = {int(r.record_id[10:-1]): (bytes(r.payload), r.remark) for r in records.collect()}
        assert got == {k: v[1:] for k, v in sound.items()}
        ends = [*[a for a, _ in spans[1:]], len(data)]
        assert sorted((g.start, g.stop) for g in gaps.collect()) == [(stop, start) for (_, stop), start in zip(spans, ends)]
        assert {g.fault for g in gaps.collect()} == {"block digest differs", "payload digest differs", "no length or type"}


def test_pages_round_trip(spark):
    rows = [(3, "u", "abc"), (1, "v\r\nz", "abc"), (2, None, None), (None, "w", ""), (5, "é", "é\r\n\r\nWARC/1.0\r\nx"), (7, "é", "é\r\n\r\nWARC/1.0\r\nx"),
            (8, "l", "y" * 300_000), (9, "u", "WARC/1.1\r\nWARC-Type: x\r\n"), (9, "u", "WARC/1.1\r\nWARC-Type: x\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    first = {}
    for i, _, html in rows:
        h = html or ""
        first[h] = i if h not in first or first[h] is None else first[h] if i is None else min(first[h], i)

    def want(least):
        out = []
        for i, _, html in rows:
            raw = (html or "").encode()
            again = len(raw) >= least and i != first[html or ""]
            out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
        return sorted(out, key=repr)

    for least in (0, 10):
        assert sorted(map(tuple, warc.archived_pages(pages, least).collect()), key=repr) == want(least)
    assert warc.archived_pages(pages.where("page_id > 99")).count() == 0


def test_pages_with_long_urls_round_trip(spark):
    urls = {1: "u", 2: "data:," + "x" * 200_000, 3: "http://h/" + "é: " * 1_000_000, 4: "y" * 65_400, 5: "z" * 200_000}
    rows = [(i, url, "same" if i in (2, 5) else f"page {i}") for i, url in urls.items()]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        (1, 6, "response", None), (2, 4, "response", None), (3, 6, "response", None), (4, 6, "response", None), (5, 4, "revisit", 2),
    ]


def test_long_headers_of_damaged_archives(spark):
    long = page(2, b"long").replace(b"WARC-Type", b"WARC-Target-URI: " + b"u" * 300_000 + b"\r\nWARC-Type", 1)
    no_header = b"WARC/1.0\r\nno header line\r\n" + b"t" * 100_000
    data = page(1, b"abc") + no_header + long + b"WARC/1.0" + b"s" * 200_000 + page(3, b"def") + b"WARC/1.0\r\nWARC-Type: " + b"q" * 100_000
    for block in (50_000, 1 << 20):
        found, gaps = read(spark, put(spark, "c.warc", data), block)
        assert [f[0] for f in found] == ["1", "2", "3"] and len(gaps) == 3


def test_url_filters_follow_dates(spark):
    events = [
        ("ads", "d:x.org", "add", 10), ("ads", "d:x.org", "add", 12), ("ads", "d:x.org", "remove", 20), ("ads", "d:x.org", "remove", 20),
        ("ads", "d:x.org", "add", 30), ("bad", "d:a.x.org", "remove", 5), ("bad", "d:a.x.org", "add", 15), ("bad", "p:y.org/f/", "add", 0),
        ("bad", "d:z.org", "add", 7), ("bad", "d:z.org", "remove", 7), ("bad", None, "add", 1), ("bad", "d:y.org", "odd", 1),
    ]
    listed = spark.createDataFrame(events, "list string, entry string, action string, at bigint")
    captures = [
        (1, "http://x.org/", 9), (2, "http://x.org/", 10), (3, "https://u@A.X.org.:80/q?x#y", 19), (4, "http://a.x.org", 20), (5, "http://a.x.org", 30),
        (6, "http://nox.org", 40), (7, "http://y.org/f/g", 1), (8, "http://y.org/f", 1), (9, "http://y.org/fx/f/", 1), (10, None, 1), (11, "http://x.org", None),
        (12, "no url", 1), (13, "http://z.org", 7), (2, "http://x.org/", 10), (None, "http://z.org", 6), (14, "http://" + "a." * 200 + "x.org", 10),
    ]
    table = spark.createDataFrame(captures, "capture_id bigint, url string, fetched_at bigint").withColumn("entry", F.lit(0)).withColumn("lists", F.lit(0))
    rows = url_filters.filter_captures(table, listed).collect()
    assert len(rows) == len(captures)
    got = {r.capture_id: (r.lists, r.blocked) for r in rows}
    none = ([], False)
    assert got == {
        1: none, 2: (["ads"], True), 3: (["ads", "bad"], True), 4: (["bad"], True), 5: (["ads", "bad"], True), 6: none, 7: (["bad"], True), 8: none,
        9: none, 10: none, 11: none, 12: none, 13: (["bad"], True), None: none, 14: (["ads"], True),
    }
    assert url_filters.filter_captures(table.where("capture_id > 99"), listed).count() == 0
    assert not any(r.blocked for r in url_filters.filter_captures(table, listed.where("at > 99")).collect())
