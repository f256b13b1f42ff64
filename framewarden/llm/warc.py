"""WARC archives: a writer, and a reader that salvages what is readable.

The reader cuts files into blocks and reads the records that begin in each.  A
record counts if its header parses, its length leads to the closing line ends
and its payload has the digest it names.  After a failed check the search goes
on at the next version line, or the next gzip member in ``.gz`` files, so later
records are recovered; bytes that belong to no record are logged as gaps.  A record
is kept where a digest or an HTTP header is only odd, with a remark on it.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, written

LOG = logging.getLogger(__name__)

END = b"\r\n\r\n"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
BLOCK = 16 << 20
STEP = 1 << 20
FIRST_HEADER = 1 << 16
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]+[ \t]*")
HEADER_LINE = re.compile(rb"[^\s:](?:[^:]*[^\s:])?:")
LENGTH = re.compile("[0-9]{1,18}")
# Digest algorithms and the bytes of a digest.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
# The digits of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a string or binary column."""
    digest = F.sha1(payload)
    digits = []
    for i in range(8):
        bits = F.conv(F.substr(digest, F.lit(5 * i + 1), F.lit(5)), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*digits)


def records_of(pages: DataFrame, least_revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of rows with ``page_id, url, html``.

    Of equal payloads of at least ``least_revisit_bytes`` bytes the smallest
    ``page_id``, null last, is kept; the others name it in ``refers_to``.  Rows
    that repeat an id are alike.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn(
        "digest", base32_sha1(F.col("payload"))
    )
    keys = written(
        rows.where(F.octet_length("payload") >= least_revisit_bytes).select("page_id", "digest"), "warc-keys"
    )
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    again = keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")
    # Written, so that its size is known: only a small table is broadcast to the payloads.
    again = written(again.distinct(), "warc-revisits").withColumnRenamed("page_id", "_id").withColumnRenamed("digest", "_digest")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")


def write_warc(records: DataFrame, path: str) -> None:
    """Uncompressed archives, one a task: records as lines that end in two line ends."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"),
    )
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    first = F.col("refers_to").isNull()
    block = F.when(first, F.concat(http, "payload")).otherwise(F.lit("HTTP/1.1 200 OK\r\n\r\n"))
    url = F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(first, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~first, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.when(~first, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    text = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block"))
    records.withColumn("block", block).select(text.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    payload: bytes
    stop: int
    #: What is odd about a sound record.
    remark: str | None = None


class Damaged(Exception):
    """Why the bytes at a place are no record."""


class Reads:
    """Random reads from a file through one buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, start: int, count: int) -> bytes:
        stop = min(self.size, start + count)
        if start < self.at or stop > self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(min(self.size - start, max(count, STEP)))
        return self.data[start - self.at : stop - self.at]

    def find(self, pattern: bytes, start: int, stop: int) -> int:
        """First place from ``start``, before ``stop``, where ``pattern`` begins; -1 if none does."""
        while start < stop:
            count = min(STEP, stop - start) + len(pattern) - 1
            found = self.get(start, count).find(pattern)
            if found >= 0:
                return start + found
            start += STEP
        return -1


def parsed_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise Damaged("no version line")
    out = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key.strip() or key != key.strip():
            raise Damaged("bad header line")
        out[key.lower()] = value.strip()
    if not LENGTH.fullmatch(out.get("content-length", "")) or "warc-type" not in out:
        raise Damaged("no length or type")
    return out


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, str | None]:
    """The block without an HTTP header where it has one, and a remark on a header without an end."""
    if not headers.get("content-type", "").lower().startswith("application/http") or not block:
        return block, None
    head, gap, body = block.partition(END)
    if gap:
        return body, None
    return (b"" if block.startswith(b"HTTP/") else block), "no end of the HTTP header"


def digest_agrees(named: str, data: bytes) -> bool | None:
    """Whether ``data`` has the digest ``algorithm:value`` names, in hex or base 32 of either case; None if that is unreadable."""
    algorithm, _, value = named.partition(":")
    algorithm, value = algorithm.strip().lower().replace("-", ""), value.strip()
    size = DIGESTS.get(algorithm)
    if size is None:
        return None
    bare = value.rstrip("=")
    try:
        if len(value) == 2 * size:
            wanted = bytes.fromhex(value)
        elif len(bare) == -(-8 * size // 5):
            wanted = base64.b32decode(bare + "=" * (-len(bare) % 8), casefold=True)
        else:
            return None
    except ValueError:
        return None
    return hashlib.new(algorithm, data, usedforsecurity=False).digest() == wanted


def checked(headers: dict[str, str], block: bytes, stop: int) -> Record:
    """The record of a block that has the digests its header names.

    A digest that cannot be read is a remark.  So is a payload digest that
    differs where the block digest agrees: no byte is damaged then, the writer
    meant another form of the payload.
    """
    payload, remark = payload_of(headers, block)
    remarks = [remark] if remark else []
    whole = None
    if "warc-block-digest" in headers:
        whole = digest_agrees(headers["warc-block-digest"], block)
        if whole is False:
            raise Damaged("block digest differs")
        if whole is None:
            remarks.append("unknown block digest")
    if "warc-payload-digest" in headers and headers["warc-type"].lower() != "revisit":
        same = digest_agrees(headers["warc-payload-digest"], payload)
        if same is False and not whole:
            raise Damaged("payload digest differs")
        if not same:
            remarks.append("unknown payload digest" if same is None else "payload digest differs, block digest agrees")
    return Record(headers, payload, stop, "; ".join(remarks) or None)


def header_at(window: Reads, start: int) -> bytes:
    """The header that begins at ``start``, of any length; a long one is read on while all its lines so far look like a header's."""
    count, seen, line = 1024, 0, 0
    while (cut := (head := window.get(start, count)).find(END, max(0, seen - len(END) + 1))) < 0:
        if start + count >= window.size:
            raise Damaged("no end of the header")
        if count >= FIRST_HEADER:
            while (stop := head.find(b"\r\n", line)) >= 0:
                if not (HEADER_LINE.match(head, line, stop) if line else VERSION_LINE.fullmatch(head, 0, stop)):
                    raise Damaged("no end of the header")
                line = stop + 2
            if not line:
                raise Damaged("no version line")
        seen, count = len(head), max(2 * count, FIRST_HEADER)
    return head[:cut]


def plain_record(window: Reads, start: int) -> Record:
    head = header_at(window, start)
    cut = len(head)
    headers = parsed_headers(head)
    begin = start + cut + len(END)
    stop = begin + int(headers["content-length"])
    if stop + len(END) > window.size or window.get(stop, len(END)) != END:
        raise Damaged("no line ends where the length leads")
    block = window.get(begin, stop - begin)
    return checked(headers, block, stop + len(END))


def member_record(window: Reads, start: int) -> Record:
    unpack = zlib.decompressobj(wbits=31)
    parts, at = [], start
    try:
        while not unpack.eof:
            if at >= window.size:
                raise Damaged("gzip member is cut short")
            data = window.get(at, STEP)
            parts.append(unpack.decompress(data))
            at += len(data)
    except zlib.error:
        raise Damaged("gzip member fails its check") from None
    stop = at - len(unpack.unused_data)
    content = b"".join(parts)
    cut = content.find(END)
    if cut < 0:
        raise Damaged("no end of the header")
    headers = parsed_headers(content[:cut])
    begin = cut + len(END)
    block = content[begin : begin + int(headers["content-length"])]
    if content[begin + len(block) :] != END or len(block) != int(headers["content-length"]):
        raise Damaged("length and member differ")
    return checked(headers, block, stop)


def scanned(window: Reads, start: int, stop: int, packed: bool) -> Iterator[tuple[int, Record | str]]:
    """``(place, record or fault)`` for what begins from ``start`` on, before ``stop``."""
    pattern, read = (MEMBER, member_record) if packed else (VERSION, plain_record)
    while (at := window.find(pattern, start, stop)) >= 0:
        try:
            record = read(window, at)
        except Damaged as fault:
            yield at, str(fault)
            start = at + 1
        else:
            yield at, record
            start = record.stop


def opened(path: str):
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


COLUMNS = (
    "path string, start bigint, stop bigint, fault string, warc_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, remark string, payload_bytes bigint, payload binary"
)


def blocks_of(spark: SparkSession, path: str, block: int) -> tuple[DataFrame, int]:
    """``path, length, start`` of the blocks of all files below ``path``, and how many there are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "length")
    files = files.where("length > 0")
    count = files.agg(F.sum(F.ceil(F.col("length") / block))).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(block)))
    return files.select("path", "length", starts.alias("start")), int(count)


def scan_warc(spark: SparkSession, path: str, payloads: bool = True, block: int = BLOCK) -> DataFrame:
    """One row a record or fault; a fault has only ``path``, ``start`` and ``fault``.

    Records inside another record's payload are still among the rows if a block
    begins there; ``read_warc`` drops them.
    """
    blocks, count = blocks_of(spark, path, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, size = [], 0
                with opened(row["path"]) as file:
                    window = Reads(file, row["length"])
                    stop = min(row["length"], row["start"] + block)
                    for at, got in scanned(window, row["start"], stop, row["path"].endswith(".gz")):
                        if isinstance(got, str):
                            out.append((row["path"], at, None, got, *[None] * 8))
                            continue
                        h, body = got.headers, got.payload
                        out.append((
                            row["path"], at, got.stop, None, h["warc-type"], h.get("warc-record-id"), h.get("warc-target-uri"),
                            h.get("warc-refers-to"), h.get("warc-payload-digest"), got.remark, len(body), body if payloads else None,
                        ))
                        size += len(body)
                        if size >= 8 << 20 or len(out) >= 5000:
                            yield as_batch(out)
                            out, size = [], 0
                if out:
                    yield as_batch(out)

    # A number of partitions, as so few bytes would be gathered into one task.
    return blocks.repartition(max(1, min(count, 100_000)), "path", "start").mapInArrow(run, COLUMNS)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = [text, number, number, *[text] * 7, number, pa.binary()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def with_edge(spans: DataFrame) -> DataFrame:
    """Spans and ``edge``, where the records that begin before them end."""
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("edge", F.coalesce(F.max("stop").over(earlier), F.lit(0)))


def salvaged(scan: DataFrame) -> DataFrame:
    """Records of a scan without those that lie inside another."""
    spans = scan.where("fault is null").select("path", "start", "stop")
    inside = with_edge(spans).where("start < edge").select("path", "start")
    return scan.where("fault is null").drop("fault").join(inside, ["path", "start"], "left_anti")


def quarantined(spark: SparkSession, path: str, scan: DataFrame) -> DataFrame:
    """``path, start, stop, fault`` of every gap: bytes that no record holds, with the first fault found there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "length")
    spans = scan.where("fault is null").select("path", "start", "stop")
    ends = files.select("path", F.col("length").alias("start"), F.col("length").alias("stop"))
    gaps = with_edge(spans.union(ends)).where("start > edge").select("path", F.col("edge").alias("start"), F.col("start").alias("stop"))
    faults = scan.where("fault is not null").select("path", F.col("start").alias("place"), "fault")
    within = gaps.join(faults, "path", "left").where("place is null or (place >= start and place < stop)")
    first = within.groupBy("path", "start", "stop").agg(F.min_by("fault", "place").alias("fault"))
    told = gaps.join(first, ["path", "start", "stop"], "left")
    return told.withColumn("fault", F.coalesce("fault", F.lit("nothing begins here")))


def read_warc(spark: SparkSession, path: str, payloads: bool = True, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Records and gaps of all archives below ``path``; an empty file has neither."""
    narrow = written(scan_warc(spark, path, False, block), "warc-scan")
    gaps = quarantined(spark, path, narrow)
    if not payloads:
        return salvaged(narrow), gaps
    inside = with_edge(narrow.where("fault is null").select("path", "start", "stop")).where("start < edge")
    full = scan_warc(spark, path, True, block).where("fault is null").drop("fault")
    return full.join(inside.select("path", "start"), ["path", "start"], "left_anti"), gaps


def page_of(name: str) -> Column:
    return F.regexp_extract(name, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")


def archived_pages(pages: DataFrame, least_revisit_bytes: int = 0) -> DataFrame:
    """Pages written as archives and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A null html is an empty payload, a null url an empty address; an empty table
    gives an empty one; repeated rows stay.  A revisit has the size of the record
    it refers to.  Gaps of the archives are written to a table ``warc-gaps`` in the
    shared folder, empty if all is sound, and told in the log.
    """
    spark = pages.sparkSession
    path = fresh(spark, "warc")
    write_warc(records_of(pages, least_revisit_bytes), path)
    records, gaps = read_warc(spark, path, payloads=False)
    gaps = written(gaps, "warc-gaps")
    lost = gaps.agg(F.count("*").alias("gaps"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    if lost["gaps"]:
        LOG.warning("%d gaps of %d bytes in %s, listed in %s", lost["gaps"], lost["bytes"], path, gaps.inputFiles()[:1])
    found = records.select(
        page_of("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page_of("refers_to").alias("refers_to"),
    )
    kept = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(
        F.max("payload_bytes").alias("_bytes")
    )
    again = found.where("record_type = 'revisit'").join(
        kept, F.col("refers_to").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type = 'response'").select(columns).union(
        again.withColumn("payload_bytes", F.col("_bytes")).select(columns)
    )
