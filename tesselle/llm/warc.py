"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Archives are rows of a binary column, so they are written and read wherever Spark can write
and read; each holds a bounded number of records.  The layout follows WARC 1.1 and the
published .warc.zst convention: a skippable frame with magic 0x184D2A5D whose content is the
dictionary (plain or itself one Zstandard frame), then one Zstandard frame for each record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.scratch import stash

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICT_ID_BYTES = (0, 1, 2, 4)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed at this many payload bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 2 << 20, 512
#: The dictionary is trained on about this many pages of at most this many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 32_768


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def header_safe(text: str) -> bytes:
    """A header value: control characters and spaces percent-encoded, so it stays on its line."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (text or "").encode())


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP header (with the full length) and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:x-page:%s>" % (b"none" if page_id is None else b"%d" % page_id),
        b"WARC-Date: 2000-01-01T00:00:00Z",
        b"WARC-Target-URI: " + header_safe(url),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http;msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if refers_to is not None:
        head[2:2] = [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: <urn:x-page:%d>" % refers_to]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class BadArchive(ValueError):
    """An archive whose frames, headers or lengths don't agree."""


def _fields(block: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadArchive(f"{what}: not a header line: {line[:60]!r}")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _length(fields: dict[str, str], what: str) -> int:
    if not (got := fields.get("content-length", "")).isdecimal():
        raise BadArchive(f"{what}: Content-Length is {got!r}")
    return int(got)


def parse_record(record: bytes) -> dict:
    """The validated fields and the payload of one record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise BadArchive("no WARC header")
    fields = _fields(head, "WARC header")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    size = _length(fields, "WARC header")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"the block has {len(rest) - 4} bytes, its header says {size}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header")
    full = _length(_fields(http, "HTTP header"), "HTTP header")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not re.fullmatch(r"[A-Z2-7]{32}", digest):
        raise BadArchive(f"payload digest {digest!r}")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != full or base32_sha1(payload) != digest:
            raise BadArchive("the payload differs from its length or digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise BadArchive("a revisit with a payload, or without what it refers to")
    else:
        raise BadArchive(f"record type {kind!r}")
    page = lambda key: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(key, ""))) else None
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri", ""), "record_type": kind, "payload_bytes": full, "payload_digest": digest, "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


# ---------------------------------------------------------------- frames


def frame_span(data: bytes, at: int) -> tuple[int, int | None]:
    """End of the Zstandard frame at ``at`` and its content size, from the frame's headers."""
    if len(data) < at + 6 or int.from_bytes(data[at : at + 4], "little") != FRAME_MAGIC:
        raise BadArchive(f"no frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    pos = at + 5 + (not single) + DICT_ID_BYTES[flags & 3]
    width = (1 if single else 0, 2, 4, 8)[flags >> 6]
    size = int.from_bytes(data[pos : pos + width], "little") + (256 if width == 2 else 0) if width else None
    pos += width
    while True:
        if pos + 3 > len(data):
            raise BadArchive("a frame is cut off")
        block = int.from_bytes(data[pos : pos + 3], "little")
        kind, length = block >> 1 & 3, block >> 3
        if kind == 3:
            raise BadArchive("a reserved block type")
        pos += 3 + (1 if kind == 1 else length)
        if block & 1:
            break
    pos += 4 * checksum
    if pos > len(data):
        raise BadArchive("a frame is cut off")
    return pos, size


def write_archive(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
    head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return head + b"".join(packer.compress(r) for r in records)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one from each frame; skippable frames elsewhere are skipped."""
    at, shared = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        if at > len(data):
            raise BadArchive("the dictionary is cut off")
        dictionary = data[8:at]
        if int.from_bytes(dictionary[:4], "little") == FRAME_MAGIC:
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
        shared = zstandard.ZstdCompressionDict(dictionary)
    opener = zstandard.ZstdDecompressor(dict_data=shared)
    while at < len(data):
        if len(data) >= at + 8 and int.from_bytes(data[at : at + 4], "little") >> 4 == DICTIONARY_MAGIC >> 4:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        end, size = frame_span(data, at)
        try:
            record = opener.decompress(data[at:end], max_output_size=size or 1 << 30)
        except zstandard.ZstdError as e:
            raise BadArchive(f"the frame at byte {at}: {e}") from e
        if size is not None and len(record) != size:
            raise BadArchive("a frame's content differs from its stated size")
        yield record
        at = end
    if at != len(data):
        raise BadArchive("a skippable frame is cut off")


# ---------------------------------------------------------------- tables


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty if too few.

    Pages are sampled by a hash of page_id whose share follows from their count, so about
    SAMPLE_PAGES of them (at most twice as many) reach the driver, however many there are.
    """
    some = pages.filter(F.octet_length("html").between(64, SAMPLE_BYTES))
    n = some.count()
    hashed = F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(1 << 40))
    rows = some.filter(hashed < F.lit(int((1 << 40) * min(1.0, SAMPLE_PAGES / max(n, 1))))).select("page_id", "html").limit(2 * SAMPLE_PAGES).collect()
    samples = [make_record(r.page_id, "", r.html.encode(), "A" * 32, None) for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id, r.html))]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # the sample has nothing in common
        return b""


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``(archive binary, records int)``: a record for every row of ``pages``.

    Of rows with equal payloads of at least ``min_revisit_bytes``, those with the smallest
    page_id are responses and the others revisit it.  A null html is an empty payload; a
    null url an empty target; a row without page_id is a response, and rows that repeat a
    page_id and payload are alike.  Digests decide equality (SHA-1).  The first page of each
    payload that several have is found over narrow rows, combined before the shuffle, and
    written; pages are then joined to that table, so adaptive execution can split a payload that
    very many of them share.
    """
    dictionary = train_dictionary(pages)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.filter((F.octet_length("html") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(stash(first), "digest", "left").select("page_id", "url", "html", "digest", F.expr("if(page_id > first, first, null)").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_pydict({"archive": [write_archive(held, dictionary)], "records": pa.array([len(held)], pa.int32())})
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                held.append(make_record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to))
                size += len(payload)
                if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, "archive binary, records int")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record, validated; a damaged archive raises :class:`BadArchive`."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [parse_record(r) for r in read_archive(data or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return archives.select("archive").mapInArrow(run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the scratch folder and read all records back."""
    return read_archives(stash(write_archives(pages)))
