"""Operator 10: WARC archives, written and read one gzip member per record.

An archive is a run of records; each record is a gzip member of its own, so a reader can start at any
member.  Archives are rows of a table (archive, data): Spark's own writer puts them on whatever store the
session uses, and a lost task is simply written again.  ``read_warc`` takes the same bytes from files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: format of WARC/1.1 ---
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

ARCHIVES = "archive string, data binary"
RECORDS = (
    "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, intact boolean"
)
CHUNK = 1 << 16


class BadArchive(ValueError):
    """The bytes are not a whole archive: broken member, missing header or short block."""


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs)


def record(kind: str, page_id, url, payload: bytes, digest: str, refers_to=None, level: int = 6) -> bytes:
    """One record as a gzip member.  A revisit carries the HTTP header of its payload but no payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    )
    block = http + b"\r\n" + (payload if kind == "response" else b"")
    pairs = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", EPOCH),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", "sha256:" + digest),
    ]
    if url is not None:
        pairs.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        pairs += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    pairs.append(("Content-Length", str(len(block))))
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n" + _headers(pairs) + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member in turn, inflated piece by piece."""
    at = 0
    view = memoryview(data)
    while at < len(view):
        inflate = zlib.decompressobj(31)
        out = []
        while not inflate.eof:
            piece = view[at : at + CHUNK]
            if not piece:
                raise BadArchive("the last member ends early")
            try:
                out.append(inflate.decompress(piece))
            except zlib.error as e:
                raise BadArchive(f"broken member at byte {at}: {e}") from e
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        key, found, value = line.partition(b":")
        if found:
            out[key.decode().strip().lower()] = value.decode().strip()
    return out


def holds(field: str | None, data: bytes) -> bool | None:
    """Whether a digest field (algorithm and value, in hexadecimal or base 32) is that of the bytes; None without a known one."""
    name, _, value = (field or "").partition(":")
    if name.lower() not in ("sha256", "sha1", "md5", "sha512") or not value:
        return None
    made = hashlib.new(name.lower(), data).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def _page(record_id: str) -> int | None:
    """The page of a record that was written here, else None."""
    own = record_id.strip("<>")
    number = own.removeprefix(ID_PREFIX)
    return int(number) if own.startswith(ID_PREFIX) and re.fullmatch(r"-?[0-9]+", number) else None


def parse(content: bytes) -> dict:
    """One record of any writer: its fields, framed by Content-Length, with the digests that it names checked.

    ``page_id`` and ``refers_to`` are null where the record ids are not those of ``write_archives``; ``record_id`` has the id as it
    stands.  ``intact`` is null if the record has no digest.
    """
    head, found, rest = content.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise BadArchive("a member without a record header")
    fields = _fields(head)
    length = int(fields.get("content-length", "-1"))
    if length < 0 or len(rest) < length or rest[length:] not in (b"\r\n\r\n", b""):
        raise BadArchive("the block is not as long as its header says")
    block = rest[:length]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    checks = [holds(fields.get("warc-block-digest"), block)]
    if kind == "response":
        checks.append(holds(fields.get("warc-payload-digest"), payload))
    known = [c for c in checks if c is not None]
    record_id = fields.get("warc-record-id", "")
    size = _fields(http).get("content-length", "")
    return {
        "page_id": _page(record_id),
        "record_id": record_id.strip("<>") or None,
        "url": unquote(fields["warc-target-uri"].strip("<>")) if "warc-target-uri" in fields else None,
        "payload_bytes": int(size) if size.isdigit() else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"),
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to", "")),
        "payload": payload if kind == "response" else None,
        "intact": all(known) if known else None,
    }


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which page is a response and which one revisits it.

    Of pages with equal payloads of at least ``least`` bytes the smallest page_id is the response.  The
    choice is made on (digest, page_id) rows alone: minima are combined before the shuffle and the join
    back carries no html.  A null html is the empty payload; a null page_id is always a response; repeated
    rows of the smallest page_id are all responses.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    keys = pages.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select(
        "page_id", digest.alias("digest")
    )
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = (
        keys.join(first, "digest")
        .filter("page_id > first")
        .select(F.col("page_id").alias("page"), F.col("digest").alias("of"), F.col("first").alias("refers_to"))
        .distinct()
    )
    same = (F.col("page_id") == F.col("page")) & (F.col("digest") == F.col("of"))
    return pages.withColumn("digest", digest).join(later, same, "left").drop("page", "of")


def write_archives(
    pages: DataFrame, least: int = 100, archive_bytes: int = 8 << 20, level: int = 4
) -> DataFrame:
    """(archive, data): a WARC record per page, in archives of about ``archive_bytes`` compressed bytes.

    ``least`` is the smallest payload that may be a revisit.  Archives are filled in the order of the
    partition; a record is never split, so one huge page is an archive of its own.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            data = b"".join(held)
            name = hashlib.sha256(data).hexdigest()[:24] + ".warc.gz"
            return pa.RecordBatch.from_pydict({"archive": [name], "data": [data]})

        for batch in batches:
            for row in batch.to_pylist():
                kind = "response" if row["refers_to"] is None else "revisit"
                body = row["html"].encode()
                held.append(record(kind, row["page_id"], row["url"], body, row["digest"], row["refers_to"], level))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held.clear()
                    size = 0
        if held:
            yield archive()

    return plan_records(pages, least).mapInArrow(fill, ARCHIVES)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of (archive, data) rows, in order; ``intact`` says that both digests hold.

    A null or empty archive gives no rows; bytes that are not a whole archive raise ``BadArchive``.
    Records other than responses and revisits are passed over.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("data"):
                rows, size = [], 0
                for content in members(cell.as_py() or b""):
                    row = parse(content)
                    if row["record_type"] not in ("response", "revisit"):
                        continue
                    rows.append(row)
                    size += len(content)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return archives.select("data").mapInArrow(read, RECORDS)


SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
        ("intact", pa.bool_()),
    ]
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``.warc.gz`` files on any store that Spark reads."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")))
