"""WARC archives compressed with Zstandard: one frame per record, a dictionary in a leading skippable frame.

An archive is: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then a frame for each record. Writing goes
through Spark's text sink with one archive per file: the committer copes with lost executors and any file system works.
The sink closes a file with its line separator, which is set to an empty skippable frame, so files stay valid.

Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is a response and the others
revisit it; rows that share that smallest id are all responses. A null html is an empty payload; a null page_id is
written as ``null``, comes after all others as the smallest, and is read back as null.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, slices, small, with_possible

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
#: A dictionary is trained on the first records of its archive, up to this many bytes.
SAMPLE_BYTES = 1 << 20
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_SKIPPABLE = "P*M\x18\0\0\0\0"
FRAME_MAGIC = 0xFD2FB528
RECORD_COLUMNS = "record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


class BadArchive(ValueError):
    """The archive breaks the format."""


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that carries the headers alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = (url or "").encode().replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%s>" % str("null" if page_id is None else page_id).encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + uri, b"WARC-Payload-Digest: sha256:" + digest.encode()]
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """The dictionary's skippable frame and a frame for each record."""
    sample, size = [], 0
    for record in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(record[: SAMPLE_BYTES // 8])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(512, size // 8)), sample).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: the first one's bytes serve as a raw dictionary
        trained = sample[0][:DICTIONARY_BYTES] if sample else b""
    shared = zstandard.ZstdCompressionDict(trained) if len(trained) >= 8 else None
    packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(trained)), trained, *map(packer.compress, records)])


def frame_end(data: bytes, start: int) -> int:
    """Where the frame at ``start`` ends, from its block headers alone."""
    if start + 8 > len(data):
        raise BadArchive("truncated frame")
    magic, size = struct.unpack_from("<II", data, start)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = start + 8 + size
    else:
        if magic != FRAME_MAGIC:
            raise BadArchive(f"no frame at byte {start}")
        flags = data[start + 4]
        single = flags >> 5 & 1
        end = start + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise BadArchive("truncated block")
            head = int.from_bytes(data[end : end + 3], "little")
            last, kind = head & 1, head >> 1 & 3
            if kind == 3:
                raise BadArchive("reserved block type")
            end += 3 + (1 if kind == 1 else head >> 3)
        end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise BadArchive("truncated frame")
    return end


def parse_record(record: bytes) -> dict:
    """Check a record's version, headers, lengths and digest, and take it apart."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != b"WARC/1.1":
        raise BadArchive("not a WARC/1.1 record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"bad header {line[:60]!r}")
        headers[name.strip().lower().decode()] = value.strip().decode()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing or not headers["content-length"].isdigit():
        raise BadArchive(f"missing or bad headers {sorted(missing)}")
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise BadArchive("block length differs from Content-Length")
    http, mark, payload = block.partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or len(lengths) != 1 or not lengths[0].isdigit():
        raise BadArchive("bad HTTP headers")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if headers["warc-type"] == "response":
        if len(payload) != int(lengths[0]) or hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("payload differs from its length or digest")
    elif headers["warc-type"] != "revisit" or payload or "warc-refers-to" not in headers:
        raise BadArchive("bad record type or revisit")
    uri = headers.get("warc-target-uri", "").replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return {"record_type": headers["warc-type"], "record_id": headers["warc-record-id"], "refers_to": headers.get("warc-refers-to"), "target_uri": uri, "payload_bytes": int(lengths[0]), "payload_digest": digest, "payload": payload if headers["warc-type"] == "response" else None}


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive, decoded frame by frame; at most one record is decoded at a time."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise BadArchive("no leading dictionary frame")
    at = frame_end(data, 0)
    stored = data[8:at]
    if stored[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
        stored = zstandard.ZstdDecompressor().decompress(stored)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored) if len(stored) >= 8 else None)
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] == FRAME_MAGIC:
            frame = data[at:end]
            size = zstandard.frame_content_size(frame)
            record = unpacker.decompress(frame)
            if size >= 0 and len(record) != size:
                raise BadArchive("frame differs from its content size")
            yield parse_record(record)
        at = end


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, _digest and _first (the page that this one revisits, or null).

    Hot payloads are pre-aggregated. The table of repeated payloads is broadcast where it is small; beyond that, pages that
    a Bloom filter rules out stay where they are.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    large = F.octet_length("html") >= MIN_REVISIT_BYTES
    groups = rows.filter(large).groupBy(digest.alias("_same")).agg(F.min("page_id").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _least is not null").drop("_n")
    groups, hashed, alone = checkpointed(groups), rows.withColumn("_digest", digest), None
    if groups.count() > BROADCAST_ROWS:
        parted = with_possible(hashed, F.col("_digest"), groups, "_same")
        hashed, alone = parted.filter("_possible"), parted.filter("not _possible").select("page_id", "url", "html", "_digest", F.lit(None).cast("long").alias("_first"))
    joined = hashed.join(small(groups), F.col("_digest") == F.col("_same"), "left")
    out = joined.select("page_id", "url", "html", "_digest", F.when(~F.col("page_id").eqNullSafe(F.col("_least")), F.col("_least")).alias("_first"))
    return out if alone is None else out.unionByName(alone)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each page; an archive is closed once its payloads reach four times ``archive_bytes``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([build_archive(records)], pa.binary())], ["value"])

        for batch in slices(batches):
            columns = [batch.column(x).to_pylist() for x in ("page_id", "url")] + [batch.column("html").cast(pa.binary()).to_pylist()] + [batch.column(x).to_pylist() for x in ("_digest", "_first")]
            for page_id, url, html, digest, first in zip(*columns, strict=True):
                records.append(build_record(page_id, url, html, digest, first))
                size += len(records[-1])
                if size >= 4 * archive_bytes:
                    yield closed()
                    records, size = [], 0
        if records:
            yield closed()

    archives = with_revisits(pages).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    archives.write.mode("error").option("maxRecordsPerFile", 1).option("lineSep", EMPTY_SKIPPABLE).text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``folder``: RECORD_COLUMNS. Without ``payloads`` they are checked but not returned."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows, size = [], 0
                for record in read_archive(content) if len(content) else ():
                    if not payloads:
                        record["payload"] = None
                    rows.append(record)
                    size += 1000 + len(record["payload"] or b"")
                    if size > 4 << 20:
                        yield pd.DataFrame(rows)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInPandas(unpack, RECORD_COLUMNS)


def archived_pages(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write, read back, and give page_id, payload_bytes, payload_digest, record_type and refers_to of every record."""
    write_archives(pages, folder)

    def number(name: str):
        return F.regexp_extract(name, r"<urn:page:(-?\d+)>", 1).try_cast("long")

    return read_archives(spark, folder, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
