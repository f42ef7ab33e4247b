"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle file ends in a skippable frame with the seek table of
the public seekable format, so a reader needs the footer and one frame to get a record. The index table maps each record
identifier to (bundle, frame, offset in the frame, length). Bundles are written by the tasks that read the rows, under
random names; only bundles that the committed index names count, so a lost executor or a repeated task does no harm.
Payloads are not shuffled unless the table of repeated payloads is too large to broadcast.

Equal payloads: the record with the largest id is a response, the others are revisits of it without a payload of their own.
Rows with the same id and payload as that one are responses too. Payloads shorter than min_revisit_bytes are all responses.
Edge cases: a null payload is an empty one; a null id sorts lowest, is written as such and comes back null; a null URL is
written empty; an empty table gives an empty index and no bundle; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, new_path, shuffle_partitions, small, write_table

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Repeated payloads up to which their table (digest and id) is broadcast: about 40 MB.
REPEATED_ROWS = 200_000
#: Fixed values of the seekable format: skippable frame magic, seek table magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "id long, bundle string, frame int, frame_start long, offset long, length long"
RECORD = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def record_urn(digest: str, key: int | None) -> str:
    """The record's identifier: a UUID made from its payload's digest and its id, so a revisit can name its response."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{digest}:{key}')}"


def record_bytes(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z", sha: bytes | None = None) -> bytes:
    """One WARC/1.1 record; the block is a minimal HTTP message, which in a revisit has no body. sha: the payload's SHA-1, if known."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    digest = base64.b32encode(sha or hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_urn(digest, key)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Record-Key: {'null' if key is None else key}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_urn(digest, refers_to)}>", f"X-Refers-To-Key: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a frame; a response's digest and length are those of the payload read, not of its header."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, length = end + 4, int(head["Content-Length"])
        block = data[start : start + length]
        body = block[block.index(b"\r\n\r\n") + 4 :]
        key = head["X-Record-Key"]
        revisit = head["WARC-Type"] == "revisit"
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and digest32(body) != digest:
            raise ValueError(f"record {key}: the payload does not have its digest")
        yield {
            "id": None if key == "null" else int(key), "url": head["WARC-Target-URI"], "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(body), "payload_digest": digest,
            "record_type": head["WARC-Type"], "refers_to": int(head["X-Refers-To-Key"]) if revisit else None, "payload": None if revisit else body,
        }
        at = start + length + 4


class Bundle:
    """Writes one bundle file: frames, then the seek table."""

    def __init__(self, folder: str):
        import zstandard

        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.system, path = open_fs(self.uri)
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.packer = self.system.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.table, self.written, self.frame, self.rows = [], 0, bytearray(), []

    def add(self, key: int | None, record: bytes) -> None:
        self.rows.append((key, self.uri, len(self.table), self.written, len(self.frame), len(record)))
        self.frame += record
        if len(self.frame) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.frame:
            packed = self.packer.compress(bytes(self.frame))
            self.out.write(packed)
            self.table.append((len(packed), len(self.frame)))
            self.written += len(packed)
            self.frame = bytearray()

    def close(self) -> list[tuple]:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        return self.rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, packed bytes, bytes) of each frame, from the end of a random-access file."""
    size = file.size()
    file.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * frames)
    found, start = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * frames)):
        found.append((start, packed, plain))
        start += packed
    return found


def read_record(bundle: str, frame_start: int, offset: int, length: int) -> dict:
    """One record, by its row of the index: reads and unpacks the one frame that holds it."""
    import zstandard

    system, path = open_fs(bundle)
    with system.open_input_file(path) as file:
        start, packed, plain = next(x for x in seek_table(file) if x[0] == frame_start)
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    return next(parse_records(data[offset : offset + length]))


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """id, url, payload, refers_to (which record each one revisits, or null) and sha, the payload's SHA-1 in hexadecimal."""
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = source.withColumn("sha", F.sha1("payload"))
    repeated = keyed.where(F.length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.max("id").alias("winner"), F.count("*").alias("n")).where("n > 1").select("sha", "winner")
    repeated, _ = write_table(repeated, "warc-repeated")
    joined = keyed.join(small(repeated, REPEATED_ROWS), "sha", "left")
    revisit = F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner")) & (F.length("payload") >= min_revisit_bytes)
    return joined.select("id", "url", "payload", F.when(revisit, F.col("winner")).alias("refers_to"), "sha")


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Writes the archives and their index (Parquet, beside them) under folder; returns the index as read back.

    folder is by default a new one in the shared folder; date is every record's WARC-Date (UTC, ISO 8601), now by default.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    bundles = f"{folder}/bundles"
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    names = ["id", "bundle", "frame", "frame_start", "offset", "length"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for key, url, payload, other, sha in zip(*(batch.column(k) for k in range(5)), strict=True):
                bundle = bundle or Bundle(bundles)
                other = other.as_py()
                bundle.add(key.as_py(), record_bytes(key.as_py(), url.as_py(), payload.as_py(), other, other is not None, date, bytes.fromhex(sha.as_py())))
                if bundle.written >= BUNDLE_BYTES:
                    yield rows(bundle.close())
                    bundle = None
        if bundle:
            yield rows(bundle.close())

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    map_arrow(plan_records(pages, id_col, url_col, payload_col, min_revisit_bytes), pack, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_warc(spark: SparkSession, index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles that the index names, frame by frame; fails on a payload that lacks its digest."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                system, path = open_fs(bundle)
                with system.open_input_file(path) as file:
                    for start, packed, plain in seek_table(file):
                        file.seek(start)
                        found = list(parse_records(zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)))
                        yield table(found)

    def table(found: list[dict]) -> pa.RecordBatch:
        kinds = {"id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        if not payloads:
            kinds.pop("payload")
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in kinds.items()], list(kinds))

    # An explicit number of partitions stays as it is: small as the list is, each bundle is a task's work.
    files = index.select("bundle").distinct().repartition(shuffle_partitions(spark))
    return map_arrow(files, unpack, RECORD if payloads else RECORD.rpartition(",")[0])
