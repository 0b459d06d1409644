"""The byte formats of a change log and of its requests, as rows.

    log record  u32 payload CRC-32C, u32 payload length, u32 CRC-32C of those 8 bytes (all little-endian), payload
    payload     u8 op (1 put, 2 delete), uvarint key length, key, value
    request     u8 op (1 get, 2 put, 3 delete), u64 id (big-endian), uvarint key length, key, value
    response    u8 status (0 ok, 1 not found, 2 error), u64 id (big-endian), value
    frame       u32 length (big-endian), at most 16 MiB, then a request or response
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.sources.checksum import crc32c, read_uvarint, uvarint

HEADER, MOST = 12, 16 << 20
LOG_SCHEMA = "file string, pos long, op int, key binary, value binary"


class Corrupt(ValueError):
    """Bytes that are no torn tail and no record."""


def record(op: int, key: bytes, value: bytes) -> bytes:
    payload = bytes([op]) + uvarint(len(key)) + key + value
    head = struct.pack("<II", crc32c(payload), len(payload))
    return head + struct.pack("<I", crc32c(head)) + payload


def payload_of(data: bytes) -> tuple[int, bytes, bytes]:
    if not data or data[0] not in (1, 2):
        raise Corrupt("unknown operation")
    try:
        size, at = read_uvarint(data, 1)
    except ValueError as e:
        raise Corrupt(str(e)) from e
    if size > len(data) - at:
        raise Corrupt("the key is longer than the record")
    return data[0], data[at : at + size], data[at + size :]


def replay(data: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(pos, op, key, value) of a whole log file. A tail that was cut off, or whose remaining bytes are all zero after
    a bad checksum, ends the log; any other damage raises Corrupt."""
    at = 0
    while at + HEADER <= len(data):
        crc, size, own = struct.unpack_from("<III", data, at)
        start = at + HEADER
        if crc32c(data[at : at + 8]) != own:
            return torn(data, at, start)
        if start + size > len(data):
            return None
        payload = data[start : start + size]
        if crc32c(payload) != crc:
            return torn(data, at, start + size)
        yield (at, *payload_of(payload))
        at = start + size
    return None


def torn(data: bytes, at: int, rest: int) -> None:
    if data[rest:].strip(b"\x00"):
        raise Corrupt(f"damaged record at {at}")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, op, key, value) of every log file under `path` (names `000001.wal`), each file in one task.

    Order of changes: file name, then pos. Log files are small (they rotate), so each fits a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "pos", "op", "key", "value"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, *r) for r in replay(content.as_py())]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content").mapInArrow(run, LOG_SCHEMA)


def request(op: int, number: int, key: bytes, value: bytes = b"") -> bytes:
    return bytes([op]) + struct.pack(">Q", number) + uvarint(len(key)) + key + value


def request_of(data: bytes) -> tuple[int, int, bytes, bytes]:
    """(id, op, key, value)"""
    if len(data) < 9 or not 1 <= data[0] <= 3:
        raise Corrupt("malformed request")
    try:
        size, at = read_uvarint(data, 9)
    except ValueError as e:
        raise Corrupt(str(e)) from e
    if size > len(data) - at:
        raise Corrupt("malformed request")
    return struct.unpack_from(">Q", data, 1)[0], data[0], data[at : at + size], data[at + size :]


def response(status: int, number: int, value: bytes = b"") -> bytes:
    return bytes([status]) + struct.pack(">Q", number) + value


def response_of(data: bytes) -> tuple[int, int, bytes]:
    """(id, status, value)"""
    if len(data) < 9 or data[0] > 2:
        raise Corrupt("malformed response")
    return struct.unpack_from(">Q", data, 1)[0], data[0], data[9:]


def frame(data: bytes) -> bytes:
    if len(data) > MOST:
        raise ValueError("a frame holds 16 MiB at most")
    return struct.pack(">I", len(data)) + data


def frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise Corrupt("a frame is cut off")
        size = struct.unpack_from(">I", data, at)[0]
        if size > MOST:
            raise Corrupt("a frame is too long")
        if at + 4 + size > len(data):
            raise Corrupt("a frame is cut off")
        yield data[at + 4 : at + 4 + size]
        at += 4 + size


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(id decimal(20,0), op, key, value) of files of framed requests; an id may use all 64 bits."""
    from decimal import Decimal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [request_of(f) for f in frames(content.as_py())]
                cols = [[Decimal(r[0]) for r in rows], *([r[k] for r in rows] for k in (1, 2, 3))]
                kinds = [pa.decimal128(20, 0), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "op", "key", "value"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "id decimal(20,0), op int, key binary, value binary")
