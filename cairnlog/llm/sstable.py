"""Operator 10: token ids as sorted-string-table shards.

A shard is one file, written by Spark's own text writer (so through any Hadoop file system, with its commit
protocol): data blocks, sparse index, Bloom filter, footer; each section ends with one newline byte, which
the writer adds. Keys are ordered bytes of the document identifier, prefix-compressed inside blocks.

    entry   varint shared, varint rest, varint value bytes, key rest, value (ids, fixed width, little-endian)
    index   per block: varint key length, last key, u64 offset, u32 length, u32 crc
    bloom   u8 probes, then the bits
    footer  u64 index at, u32 index length, u64 bloom at, u32 bloom length, u64 documents, u64 ids, u8 width, magic
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlog.llm import common, json_bpe
from cairnlog.llm.bpe import slices

MAGIC = b"CLTOKS1"
FOOTER = struct.Struct("<QIQIQQB7s")
BLOCK, PROBES, BITS = 32 * 1024, 7, 10


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do; a null one comes first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def probes(key: bytes, bits: int, count: int) -> list[int]:
    h = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + i * b) % bits for i in range(count)]


class Writer:
    """Gives the sections of one shard, in file order, from entries in key order."""

    def __init__(self, width: int):
        self.width, self.at, self.docs, self.ids = width, 0, 0, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", bytearray(), []

    def section(self, data: bytes) -> bytes:
        self.at += len(data) + 1
        return data

    def close_block(self) -> bytes:
        data = bytes(self.block)
        self.index += varint(len(self.last)) + self.last + struct.pack("<QII", self.at, len(data), zlib.crc32(data))
        self.block = bytearray()
        return self.section(data)

    def add(self, doc_id: int | None, value: bytes) -> Iterator[bytes]:
        key, shared = key_of(doc_id), 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.docs, self.ids = self.docs + 1, self.ids + len(value) // self.width
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if len(self.block) >= BLOCK:
            yield self.close_block()

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self.close_block()
        index_at, index = self.at, self.section(bytes(self.index))
        yield index
        size = max(64, BITS * len(self.keys)) + 7 & ~7
        bits = bytearray(size // 8)
        for key in self.keys:
            for p in probes(key, size, PROBES):
                bits[p >> 3] |= 1 << (p & 7)
        bloom_at, bloom = self.at, self.section(bytes([PROBES]) + bytes(bits))
        yield bloom
        yield FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.docs, self.ids, self.width, MAGIC)


class Shard:
    """Reads one shard by (offset, length): only footer, index and Bloom filter at first, then single blocks."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]):
        if size < FOOTER.size + 1 or (tail := read(size - FOOTER.size - 1, FOOTER.size + 1))[-1:] != b"\n":
            raise ValueError("not a complete shard")
        at, n, bloom_at, bloom_n, self.docs, self.ids, self.width, magic = FOOTER.unpack(tail[:-1])
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        index, self.read = read(at, n), read
        self.bloom = read(bloom_at, bloom_n)
        self.lasts, self.blocks = [], []
        p = 0
        while p < n:
            size, p = read_varint(index, p)
            self.lasts.append(index[p : p + size])
            self.blocks.append(struct.unpack_from("<QII", index, p + size))
            p += size + 16

    @classmethod
    def of(cls, data: bytes | memoryview) -> Shard:
        return cls(len(data), lambda at, n: bytes(data[at : at + n]))

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, crc = self.blocks[block]
        data, p, key = self.read(at, size), 0, b""
        if zlib.crc32(data) != crc:
            raise ValueError("a block's checksum is wrong")
        while p < size:
            shared, p = read_varint(data, p)
            rest, p = read_varint(data, p)
            length, p = read_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            yield key, data[p + rest : p + rest + length]
            p += rest + length

    def all(self) -> Iterator[tuple[int | None, bytes]]:
        for block in range(len(self.blocks)):
            for key, value in self.entries(block):
                yield id_of(key), value

    def may_hold(self, key: bytes) -> bool:
        bits = self.bloom[1:]
        return all(bits[p >> 3] >> (p & 7) & 1 for p in probes(key, len(bits) * 8, self.bloom[0]))

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values of one identifier: Bloom filter, binary search of the index, then the block and its followers."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        for block in range(bisect_left(self.lasts, key), len(self.blocks)):
            found = [v for k, v in self.entries(block) if k == key]
            out += found
            if self.lasts[block] != key:
                break
        return out


def write(docs: DataFrame, path: str, vocab_path: str, end_id: int, shard_bytes: int = 16_000_000) -> None:
    """Writes shards of (doc_id, ids of text, then end_id) in ascending order of doc_id under `path`.

    Null text: end_id alone. A null doc_id sorts first; repeated rows and repeated identifiers are all kept, those
    of one identifier in the order of their texts' hashes. An empty table gives no shard. Columns beyond doc_id and
    text are not read. The number of shards follows the measured size of the texts, so each can be read as one value.
    """
    rows = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = json_bpe.encoder(vocab_path), None
        width = 2 if max(enc.size, end_id + 1) <= 65536 else 4
        end, held, size = end_id.to_bytes(width, "little"), [], 0
        for batch in batches:
            for chunk in slices(batch, 1, 2_000_000):
                for doc_id, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                    out = out or Writer(width)
                    for section in out.add(doc_id, narrow(enc.encode(text), width) + end):
                        held.append(section)
                        size += len(section)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["section"])
                    held, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([*held, *out.finish()], pa.binary())], ["section"])

    sections = (
        rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(run, "section binary")
    )
    sections.select(F.col("section").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(path)


def narrow(ids: bytes, width: int) -> bytes:
    import numpy as np

    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def files(spark: SparkSession, path: str) -> DataFrame:
    """(shard int, content binary) of the shard files; the empty file of an empty table is left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, shard_start, ids binary of unsigned 32-bit little-endian ids) of every document, from the files."""
    import numpy as np

    names = ["shard", "doc_id", "shard_start", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, number = Shard.of(memoryview(batch.column(1)[k].as_buffer())), batch.column(0)[k].as_py()
                rows, size, at = [], 0, 0
                for doc_id, value in shard.all():
                    ids = value if shard.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    rows.append((number, doc_id, at, ids))
                    at, size = at + len(ids) // 4, size + len(ids)
                    if size > 1_000_000:
                        yield arrow(rows)
                        rows, size = [], 0
                if rows:
                    yield arrow(rows)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files(spark, path).mapInArrow(run, "shard int, doc_id long, shard_start long, ids binary")


class Reader:
    """Point lookups from the driver: footers, indexes and blocks are read by seeking, never whole shards. Shards are in
    ascending order of keys, so those of an identifier are found by binary search over the shards' last keys."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [(s.getPath(), s.getLen()) for s in self.fs.listStatus(root) if s.getPath().getName().startswith("part-") and s.getLen()]
        found.sort(key=lambda f: int(f[0].getName().split("-")[1].split(".")[0]))
        self.shards = [Shard(size, lambda at, n, file=file: self.bytes_at(file, at, n)) for file, size in found]
        self.lasts = [s.lasts[-1] for s in self.shards]

    def bytes_at(self, file, at: int, n: int) -> bytes:
        stream = self.fs.open(file)
        try:
            stream.seek(at)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values of one identifier, from the first shard that may hold it and those that follow while their keys do."""
        key, out = key_of(doc_id), []
        for k in range(bisect_left(self.lasts, key), len(self.shards)):
            out += self.shards[k].get(doc_id)
            if self.lasts[k] > key:
                break
        return out


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids) of a few identifiers, a row for each value found, by seeks (see Reader). For many, filter `read`."""
    reader, hits = Reader(spark, path), []
    width = reader.shards[0].width if reader.shards else 4
    for doc_id in doc_ids:
        hits += [(doc_id, [int.from_bytes(v[i : i + width], "little") for i in range(0, len(v), width)]) for v in reader.get(doc_id)]
    return spark.createDataFrame(hits, "doc_id long, ids array<int>")


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as shards, reads them back and gives each document's place, length and checksum."""
    import public_tokenizers as P

    path = common.scratch_path(spark, "token_shards")
    write(common.table(spark, sf_dir, "documents"), path, P.path("byte_bpe_50k.json"), end_id=2)
    found = read(spark, path).select("shard", "doc_id", "shard_start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    found = common.materialize(found, "shard_rows")  # so each shard is read once
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    bases = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))  # one row a shard
    return found.join(bases, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
