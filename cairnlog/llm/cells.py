"""Counts of 64-bit keys that are looked up from blocks of documents without a row for each key.

A block's sorted keys are cut by key range into cells, one packed row for each block and range. The cells of a range
meet its counts in one task, which answers each with the counts in the same order; a block gets its answers back in
the order of ranges, so they lie beside its sorted keys. What is shuffled is about two bytes a key, and the number of
ranges grows with what is counted, so a task holds a bounded part of the counts at any size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, kind int, chunk long, keys binary, n binary"
NAMES = ["part", "kind", "chunk", "keys", "n"]
KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
_HEAD = struct.Struct("<IBI")
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as compressed planes of their bytes, as many as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return _HEAD.pack(len(x), width, len(planes)) + (_CODEC.compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes) -> np.ndarray:
    n, width, size = _HEAD.unpack_from(data)
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = _CODEC.decompress(data[_HEAD.size :], size, asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray, shift: int) -> bytes:
    """Sorted distinct keys whose low `shift` bits are zero."""
    return pack(np.diff(keys >> np.uint64(shift), prepend=np.uint64(0)))


def unpack_keys(data: bytes, shift: int) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64) << np.uint64(shift)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of each key, in order of keys; parts < 2^31."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cells_of(keys: np.ndarray, counts: np.ndarray | None, kind: int, chunk: int, shift: int, parts: int) -> Iterator[tuple]:
    """Rows of SCHEMA for sorted distinct keys; without counts they ask."""
    part = part_of(keys, parts)
    found, first = np.unique(part, return_index=True)
    ends = np.append(first, len(keys))[1:]
    for p, a, b in zip(found.tolist(), first.tolist(), ends.tolist(), strict=True):
        yield p, kind, chunk, pack_keys(keys[a:b], shift), None if counts is None else pack(counts[a:b])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)


def answer(counts: DataFrame, asked: DataFrame, shifts: tuple[int, ...]) -> DataFrame:
    """SCHEMA rows of `asked` with n: the summed counts of their keys, 0 for keys that are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, sums = None, {}, {}
        for batch in batches:
            rows, size = [], 0
            for p, kind, chunk, keys, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if p != part:
                    part, held, sums = p, {}, {}
                x = unpack_keys(keys, shifts[kind])
                if n is not None:
                    held.setdefault(kind, []).append((x, unpack(n)))
                    continue
                if kind not in sums:
                    sums[kind] = summed(held.pop(kind, []))
                known, c = sums[kind]
                at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                found = np.where(known[at] == x, c[at], 0) if len(known) else np.zeros(len(x), np.uint64)
                rows.append((p, kind, chunk, b"", pack(found)))
                size += len(x)
                if size > 1_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    both = counts.unionByName(asked).withColumn("asks", F.col("n").isNull())
    return both.repartition("part").sortWithinPartitions("part", "asks", "kind").select(*NAMES).mapInArrow(run, SCHEMA)


def summed(cells: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not cells:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys, n = (np.concatenate([c[k] for c in cells]) for k in range(2))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)
