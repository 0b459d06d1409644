"""64-bit hashes of the words and word shingles of whole texts, from Arrow buffers, without a memo."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from cairnlog.llm import common

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in common.SPACE]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low n bytes of a lane of eight.
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 256  # bytes from which on a word is hashed on its own


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; offsets start at 0."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a hash of each word `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; text i has words first[i]:first[i + 1]."""
    data, offsets = text_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    low = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, data, out=low[:n])
    inside = ~_SPACE[data]
    opens = np.empty(n, bool)
    opens[0], opens[1:] = True, ~inside[:-1]
    opens[offsets[:-1][offsets[:-1] < n]] = True  # a text begins
    starts = np.flatnonzero(opens & inside)
    closes = np.empty(n, bool)
    closes[-1], closes[:-1] = True, opens[1:] | ~inside[1:]
    ends = np.flatnonzero(closes & inside) + 1
    first = np.searchsorted(starts, offsets)
    size = ends - starts
    lanes = np.ndarray((n + 1,), "<u8", low, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * _STEP)
        open_, at = np.arange(len(starts)), 0
        while len(open_) and at < LONG:
            lane = lanes[starts[open_] + at] & _LANE[np.minimum(size[open_] - at, 8)]
            h[open_] = mix(h[open_] * _STEP + lane)
            at += 8
            open_ = open_[size[open_] > at]
    for k in open_.tolist():
        h[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]].tobytes())
    return h, first


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its word shingles. A text of fewer words than `width` is one shingle;
    one without words has none."""
    h, first = hash_words(column)
    many = max(0, len(h) - width + 1)
    with np.errstate(over="ignore"):
        whole = np.full(many, width, np.uint64)
        for k in range(width):
            whole = mix(whole * _STEP + h[k : k + many])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield distinct(whole[a : b - width + 1])
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    one = mix(one * _STEP + h[k : k + 1])
                yield one
            else:
                yield np.zeros(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]
