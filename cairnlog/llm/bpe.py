"""Operator 6: byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece exactly one token can be the last of its encoding. `PrefixEncoder` stores
that token for every prefix: the longest token t ending there for which (last token of the rest, t) is a
pair that merging leaves alone. The array answers appends exactly (only new prefixes are computed) and
re-encodes after an edit from the edited byte on, inside the pieces that the edit touches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnlog.llm import common, pieces

_OPEN: dict[str, "PrefixEncoder"] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken rank file: base64 token, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """Encodes byte pieces by the ranks, one last token per prefix."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pair_limit: int = 2_000_000):
        self.ranks, self.pattern, self.pair_limit = ranks, pattern, pair_limit
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Gives all tokens that end at each byte, the longest first.
        self.tokens = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.tokens.add_word(token.decode("latin-1"), (i, len(token)))
        self.tokens.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._whole: dict[bytes, int] = {}
        self.memo = pieces.Memo(lambda piece: self.encode_piece(piece.encode()))

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition that pairs are checked against."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: bytes) -> int:
        """The token's id if merging its own bytes gives it back, else -1."""
        got = self._whole.get(token)
        if got is None:
            i = self.ranks.get(token, -1)
            got = self._whole[token] = i if i >= 0 and self.merge(token) == [i] else -1
        return got

    def stable(self, a: int, b: int) -> bool:
        """Whether merging leaves the pair (a, b) as it is."""
        key = a << 32 | b
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) >= self.pair_limit:
                self._pairs.clear()
            got = self._pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Appends to `last` (id of the last token of each prefix of `data`) what is missing for all prefixes."""
        stable, at = self._pairs.get, len(last)
        left = [i << 32 for i in last]
        for stop, (i, size) in self.tokens.iter(data.decode("latin-1"), max(0, at + 1 - self.longest)):
            if stop < at:  # this prefix has its token: an entry of before, or a longer one
                continue
            start = stop - size
            if start >= 0:  # a stable pair's second token comes out of its own bytes
                ok = stable(left[start] | i)
                if ok is None:
                    ok = self.stable(last[start], i)
                if not ok:
                    continue
            elif size > 2 and self.reachable(data[: stop + 1]) < 0:
                continue
            last.append(i)
            left.append(i << 32)
            at += 1
        if at < len(data):
            raise ValueError("the vocabulary lacks a single byte")
        return last

    def read_back(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of the whole of `data`, following last tokens from its end."""
        out, end = [], len(data)
        while end:
            i = last[end - 1]
            out.append(i)
            end -= len(self.bytes_of[i])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.read_back(piece, self.extend(piece, []))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit bytes."""
        return self.memo.ids(pieces.split(text, self.pattern))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditablePiece:
    """One piece with its prefix table: exact appends, and edits that keep the table before the edited byte."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, encoder.extend(data, [])

    def append(self, more: bytes) -> list[int]:
        self.data += more
        self.encoder.extend(self.data, self.last)
        return self.ids()

    def edit(self, start: int, end: int, new: bytes) -> list[int]:
        """Replaces bytes start:end; prefixes that end at or before `start` keep their entries."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]
        self.encoder.extend(self.data, self.last)
        return self.ids()

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.data)
        return [whole] if whole is not None else self.encoder.read_back(self.data, self.last)


def encoder(path: str, pattern: str) -> PrefixEncoder:
    """One encoder per worker process and vocabulary."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = PrefixEncoder(load_ranks(path), pattern)
    return _OPEN[path, pattern]


def list_column(parts: list[bytes]) -> pa.ListArray:
    """Arrow list<int32> of id runs."""
    offsets, at = [0], 0
    for p in parts:
        at += len(p) // 4
        offsets.append(at)
    values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids array<int>) of every whole text; with `decoded` also the bytes that the ids give back.

    Null text: no ids. Null ids of rows and repeated rows stay as they are; other columns are not read. Empty table:
    empty result. A long text is one row of its own length."""
    names = [id_col, "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for chunk in slices(batch, 1, 4_000_000):
                ids = [enc.encode(t) if t else b"" for t in chunk.column(1).to_pylist()]
                back = [pa.array([enc.decode(np.frombuffer(i, "<u4").tolist()) for i in ids], pa.binary())] * decoded
                yield pa.RecordBatch.from_arrays([chunk.column(0), list_column(ids), *back], names)

    own = StructType([docs.schema[id_col]])
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, common.with_columns(own, "ids array<int>" + ", decoded binary" * decoded))


def slices(batch: pa.RecordBatch, column: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `limit` bytes at most, one row at least: bounds memory."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Adds decoded (binary), the bytes of `ids`. Null ids: null."""
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder(path, pattern).bytes_of.__getitem__
        for batch in batches:
            col = batch.column(at)
            offs, flat = np.asarray(col.offsets), np.asarray(col.values)
            out = []
            for k in range(len(col)):
                out.append(b"".join(map(bytes_of, flat[offs[k] : offs[k + 1]].tolist())) if col[k].is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return common.map_arrow(encoded, run, common.with_columns(encoded.schema, "decoded binary"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents by the many-language ranks; digests of ids and decoded bytes."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(common.table(spark, sf_dir, "documents"), path, P.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
