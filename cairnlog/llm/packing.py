"""Operator 4: hierarchical multi-length packing of token sequences.

Each partition packs its own documents, so nothing is shuffled. A document gives whole windows of the longest
tier; its rest is routed to the smallest tier that holds it. Tiers are packed from long to short: a window opens
with its tier's longest rest, its gap is filled from shorter rests (best fit), and what still gapes is closed by
cutting one more. What is left at the end of a partition is cut at powers of two, which need no padding.
Finished windows are dealt to step groups of equal load.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import common, json_bpe
from cairnlog.llm.bpe import slices

TIERS = (2048, 1024, 512, 256)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"


class Packer:
    """Packs the pieces of one partition. A rest is (length, number, doc_id, start, doc_tokens, ids)."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, slack: int = 8, step_tokens: int = 65_536):
        self.tiers, self.slack, self.step_tokens = sorted(tiers, reverse=True), slack, step_tokens
        self.base, self.sequences, self.groups, self.number = base, 0, 0, 0
        self.rests: list[tuple] = []
        self.done: list[tuple[int, list[tuple]]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned 32-bit little-endian."""
        top, n = self.tiers[0], len(ids) // 4
        whole = n // top * top
        for start in range(0, whole, top):
            self.done.append((top, [(top, 0, doc_id, start, n, ids[start * 4 : (start + top) * 4])]))
        if n > whole:
            self.put((n - whole, 0, doc_id, whole, n, ids[whole * 4 :]))
        self.held += n

    def put(self, rest: tuple) -> None:
        self.number += 1
        insort(self.rests, (rest[0], self.number, *rest[2:]))

    def split(self, rest: tuple, n: int) -> tuple:
        """Cuts off the first n ids; the others go back."""
        length, _, doc_id, start, total, ids = rest
        self.put((length - n, 0, doc_id, start + n, total, ids[n * 4 :]))
        return (n, 0, doc_id, start, total, ids[: n * 4])

    def fill(self, size: int, slack: int) -> list[tuple]:
        """Rests that fill a window of `size` but for `slack`; fewer only if no rest is left."""
        window, gap = [], size
        while gap > slack and self.rests:
            at = bisect_right(self.rests, (gap, float("inf")))
            if at:
                rest = self.rests.pop(at - 1)
                short = gap - rest[0]
                if window and slack < short < self.rests_least():
                    if self.rests and self.rests[-1][0] > gap:  # one cut closes the window instead
                        self.rests.insert(at - 1, rest)
                        rest = self.split(self.rests.pop(at), gap)
            else:
                rest = self.split(self.rests.pop(0), gap)
            window.append(rest)
            gap -= rest[0]
        return window

    def rests_least(self) -> int:
        return self.rests[0][0] if self.rests else 0

    def flush(self, last: bool = False) -> Iterator[tuple]:
        """Packs what is held; all of it if `last`."""
        left = sum(r[0] for r in self.rests)
        for k, size in enumerate(self.tiers):
            floor = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            while left >= size and self.rests and self.rests[-1][0] > floor:
                window = self.fill(size, self.slack if k == 0 else 0)
                self.done.append((size, window))
                left -= sum(r[0] for r in window)
        if last:
            size = self.tiers[0]
            while left:
                while size > left:
                    size //= 2
                self.done.append((size, self.fill(size, 0)))
                left -= size
        self.held = left
        yield from self.emit()

    def emit(self) -> Iterator[tuple]:
        """Deals finished windows, longest tier first, each to the least loaded step group."""
        count = max(1, sum(size for size, _ in self.done) // self.step_tokens)
        loads = [(0, self.groups + g) for g in range(count)]
        for size, window in sorted(self.done, key=lambda d: -d[0]):
            load, group = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, group))
            sequence, at = self.base + self.sequences, 0
            self.sequences += 1
            for length, _, doc_id, start, total, ids in window:
                yield (doc_id, start, length, total, sequence, at, size, self.base + group, ids)
                at += length
        self.groups += count
        self.done = []


def pack(docs: DataFrame, vocab_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, buffer: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, tier, step_group, ids (binary).

    Null or empty text: the end id alone. Null doc_ids and repeated rows are packed like others; an empty table
    gives no piece; columns beyond doc_id and text are not read. A long text is cut into whole windows. Memory is
    bounded by `buffer` ids and one document. Windows of the longest tier may lack up to 8 ids; shorter windows
    are full, and the last ones of a partition have lengths that are powers of two. sequence_id and step_group
    hold the partition in their upper bits.
    """
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]

    def arrow(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        if rows := list(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = json_bpe.encoder(vocab_path), end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 36, tiers)
        for batch in batches:
            for chunk in slices(batch, 1):
                for doc_id, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, enc.encode(text) + end)
                    if packer.held >= buffer:
                        yield from arrow(packer.flush())
        yield from arrow(packer.flush(last=True))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    import public_tokenizers as P

    pieces = pack(common.table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
