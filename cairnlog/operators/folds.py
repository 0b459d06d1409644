"""Cutting an ordered log into pieces by a size that resets, in parallel.

The rule: a row opens a new piece when the open piece already holds `limit` or more. Because the size resets and the
overshoot is lost, this is no division of a running sum. It still runs in parallel: from any opening row the next one
is found by binary search, so a partition can tell, for every size it might be entered with, the size it leaves with.
Such answers fall into few intervals. The driver chains them over the partitions (a few numbers each), and a second
pass numbers the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cairnlog.sources.scratch import fixed

KEY = "pid int, lo long, hi long, pieces long, left long, total long, n long"


def starts_of(sizes: np.ndarray, entered: int, limit: int) -> np.ndarray:
    """Rows that open a piece, given the size of the piece that is open before the first row."""
    before = np.concatenate(([0], np.cumsum(sizes)))[: len(sizes)]
    out, at = [], int(np.searchsorted(before, limit - entered))
    while at < len(sizes):
        out.append(at)
        at = max(at + 1, int(np.searchsorted(before, before[at] + limit)))
    return np.array(out, dtype=np.int64)


def behaviour(sizes: np.ndarray, limit: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, pieces, left): entered with lo..hi open, the partition opens so many pieces and leaves so much open."""
    n = len(sizes)
    before = np.concatenate(([0], np.cumsum(sizes)))
    total = int(before[-1])
    after = np.maximum(np.searchsorted(before[:-1], before[:-1] + limit), np.arange(n) + 1)
    first = min(n, int(np.searchsorted(before[:-1], limit)) + 1)
    pieces, left = np.ones(n, np.int64), total - before[:-1]
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            pieces[i], left[i] = pieces[after[i]] + 1, left[after[i]]
    out: list[tuple[int, int, int, int]] = []
    for i in range(first):  # entered with limit - before[i] or more, and less than what row i - 1 needs
        lo = max(0, limit - int(before[i]))
        hi = (1 << 62) if i == 0 else limit - int(before[i - 1]) - 1
        if lo > hi:
            continue
        if out and (out[-1][2], out[-1][3]) == (int(pieces[i]), int(left[i])):
            out[-1] = (lo, *out[-1][1:])
        else:
            out.append((lo, hi, int(pieces[i]), int(left[i])))
    return out


def reset_pieces(df: DataFrame, order: list[str], size: str, limit: int, name: str = "piece") -> DataFrame:
    """Adds `name` (long, from 0) to every row of `df`, cut in the order of `order` (which must be unique).

    Sizes must not be null or negative. An empty table gives an empty result."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    # Bounds come from a sample, which a second job would draw anew. Where many shuffle partitions are set, Spark joins
    # small ones, so a partition follows the bytes; its sizes (8 bytes a row) are held by one task.
    dealt = fixed(dealt)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, pid = [], -1
        for b in batches:
            if len(b):
                sizes.append(b[size].to_numpy(np.int64))
                pid = int(b["_pid"].iloc[0])
        if sizes:
            s = np.concatenate(sizes)
            yield pd.DataFrame([(pid, *r, int(s.sum()), len(s)) for r in behaviour(s, limit)] or [(pid, 0, -1, 0, 0, int(s.sum()), len(s))], columns=KEY.replace(" int", "").replace(" long", "").split(", "))

    told: dict[int, list] = {}
    for r in dealt.select(size, "_pid").mapInPandas(probe, KEY).collect():  # intervals of partitions, not rows
        told.setdefault(r.pid, []).append(r)
    entry, open_size, pieces = {}, 0, 0
    for pid in sorted(told):
        entry[pid] = (open_size, pieces)
        hit = next((r for r in told[pid] if r.lo <= open_size <= r.hi), None)
        open_size, pieces = (hit.left, pieces + hit.pieces) if hit else (open_size + told[pid][0].total, pieces)
    known = spark.sparkContext.broadcast(entry)
    names = df.columns

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, piece = None, 0
        for b in batches:
            if not len(b):
                continue
            if held is None:
                held, piece = known.value[int(b["_pid"].iloc[0])]
            s = b[size].to_numpy(np.int64)
            opens = np.zeros(len(b), np.int64)
            at = starts_of(s, held, limit)
            opens[at] = 1
            held = int(s[at[-1] :].sum()) if len(at) else held + int(s.sum())
            out = b[names].copy()
            out[name] = piece + np.cumsum(opens)
            piece += len(at)
            yield out

    return dealt.mapInPandas(number, StructType([*df.schema.fields, StructField(name, LongType())]))
