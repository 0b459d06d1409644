"""Tables of a levelled store as rows: ranges, overlap, choice of compactions, merge and garbage collection.

A row of `tables` is (level, num, lo, hi, bytes, n): level 0 tables overlap and the higher num is newer; those of a
deeper level are disjoint. Metadata is one row a table, so theta joins between tables stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.operators import folds, versions

L0_TRIGGER, L1_BYTES, MULTIPLIER = 4, 8_000, 10


def ranges(rows: DataFrame, *by: str) -> DataFrame:
    """lo, hi, n and bytes of each table."""
    size = F.sum(F.octet_length("k") + F.octet_length("v")).cast("long")
    return rows.groupBy(*by).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"), size.alias("bytes"))


def overlaps(a: str, b: str):
    return (F.col(f"{a}.lo") <= F.col(f"{b}.hi")) & (F.col(f"{a}.hi") >= F.col(f"{b}.lo"))


def overlapping(tables: DataFrame, key: str) -> DataFrame:
    """Pairs of tables whose closed ranges meet."""
    pair = tables.alias("a").join(tables.alias("b"), (F.col(f"a.{key}") < F.col(f"b.{key}")) & overlaps("a", "b"))
    return pair.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def is_bottom(tables: DataFrame, level: int, inputs: DataFrame) -> DataFrame:
    """One row: no table below `level` meets the merged range of `inputs` (deletes included in the range)."""
    merged = inputs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("m")
    below = tables.where(F.col("level") > level).alias("t")
    return merged.join(below, overlaps("m", "t"), "left").agg((F.count("t.level") == 0).alias("bottom"))


def collect_garbage(merged: DataFrame, bottom: DataFrame) -> DataFrame:
    """Drops deletes from merged rows only if nothing deeper can hold the key."""
    return merged.crossJoin(F.broadcast(bottom)).where(~(F.col("bottom") & (F.col("op") == versions.DELETE))).drop("bottom")  # one row


def candidates(tables: DataFrame, probe: DataFrame) -> DataFrame:
    """(k, level, num) that a lookup visits: all of level 0, and of each deeper level the first table with hi >= k."""
    top = probe.crossJoin(F.broadcast(tables.where("level = 0").select("level", "num")))  # level 0 is a handful of tables
    deep = tables.where("level > 0").select("level", "num", "hi").alias("t")
    first = probe.join(deep, F.col("t.hi") >= F.col("k")).groupBy("k", "level").agg(F.min_by("num", "hi").alias("num"))
    return top.select("k", "level", "num").unionByName(first)


def level_bytes(tables: DataFrame) -> DataFrame:
    return tables.groupBy("level").agg(F.count("*").alias("tables"), F.sum("bytes").cast("long").alias("bytes"))


def pick(levels: DataFrame) -> DataFrame:
    """(level) to compact: 0 at its trigger, else the shallowest of 1 to 5 over its limit; no row if none is due."""
    limit = F.lit(L1_BYTES) * F.pow(F.lit(MULTIPLIER), F.col("level") - 1)
    due = F.when(F.col("level") == 0, F.col("tables") >= L0_TRIGGER).otherwise((F.col("bytes") > limit) & F.col("level").between(1, 5))
    return levels.where(due).agg(F.min("level").alias("level")).where("level IS NOT NULL")


def round_robin(tables: DataFrame, cursor: str) -> DataFrame:
    """(level, num): the first table beyond the cursor, else the level's first."""
    rank = F.struct((F.col("hi") <= cursor).alias("wrapped"), "hi", "num")
    return tables.groupBy("level").agg(F.min_by("num", rank).alias("num"))


def rotate(log: DataFrame, limit: int) -> DataFrame:
    """Memtable rotations: a change that finds `limit` bytes or more opens the next segment (batches of one)."""
    rows = log.select("seq", (F.octet_length("k") + F.octet_length("v")).cast("long").alias("b"))
    cut = folds.reset_pieces(rows, ["seq"], "b", limit, "segment")
    return cut.groupBy("segment").agg(F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq"), F.sum("b").cast("long").alias("bytes"))


def output_cuts(merged: DataFrame, table_bytes: int) -> DataFrame:
    """Output tables of a merge: closed once keys, values and 4 bytes an entry reach `table_bytes`."""
    rows = merged.select("k", (F.octet_length("k") + F.octet_length("v") + 4).cast("long").alias("b"))
    cut = folds.reset_pieces(rows, ["k"], "b", table_bytes, "num")
    return cut.groupBy("num").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"), F.sum("b").cast("long").alias("bytes"))


def trivial_move(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """One row: exactly one upper table and no lower one in its range, so only metadata moves."""
    hit = upper.alias("u").join(lower.alias("l"), overlaps("u", "l"), "left")
    return hit.agg(F.countDistinct("u.num").alias("upper"), F.countDistinct("l.num").alias("lower")).select(
        "upper", "lower", ((F.col("upper") == 1) & (F.col("lower") == 0)).alias("move")
    )
