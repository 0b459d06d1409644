"""Operator 8: approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and fall
to the nearest signed axis. Every row is indexed in each of several tables. A query probes the axes nearest to it
in each table; its candidates are reranked by exact Euclidean distances in double precision on the original
vectors, inside blocks of bounded size, and only each block's nearest leave it. Probes follow the width and how far
norms differ, and queries that meet fewer than k rows scan all rows of their width, in the same blocks.

Hashing sees directions only, so it prunes as far as neighbours lie nearer than others: of vectors without structure
(neighbours at a cosine of 0.45 in 64 dimensions, as in the given tables) a query still meets half of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlog.llm import common

TABLES, PROBES, PER_WIDTH, GROWTH, BLOCK = 8, 14, 64, 1.4, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of rows whose width is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation of unit rows, padded to a power of two, for one table."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    if width > x.shape[1]:
        x = np.hstack([x, np.zeros((len(x), width - x.shape[1]))])
    rng = np.random.default_rng([seed, table, width])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def axes(x: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes of each unit row, nearest first."""
    y = rotate(x, table, seed)
    signed = np.hstack([y, -y])
    if probes == 1:
        return np.argmax(signed, axis=1)[:, None]
    probes = min(probes, signed.shape[1])
    near = np.argpartition(-signed, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(signed, near, 1), axis=1, kind="stable"), 1)


def probes_of(width: int, probes: int = PROBES) -> int:
    """As large a share of the axes as `probes` are at a width of PER_WIDTH; more where axes separate less."""
    width = 1 << max(0, (width - 1).bit_length())
    return max(probes, math.ceil(probes * (width / PER_WIDTH) ** GROWTH))


def norm_spread(rows: DataFrame) -> float:
    """Standard deviation of the logarithms of the norms of `rows` (v)."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    got = rows.agg(F.stddev_pop(F.log(F.greatest(square, F.lit(1e-300))) / 2)).first()[0]
    return got if got is not None and math.isfinite(got) else 0.0


def usable(v: str) -> Column:
    """Not null, not zero, no null and no non-finite component."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(v).isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(v, lambda x: x != 0)


def hashed(rows: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """(id, v, width, tab, axis): each row once per table and probe. Vectors keep their own element type."""
    kind = rows.schema["v"].dataType.simpleString()
    names = ["id", "v", "width", "tab", "axis"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = pa.Table.from_batches([batch.slice(start, 2000)])
                size = np.array([len(v) for v in part["v"]])
                for width in np.unique(size):
                    own = part.filter(pa.array(size == width)).combine_chunks()
                    x = vectors(own["v"])
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for tab in range(tables):
                        at = axes(x, tab, seed, probes if probes == 1 else probes_of(int(width), probes))
                        again = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
                        taken = own.take(again)
                        n = taken.num_rows
                        extra = [pa.array(np.full(n, c, np.int32)) for c in (width, tab)] + [pa.array(at.ravel().astype(np.int32))]
                        yield from pa.table([taken["id"], taken["v"], *extra], names=names).to_batches()

    return rows.select("id", "v").mapInArrow(run, f"id long, v {kind}, width int, tab int, axis int")


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query (id, v) among `rows` (id, v), but itself.

    Nearest first, ties to the smaller id; all rows if there are fewer than k. Vectors that are null, zero or hold null or
    non-finite components take no part; nor do rows with a null id; vectors meet those of their own width only. Of
    equal vectors only the k + 1 least ids can be among anyone's k nearest, so the others are left out of the index
    (by a window limit that works before the shuffle); repeated rows count once. Empty tables give an empty result.
    Columns beyond id and v are not read, whatever their names.
    Blocks bound each task: a bucket is dealt out by row and by query, however hot it is.
    """
    of = lambda d: d.schema["v"].dataType.elementType.typeName()
    kind = "array<float>" if of(rows) == of(queries) == "float" else "array<double>"  # half the bytes to shuffle, where exact
    clean = lambda d: d.where(F.col("id").isNotNull() & usable("v")).select("id", F.col("v").cast(kind).alias("v"))
    rows, queries = clean(rows).dropDuplicates(["id", "v"]), clean(queries).dropDuplicates(["id", "v"])
    probes = math.ceil(probes * (1 + min(2.0, 2 * norm_spread(rows))))
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    rows = rows.withColumn("copy", first).where(F.col("copy") <= k + 1).drop("copy")
    base = common.materialize(hashed(rows, tables, 1, seed), "ann_index")
    asked = common.materialize(hashed(queries, tables, probes, seed), "ann_probes")

    def run(t: pa.Table) -> pa.Table:
        is_q, ids, x = np.asarray(t["q"]), np.asarray(t["id"]), vectors(t["v"])
        q, c, qi, ci = x[is_q], x[~is_q], ids[is_q], ids[~is_q]
        out: list[tuple] = []
        for start in range(0, len(q), 256):
            a, ai = q[start : start + 256], qi[start : start + 256]
            d = (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * a @ c.T
            d[ai[:, None] == ci[None, :]] = np.inf
            if len(c) > k:
                limit = np.partition(d, k - 1, axis=1)[:, k - 1]
                limit = limit + 1e-9 * (1 + np.abs(limit))
            else:
                limit = np.full(len(a), np.finfo(np.float64).max)
            i, j = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            s = np.sqrt(((a[i] - c[j]) ** 2).sum(1))
            order = np.lexsort((ci[j], s, i))
            i, j, s = i[order], j[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < k
            out.append((ai[i[keep]], ci[j[keep]], s[keep]))
        cols = [np.concatenate([o[n] for o in out]) if out else np.zeros(0) for n in range(3)]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def met(base: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
        rb = base.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("rb"))
        qb = asked.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("qb"))
        counts = rb.join(qb, key)  # at most 2 x width x tables rows
        spread = lambda d, own, other: d.join(counts, key).select(
            *key, F.pmod(F.xxhash64("id"), own).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), "id", "v"
        )
        both = spread(base, "rb", "qb").withColumn("q", F.lit(False)).unionByName(spread(asked, "qb", "rb").withColumn("q", F.lit(True)))
        return both.groupBy(*key, "rb", "qb").applyInArrow(run, "query_id long, vec_id long, score double")

    found = common.materialize(met(base, asked, ["width", "tab", "axis"]), "ann_found")
    common.discard(base, asked)
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    few = queries.join(enough, queries["id"] == enough["query_id"], "left_anti")
    sized = lambda d: d.withColumn("width", F.size("v"))
    found = found.unionByName(met(sized(rows), sized(few), ["width"]))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every row whose vec_id is divisible by 100."""
    rows = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(rows.where(F.col("id") % 100 == 0), rows)
