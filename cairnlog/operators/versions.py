"""The change log and what newest-wins gives from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PUT, DELETE = 1, 2


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, k, v) of the events table: an error is a delete, any other event a put. seq is unique."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    gone = F.col("event_type") == "error"
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, DELETE).otherwise(PUT).cast("int").alias("op"),
        F.col("user_id").cast("string").alias("k"),
        F.when(gone, "").otherwise(F.concat_ws(":", "event_type", F.col("event_id").cast("string"))).alias("v"),
    )


def newest(log: DataFrame, *key: str, rank: str | Column = "seq") -> DataFrame:
    """One row per key: op and value of the highest rank, deletes included. Combines before the shuffle."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    kept = [c for c in ("seq", "op", "v") if c in log.columns]
    return log.groupBy(*key).agg(F.max_by(F.struct(*kept), rank).alias("w")).select(*key, "w.*")


def live(log: DataFrame) -> DataFrame:
    """The live image: newest version per key, then deletes away (never before the merge)."""
    return newest(log, "k").where(F.col("op") == PUT).select("k", "v")


def get(log: DataFrame, key: str) -> DataFrame:
    """Point lookup: the key filter reaches the scan, since it is on the grouping key."""
    return live(log.where(F.col("k") == key))


def multi_get(log: DataFrame, probe: DataFrame) -> DataFrame:
    """(k, found, v) of each probed key; only probed keys are aggregated."""
    wanted = probe.select("k").distinct()
    hits = live(log.join(wanted, "k", "left_semi"))
    return wanted.join(hits, "k", "left").select("k", F.col("v").isNotNull().alias("found"), "v")


def live_by_anti_join(log: DataFrame) -> DataFrame:
    """The live image as newest puts without a later delete of the key."""
    puts = log.where(F.col("op") == PUT).groupBy("k").agg(F.max_by(F.struct("seq", "v"), "seq").alias("p"))
    gone = log.where(F.col("op") == DELETE).groupBy(F.col("k").alias("dk")).agg(F.max("seq").alias("dseq"))
    return puts.join(gone, (F.col("k") == F.col("dk")) & (F.col("dseq") > F.col("p.seq")), "left_anti").select("k", "p.v")


def as_of(log: DataFrame, seq: Column | int) -> DataFrame:
    """The live image after the change numbered `seq`."""
    return live(log.where(F.col("seq") <= seq))


def merge_layers(layers: DataFrame) -> DataFrame:
    """One row per key from (layer, k, op, v), the highest layer wins; deletes stay."""
    return layers.groupBy("k").agg(F.max_by(F.struct("layer", "op", "v"), F.struct("layer", "seq")).alias("w")).select("k", "w.*")


def running_bytes(log: DataFrame) -> DataFrame:
    """(seq, total): bytes written so far. The span of seq is cut into as many ranges as a range is long, about the square
    root of the number of rows, and sums of ranges are added up first, so no task sorts the whole log."""
    size = (F.octet_length("k") + F.octet_length("v")).cast("long")
    span = log.agg(F.min("seq").alias("lo"), F.ceil(F.sqrt(F.max("seq") - F.min("seq") + 1)).alias("width"))
    rows = log.select("seq", size.alias("b")).crossJoin(F.broadcast(span))  # one row
    rows = rows.select("seq", "b", F.floor((F.col("seq") - F.col("lo")) / F.col("width")).alias("part"))
    parts = rows.groupBy("part").agg(F.sum("b").alias("s"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("seq")
    return rows.withColumn("own", F.sum("b").over(inside)).join(parts, "part").select("seq", (F.col("own") + F.col("base")).alias("total"))
