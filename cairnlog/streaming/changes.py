"""Change logs as streams: micro-batches into the store, and a keyed live image."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnlog.sources.store import SCHEMA, Store


def read_changes(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of changes (seq, op, k, v) from parquet files; the trigger limit bounds a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def into_store(changes: DataFrame, store: Store, checkpoint: str, maintain: bool = True) -> StreamingQuery:
    """Commits each micro-batch to the store. A batch that is sent again after a restart is known by the checkpoint and
    its number; changes may come in any order, since their seq decides."""

    def commit(batch: DataFrame, number: int) -> None:
        store.write(batch, checkpoint, number)
        if maintain:
            store.maintain()

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_updates(changes: DataFrame) -> DataFrame:
    """(k, seq, op, v): each key's newest change, whenever it changes. Changes may come in any order: one that is not
    newer than the state is ignored. State is a row for each key, deletes included."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (-1, 0, "")
        best = held
        for b in batches:
            row = b.loc[b["seq"].idxmax()]
            if row["seq"] > best[0]:
                best = (int(row["seq"]), int(row["op"]), row["v"])
        if best != held:
            state.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["k", "seq", "op", "v"])

    return changes.groupBy("k").applyInPandasWithState(
        update, "k string, seq long, op int, v string", "seq long, op int, v string", "update", GroupStateTimeout.NoTimeout
    )


def fold_updates(target: str):
    """A foreachBatch function that keeps the updates of live_updates as parquet, one folder a batch; written again
    after a restart it replaces its own folder."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return keep


def image_of(spark: SparkSession, target: str) -> DataFrame:
    """(k, v): the live image from what fold_updates wrote."""
    rows = spark.read.parquet(target)
    won = rows.groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("w"))
    return won.where("w.op = 1").select("k", "w.v")
