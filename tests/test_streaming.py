import random

from cairnlog.operators import versions
from cairnlog.sources.store import SCHEMA, Store
from cairnlog.streaming import changes


def feed(spark, tmp_path, shuffled):
    rng = random.Random(5)
    rows = [(i, 2 if rng.random() < 0.2 else 1, f"k{rng.randrange(30)}", f"v{i}") for i in range(1, 301)]
    rows = [(s, op, k, "" if op == 2 else v) for s, op, k, v in rows]
    parts = [rows[i : i + 75] for i in range(0, 300, 75)]
    if shuffled:
        parts.reverse()
    for n, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return {(r.k, r.v) for r in versions.live(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_micro_batches_into_the_store(spark, tmp_path):
    want = feed(spark, tmp_path, False)
    store = Store(spark, f"file://{tmp_path}/store", l0_trigger=2)
    for _ in range(2):  # the second start finds nothing new
        changes.into_store(changes.read_changes(spark, f"{tmp_path}/in", 1), store, f"{tmp_path}/cp").awaitTermination()
    assert {(r.k, r.v) for r in store.snapshot().collect()} == want


def test_keyed_state_ignores_older_changes(spark, tmp_path):
    want = feed(spark, tmp_path, True)
    updates = changes.live_updates(changes.read_changes(spark, f"{tmp_path}/in", 1))
    q = updates.writeStream.outputMode("update").foreachBatch(changes.fold_updates(f"{tmp_path}/out"))
    q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.v) for r in changes.image_of(spark, f"{tmp_path}/out").collect()} == want
