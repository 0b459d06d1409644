"""Byte formats and the store."""

import random

import pytest

from cairnlog.sources import bytelog, checksum
from cairnlog.sources.store import Manifest, Store


def test_known_checksums():
    assert checksum.crc32c(b"123456789") == 0xE3069283
    assert checksum.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert checksum.fnv1a(b"foobar") == 0x85944171F73967E8


RECORDS = [(1, b"k1", b"v1"), (2, b"k1", b""), (1, b"", b""), (1, b"x" * 300, bytes(range(256)))]
WHOLE = b"".join(bytelog.record(*r) for r in RECORDS)


def test_log_round_trip():
    assert [r[1:] for r in bytelog.replay(WHOLE)] == RECORDS


@pytest.mark.parametrize("tail", [b"\x01", bytes(11), bytes(64), bytelog.record(1, b"k", b"v")[:-1], bytelog.record(1, b"k", b"v")[:12] + bytes(4)])
def test_torn_tails_end_the_log(tail):
    assert [r[1:] for r in bytelog.replay(WHOLE + tail)] == RECORDS


@pytest.mark.parametrize("at", [0, 9, 14])
def test_damage_before_the_end_is_an_error(at):
    bad = bytearray(WHOLE)
    bad[at] ^= 255
    with pytest.raises(bytelog.Corrupt):
        list(bytelog.replay(bytes(bad)))


def test_log_files_as_rows(spark, tmp_path):
    (tmp_path / "000001.wal").write_bytes(WHOLE)
    (tmp_path / "000002.wal").write_bytes(b"")
    (tmp_path / "000003.sst").write_bytes(b"no log")
    got = bytelog.read_logs(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [(r.file, r.op, bytes(r.key), bytes(r.value)) for r in got] == [("000001.wal", *r) for r in RECORDS]


def test_requests(spark, tmp_path):
    sent = [(1, 7, b"k", b""), (2, (1 << 64) - 1, b"k", b"v"), (3, 0, b"", b"")]
    (tmp_path / "r.bin").write_bytes(b"".join(bytelog.frame(bytelog.request(*s)) for s in sent))
    got = {(r.op, int(r.id), bytes(r.key), bytes(r.value)) for r in bytelog.read_requests(spark, str(tmp_path)).collect()}
    assert got == set(sent)
    assert bytelog.response_of(bytelog.response(1, 9)) == (9, 1, b"")
    for bad in (b"", b"\x04" + bytes(9), b"\x01" + bytes(8) + b"\x05k"):
        with pytest.raises(bytelog.Corrupt):
            bytelog.request_of(bad)
    with pytest.raises(bytelog.Corrupt):
        list(bytelog.frames(b"\x00\x00\x00\x05abc"))


def image(store):
    return {r.k: r.v for r in store.snapshot().collect()}


def test_store_against_a_dictionary(spark, tmp_path):
    rng, model, path, seq = random.Random(12), {}, f"file://{tmp_path}/s", 0
    store = Store(spark, path, l0_trigger=3, l1_bytes=2_000, multiplier=3, table_rows=60)
    for round_ in range(7):
        rows = []
        for _ in range(120):
            seq += 1
            k = f"k{rng.randrange(200):04d}"
            if rng.random() < 0.25:
                model.pop(k, None)
                rows.append((seq, 2, k, ""))
            else:
                model[k] = f"v{seq:<20}"
                rows.append((seq, 1, k, model[k]))
        store.write(spark.createDataFrame(rows, "seq long, op int, k string, v string"))
        store.maintain()
        if round_ == 3:
            store = Store(spark, path, l0_trigger=3, l1_bytes=2_000, multiplier=3, table_rows=60)
    assert image(store) == model
    for level in store.manifest.levels[1:]:  # disjoint and in order
        assert all(a.hi < b.lo for a, b in zip(level, level[1:], strict=False))
    assert any(store.manifest.levels[2])
    key = next(iter(model))
    assert store.get(key) == model[key] and store.get("absent") is None
    asked = spark.createDataFrame([(key,), ("absent",), (key,)], "k string")
    assert {(r.k, r.v) for r in store.multi_get(asked).collect()} == {(key, model[key]), ("absent", None)}
    store.clean()
    assert store.orphans() == [] and image(Store(spark, path)) == model


def test_store_commits_and_repeats(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path)
    batch = spark.createDataFrame([(1, 1, "a", "1"), (2, 1, "a", "2"), (3, 1, "b", "")], "seq long, op int, k string, v string")
    store.write(batch)
    store.write(batch)
    assert store.manifest.version == 1 and image(store) == {"a": "2", "b": ""}
    other = Store(spark, path)
    store.put("c", "3")
    with pytest.raises(RuntimeError):
        other.put("c", "4")
    assert len(Store(spark, path).orphans()) == 1
    store.delete("absent")
    store.delete("a")
    assert image(store) == {"b": "", "c": "3"}
    store.close()
    with pytest.raises(RuntimeError):
        store.get("b")


def test_trivial_move_keeps_deletes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", l0_trigger=1)
    store.delete("gone")
    store.compact(0)
    assert [t.rows for t in store.manifest.levels[1]] == [1]


def test_manifest_damage():
    text = Manifest().encode()
    assert Manifest.decode(text) == Manifest()
    with pytest.raises(ValueError):
        Manifest.decode(text.replace('\\"applied\\": 0', '\\"applied\\": 5'))


KIND = "seq long, op int, k string, v string"


def test_late_changes_are_kept(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write(spark.createDataFrame([(10, 1, "a", "10"), (11, 1, "b", "11")], KIND))
    store.write(spark.createDataFrame([(5, 1, "new", "5"), (6, 1, "a", "6")], KIND))
    assert image(store) == {"a": "10", "b": "11", "new": "5"} and store.manifest.applied == 11
    version = store.manifest.version
    store.write(spark.createDataFrame([(5, 1, "new", "5"), (6, 1, "a", "6")], KIND))  # nothing new: no version
    assert store.manifest.version == version and store.orphans() == []


def test_numbered_batches_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store, batch = Store(spark, path), spark.createDataFrame([(1, 1, "a", "1")], KIND)
    store.write(batch, "feed", 0)
    store.write(batch, "feed", 0)
    assert store.manifest.version == 1
    Store(spark, path).write(spark.createDataFrame([(2, 1, "a", "2")], KIND), "feed", 0)  # known from the manifest
    store.write(spark.createDataFrame([(3, 1, "a", "3")], KIND), "feed", 1)
    assert image(Store(spark, path)) == {"a": "3"}


def test_a_late_change_behind_a_dropped_delete_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", l0_trigger=2)
    store.write(spark.createDataFrame([(1, 1, "a", "1"), (2, 1, "b", "2")], KIND))
    store.write(spark.createDataFrame([(9, 2, "a", "")], KIND))
    assert store.maintain() == 1 and store.manifest.forgotten == 9
    left = store.orphans()
    with pytest.raises(ValueError):
        store.write(spark.createDataFrame([(4, 1, "a", "4")], KIND))
    assert image(store) == {"b": "2"} and store.orphans() == left
    store.write(spark.createDataFrame([(12, 1, "a", "12")], KIND))
    assert image(store) == {"a": "12", "b": "2"}


def test_a_lost_race_closes_the_store_to_writes(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one, two = Store(spark, path), Store(spark, path)
    one.put("a", "1")
    for _ in range(2):
        with pytest.raises(RuntimeError):
            two.put("a", "2")
    assert image(Store(spark, path)) == {"a": "1"}


def test_large_batches_are_written_in_ranges(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", l0_trigger=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        store.write(spark.range(4000).selectExpr("id + 1 AS seq", "1 AS op", "lpad(id, 8, '0') AS k", "repeat('v', 20) AS v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tables = store.manifest.levels[0]
    assert len(tables) > 1 and all(a.hi < b.lo for a, b in zip(tables, tables[1:], strict=False)) and store.due() is None
    assert store.snapshot().count() == 4000
