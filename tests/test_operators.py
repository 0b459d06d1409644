"""Small exact cases of the operators."""

from cairnlog.operators import replicas, segments, versions

LOG = "seq long, op int, k string, v string"


def test_reopen_case(spark):
    log = spark.createDataFrame([(1, 1, "k1", "v1"), (2, 1, "k2", "v2"), (3, 1, "k1", "v1b"), (4, 2, "k2", "")], LOG)
    assert [tuple(r) for r in versions.live(log).collect()] == [("k1", "v1b")]
    assert versions.get(log, "k2").count() == 0


def test_empty_key_and_value_are_legal(spark):
    log = spark.createDataFrame([(1, 1, "", "")], LOG)
    assert [tuple(r) for r in versions.live(log).collect()] == [("", "")]


def test_three_layers(spark):
    rows = [(3, "b", 1, "new"), (3, "d", 2, ""), *[(2, k, 1, "mid") for k in "abe"], *[(1, k, 1, "old") for k in "acde"]]
    layers = spark.createDataFrame([(layer, layer, op, k, v) for layer, k, op, v in rows], "layer int, seq long, op int, k string, v string")
    got = {r.k: (r.op, r.v) for r in versions.merge_layers(layers).collect()}
    assert got == {"a": (1, "mid"), "b": (1, "new"), "c": (1, "old"), "d": (2, ""), "e": (1, "mid")}


def test_majority_and_term_guard(spark):
    acks = spark.createDataFrame([(1, n, m) for n, m in enumerate([5, 3, 9, 7, 1])], "shard int, node int, match int")
    assert replicas.majority_index(acks).first().idx == 5
    terms = spark.createDataFrame([(1, 5, 2)], "shard int, idx int, term int")
    for current, want in ((2, True), (3, False)):
        now = spark.createDataFrame([(1, current)], "shard int, current int")
        assert replicas.commit(acks, terms, now).first().committed is want


def test_conflict_and_reconcile(spark):
    kind = "idx int, term int, op int, k string, v string"
    mine = spark.createDataFrame([(1, 1, 0, "", ""), (2, 1, 1, "k", "old")], kind)
    theirs = spark.createDataFrame([(1, 1, 0, "", ""), (2, 2, 1, "k", "new")], kind)
    assert replicas.conflict(mine, theirs).first().idx == 2
    assert {(r.idx, r.v) for r in replicas.reconcile(mine, theirs).collect()} == {(1, ""), (2, "new")}
    assert replicas.reconcile(mine, mine).count() == 2


def test_votes(spark):
    kind = "last_idx int, last_term int"
    rows = spark.createDataFrame([(100, 2), (9, 3), (10, 3), (1, 4)], kind)
    from pyspark.sql import functions as F

    got = [r.f for r in rows.select(replicas.fresh(F.lit(3), F.lit(10)).alias("f")).collect()]
    assert got == [False, False, True, True]
    votes = spark.createDataFrame([(1, 7, 1, True), (1, 7, 1, True), (1, 7, 2, True), (1, 7, 3, False)], "term int, candidate int, voter int, granted boolean")
    assert replicas.election(votes, 5).first().elected is False
    assert replicas.election(votes, 3).first().elected is True


def test_bottom_guard(spark):
    tables = spark.createDataFrame([(1, "a", "m"), (3, "f", "g")], "level int, lo string, hi string")
    upper = tables.where("level = 1")
    assert segments.is_bottom(tables, 2, upper).first().bottom is False
    assert segments.is_bottom(tables, 3, upper).first().bottom is True


def test_install_keeps_empty_key(spark):
    new = spark.createDataFrame([("", "x"), ("a", "1")], "k string, v string")
    old = spark.createDataFrame([("gone", "y"), ("a", "1")], "k string, v string")
    assert {tuple(r) for r in replicas.install(new, old).collect()} == {("", 1, "x"), ("gone", 2, "")}


def test_responses_at_one_time(spark):
    """Of responses with equal `at` the same one counts, however the rows are ordered and dealt out."""
    rows = [(1, 2, "b", 5), (1, 0, "c", 5), (1, 0, "a", 5), (1, 1, "z", 6), (2, 1, "x", 9), (2, 2, "y", 1), (3, 0, "stray", 1)]
    asked = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    for given in (rows, rows[::-1]):
        for parts in (1, 3):
            told = spark.createDataFrame(given, "id long, status int, value string, at long").coalesce(1).repartition(parts)
            assert {tuple(r) for r in replicas.matched(asked, told).collect()} == {(1, 0, "a"), (2, 2, "y"), (4, None, None)}


def test_tied_responses_of_the_query(spark, tmp_path):
    """Id 0 has two answers at tick 1: the late one is listed before the stray one. Nulls are passed over as by arg_min."""
    from cairnlog.plans import audits

    spark.createDataFrame([(k, 10 + k) for k in (0, 1, 4)] + [(5, None), (7, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in audits.response_match(spark, str(tmp_path)).collect()}
    assert got == {(0, 2, "late"), (1, 1, "v11"), (4, None, None), (5, 2, "late"), (7, 1, None)}
