"""Neighbours of small tables and of wide vectors, against a full scan."""

import numpy as np

from cairnlog.llm import ann


def near(spark, x, asked):
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in ann.nearest(table.where(f"id < {asked}"), table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_small_tables_are_whole(spark):
    x = np.random.default_rng(14).standard_normal((11, 64))
    for n, k in ((8, 7), (11, 10)):
        got = near(spark, x[:n], n)
        for q in range(n):
            d = ((x[:n] - x[q]) ** 2).sum(1)
            assert got[q] == [i for i in np.argsort(d, kind="stable").tolist() if i != q][:k]


def test_recall_of_wide_vectors(spark):
    x = np.random.default_rng(15).standard_normal((3000, 256))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = near(spark, x, 40)
    hits = 0
    for q in range(40):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(got[q]))
    assert hits / 400 > 0.95


def test_recall_where_norms_differ(spark):
    rng = np.random.default_rng(17)
    for n, sigma in ((500, 1.0), (2500, 0.5), (2500, 2.0)):
        x = rng.standard_normal((n, 64)) * np.exp(sigma * rng.standard_normal((n, 1)))
        got, hits = near(spark, x, 40), 0
        for q in range(40):
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len(set(np.argsort(d)[:10].tolist()) & set(got[q]))
        assert hits / 400 >= 0.9, (n, sigma, hits)


def test_columns_of_clashing_names(spark):
    x = np.random.default_rng(18).standard_normal((30, 8)).astype(np.float32)
    rows = [(k, v.tolist(), 1, 2, 3, "x") for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "id long, v array<float>, width int, tab int, axis int, `q``s` string")
    got = ann.nearest(table.where("id < 3"), table, k=5).collect()
    assert len(got) == 15 and got[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}
    for r in got:
        assert abs(r.score - np.linalg.norm(x[r.query_id].astype(float) - x[r.vec_id].astype(float))) < 1e-12
