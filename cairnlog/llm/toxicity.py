"""Operator 1: toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are whole words and their beginnings (4 to 7 letters), kept if the labelled sample shows them to go with
toxic documents. Labels only say toxic or not, so grades are made in training: 0 for clean documents, 1 to 3 for
toxic ones by thirds of how much of such vocabulary they hold. One weight vector is shared by all ordered
thresholds, P(grade <= j) = sigmoid(threshold_j - w.x); the output is the expected grade, the sum of P(grade > j).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import common
from cairnlog.llm.bpe import slices

PER_CLASS, FEATURES, LEAST, LEAST_SHARE, GRADES, CUT = 4000, 4000, 3, 200, 4, 0.25
_EDGE = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}*#$%&|<>«»¡¿-_=+/\\~`^@"


def parts(word: str) -> list[str]:
    """Features of one word: the bare lower-case word, and its beginnings with a closing mark."""
    bare = word.strip(_EDGE).lower()
    if not bare:
        return []
    return [bare[:64], *(bare[:n] + "*" for n in range(4, min(8, len(bare))))]


class Lookup(dict):
    """word -> numbers of its kept features; emptied when it reaches `limit` words."""

    def __init__(self, index: dict[str, int], limit: int = 400_000):
        super().__init__()
        self.index, self.limit = index, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = tuple(self.index[p] for p in parts(word) if p in self.index)
        if len(word) <= 64:
            self[word] = found
        return found

    def row(self, text: str | None) -> dict[int, float]:
        """Sparse features of a whole text: log(1 + count) of each kept feature."""
        hits = Counter(f for found in filter(None, map(self.__getitem__, (text or "").split())) for f in found)
        return {f: math.log1p(n) for f, n in hits.items()}


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, rows: list[dict[int, float]]) -> np.ndarray:
        """P(grade > j) of each row, rows x thresholds."""
        w = self.weights
        z = np.fromiter((sum(w[f] * v for f, v in r.items()) for r in rows), np.float64, len(rows))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def fit(rows: list[dict[int, float]], grades: np.ndarray, index: dict[str, int], steps: int = 300, penalty: float = 2e-4, rate: float = 0.1) -> Model:
    """Maximum likelihood of the cumulative-link model with shared weights, by Adam on the whole sample."""
    k, n = len(index), len(rows)
    thresholds, gaps = GRADES - 1, GRADES - 2
    at = np.fromiter((i for i, r in enumerate(rows) for _ in r), np.int64)
    feature = np.fromiter((f for r in rows for f in r), np.int64)
    value = np.fromiter((v for r in rows for v in r.values()), np.float64)
    p = np.zeros(k + 1 + gaps)
    p[k] = 2.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        theta = p[k] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(p[k + 1 :])))])
        z = np.bincount(at, p[feature] * value, n)
        below = sigmoid(np.hstack([theta[None, :] - z[:, None]]))  # P(grade <= j)
        full = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        chance = np.maximum(full[np.arange(n), grades + 1] - full[np.arange(n), grades], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))])
        upper, lower = slope[np.arange(n), grades + 1] / chance, slope[np.arange(n), grades] / chance
        dz = (upper - lower) / n  # of the negative log-likelihood
        g = np.zeros_like(p)
        g[:k] = np.bincount(feature, dz[at] * value, k) + penalty * p[:k]
        dt = np.array([(-(upper * (grades == j)).sum() + (lower * (grades == j + 1)).sum()) / n for j in range(thresholds)])
        g[k] = dt.sum()
        for j in range(gaps):
            g[k + 1 + j] = dt[j + 1 :].sum() * sigmoid(p[k + 1 + j])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(index, p[:k], p[k] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(p[k + 1 :])))]))


def learn(docs: DataFrame, labels: DataFrame, where=None, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fits on at most `per_class` labelled documents of each class. A doc_id counts once (with its least text), and so
    do equal texts of the sample, as toxic if any of them is labelled so: the same tables give the same model."""
    spark = docs.sparkSession
    sample = common.labelled_sample(labels, label, per_class, where)
    joined = common.sample_texts(docs, sample).where(F.col("text").isNotNull())
    chosen = common.materialize(joined.groupBy("text").agg(F.max("y").alias("y")).select("y", "text"), "toxicity_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {p for w in set(text.split()) for p in parts(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[y] for v in seen.values()], pa.int64()) for y in (0, 1))], ["f", "c", "t"])

    sizes = dict(chosen.groupBy("y").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return Model({}, np.zeros(0), np.arange(1.0, GRADES) * 3)
    least = max(LEAST, n1 // LEAST_SHARE)
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    counts = chosen.mapInArrow(count, "f string, c long, t long").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    top = counts.withColumn("odds", odds).where((F.col("t") >= least) & (F.col("odds") > 1.5))
    best = top.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "f").limit(FEATURES).collect()  # at most FEATURES rows
    index = {r.f: k for k, r in enumerate(best)}
    strong = np.array([max(r.odds, 0) for r in best])
    shared = spark.sparkContext.broadcast(index)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lookup(shared.value)
        for batch in batches:
            rows = [found.row(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float64()))],
                ["y", "f", "v"],
            )

    got = chosen.mapInArrow(extract, "y int, f array<int>, v array<double>").collect()  # at most 2 x per_class rows
    got.sort(key=lambda r: (r.y, r.f, r.v))
    rows, y = [dict(zip(r.f, r.v, strict=True)) for r in got], np.array([r.y for r in got])
    mass = np.array([sum(strong[f] * v for f, v in r.items()) for r in rows])
    edges = np.quantile(mass[y == 1], [1 / 3, 2 / 3])
    grades = np.where(y == 1, 1 + np.searchsorted(edges, mass, side="right"), 0).astype(int)
    return fit(rows, grades, index)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` plus severity (expected grade, 0 to 3), p_toxic, grade and toxic (p_toxic of `CUT` or more:
    it weighs a missed toxic document over a doubtful one).

    Null, empty and wordless texts hold no feature and get the least severity. Repeated rows, null ids and extra
    columns stay; columns with these four names are replaced; an empty table gives an empty result."""
    docs = docs.drop("severity", "p_toxic", "grade", "toxic")
    shared, at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        found = Lookup(model.index)
        for batch in batches:
            for chunk in slices(batch, at):
                above = model.grades([found.row(t) for t in chunk.column(at).to_pylist()])
                new = [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above[:, 0] >= CUT)]
                yield pa.RecordBatch.from_arrays([*chunk.columns, *new], [*names, "severity", "p_toxic", "grade", "toxic"])

    return common.map_arrow(docs, run, common.with_columns(docs.schema, "severity double, p_toxic double, grade int, toxic boolean"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents, learnt from the labelled ones."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    return grade(docs, model).select("doc_id", "severity", "p_toxic", "grade", "toxic")
