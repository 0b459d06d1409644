"""Operator 3: quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are pairs of byte classes and counts of repetition (words equal to the one before, repeated lines, repeated
runs of words). A truncated singular value decomposition of the weighted term matrix of a bounded labelled sample
gives the space. The sample's unit vectors are broadcast (their number and width are parameters, so the size has a
bound); every document is projected and takes exact cosine products with all of them, block by block. The nearest
neighbours vote with weights that grow with similarity, corrected for the sample's share of each class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import common
from cairnlog.llm.bpe import slices

CLASSES = 64
EXTRA = 3
TERMS = CLASSES * CLASSES + EXTRA
PER_CLASS, WIDTH, NEIGHBOURS, BLOCK, SHARPNESS, CUT = 2000, 48, 15, 256, 8.0, 0.3


def byte_classes() -> np.ndarray:
    """A class below 64 for each byte: small letters and ASCII marks apart, capitals, digits, high bytes together."""
    kinds = np.zeros(256, np.uint16)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            kinds[b] = b - 97
        elif "A" <= c <= "Z":
            kinds[b] = 26
        elif "0" <= c <= "9":
            kinds[b] = 27
        elif b >= 128:
            kinds[b] = 28
        elif c == "\n":
            kinds[b] = 29
        elif b <= 32 or b == 127:
            kinds[b] = 30
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for k, b in enumerate(marks):
        kinds[b] = 31 + k
    return kinds


_KINDS = byte_classes()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the terms in a whole text (null: as empty)."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    kinds = _KINDS[np.frombuffer(text.encode(), np.uint8)]
    if len(kinds) > 1:
        out[: CLASSES * CLASSES] = np.bincount(kinds[:-1] * np.uint16(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES)
    words = text.split()
    n = len(words)
    if n > 1:
        out[-3] = 4 * sum(map(eq, words, islice(words, 1, None)))
    lines = [s for s in text.split("\n") if s]
    out[-2] = 4 * n * (len(lines) - len(set(lines))) / max(1, len(lines))
    if n >= 5:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        with np.errstate(over="ignore"):
            w = h[:-4] + h[1:-3] * np.uint64(31) + h[2:-2] * np.uint64(961) + h[3:-1] * np.uint64(29791) + h[4:] * np.uint64(923521)
        out[-1] = 4 * (len(w) - len(np.unique(w)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # idf of the terms
    axes: np.ndarray  # terms x width
    vectors: np.ndarray  # sample x width, unit
    votes: np.ndarray  # weight of each sample row for its class
    labels: np.ndarray
    prior: float
    blank: float = 0.0  # of texts without a word: their share of label 1 in the sample, 0 if it holds none

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit latent vectors of rows of term counts; a row without terms stays zero."""
        x = weigh(counts, self.weights) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of term counts: the neighbours' weighted vote."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        cos = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARPNESS * self.votes[near]
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-300), self.prior)


def weigh(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of term shares times idf, unit rows."""
    x = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)) * weights
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(rows: list[np.ndarray], labels: list[int], class_totals: tuple[int, int], width: int = WIDTH, seed: int = 7) -> Model:
    """Latent space and votes from the sample's term counts. A sample without rows scores its prior everywhere."""
    y = np.asarray(labels, np.float64)
    n = sum(class_totals)
    prior = class_totals[1] / n if n else 0.5
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, y, prior)
    counts = np.vstack(rows)
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.3
    x = weigh(counts, weights)
    del counts, rows
    rng, k = np.random.default_rng(seed), min(width, len(x))
    q = rng.standard_normal((x.shape[0], k + 8)).astype(np.float32)
    for _ in range(3):  # subspace iteration
        q = np.linalg.qr(x.T @ q)[0]
        q = np.linalg.qr(x @ q)[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T.astype(np.float32)
    in_sample = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], np.float64)
    votes = (np.asarray(class_totals) / in_sample)[y.astype(int)]
    model = Model(weights, axes, np.zeros((0, k), np.float32), votes, y, prior)
    v = x @ axes
    model.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, where=None, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fits on at most `per_class` documents of each class, one row a doc_id. Class shares are counted over all labelled
    rows. Texts without a word have no place in the space: they are scored apart, by the sample's labels of such texts."""
    sample = common.labelled_sample(labels, label, per_class, where)
    totals = dict(labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(F.lit(True) if where is None else where).groupBy(F.col(label).cast("int")).count().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(term_counts(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["y", "terms", "blank"])

    joined = common.sample_texts(docs, sample).withColumn("blank", common.blank("text"))
    got = joined.mapInArrow(run, "y int, terms binary, blank boolean").collect()  # at most 2 x per_class rows
    got.sort(key=lambda r: (r.y, bytes(r.terms)))
    spoken, silent = [r for r in got if not r.blank], [r.y for r in got if r.blank]
    model = fit([unpack(bytes(r.terms)) for r in spoken], [r.y for r in spoken], (totals.get(0, 0), totals.get(1, 0)))
    model.blank = sum(silent) / len(silent) if silent else 0.0
    return model


def pack(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return zlib.compress(at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n, out = len(data) // 6, np.zeros(TERMS, np.float32)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return out


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` plus score and predicted, of every whole text; only text is an input.

    Null, empty and blank texts: `model.blank`, which is 0 unless the sample holds such texts with label 1. Repeated
    rows, null ids and extra columns of any name stay; an empty table gives an empty result. Columns named score or
    predicted are replaced."""
    docs = docs.drop("score", "predicted")
    shared, at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk in slices(batch, at):
                texts, scores = chunk.column(at).to_pylist(), []
                for start in range(0, len(texts), BLOCK):
                    scores.append(model.score(np.vstack([term_counts(t) for t in texts[start : start + BLOCK]])))
                s = np.clip(np.concatenate(scores), 0, 1)
                s[[not t or not t.strip(common.SPACE) for t in texts]] = model.blank
                new = [pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([*chunk.columns, *new], [*names, "score", "predicted"])

    return common.map_arrow(docs, run, common.with_columns(docs.schema, "score double, predicted int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labelled rows outside the held-out fold. A null doc_id is of no fold:
    held_out is false."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"), common.fold(F.col("doc_id"), 5) != 0)
    scored = classify(docs, model)
    held_out = F.coalesce(common.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
