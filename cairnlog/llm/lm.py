"""Operator 9: language-model scores by a hashed maximum-entropy model with class-factored softmax.

    Q(word | history) = P(class of word | history) * P(word | class)
    P(word | history) = (n(word before, word) + PRIOR * Q(word | history)) / (n(word before) + PRIOR)

Words are counted exactly over all training documents. The most frequent ones (a bounded head) fall into classes by
their letters; all others share one class, inside which exact counts with add-one smoothing give the word's chance.
The class is predicted by a maximum-entropy model over the word before (n-gram), the classes two and three before
(skips) and a hashed conjunction of the first two. Its histories are few, so one pass gathers how often each class
follows each history in the whole training set, gradient updates run distributed over that table, and scoring looks
its log-probabilities up, document by document, in numpy.

n counts every pair of neighbouring words of the training set, whatever their rank, by hashes whose number of bits
grows with the number of tokens (a pair that never occurred meets another one's hash with a chance under 1/256). The
counts of words and pairs are distributed tables that grow with the input; blocks of documents look them up by packed
cells (see cells.py) and are never joined row by row.
"""

from __future__ import annotations

import copy
import logging
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import cells, common
from cairnlog.llm.bpe import slices
from cairnlog.llm.wordhash import hash_words, mix

log = logging.getLogger(__name__)
END = ""  # no word is empty
HEAD, CLASSES, OWN, JOINT, BLOCKS, SALTS = 300_000, 32, 224, 4096, 48, 32
PRIOR = 50.0  # occurrences of the word before that Q weighs as much as
LAST = CLASSES - 1  # the class of END; also that of what stands before a text
BUCKETS = OWN + CLASSES
HISTORIES = BUCKETS * CLASSES * CLASSES
CHUNK = 2_000_000  # bytes of text that are worked on at a time
PER_PART = 1_000_000  # training tokens for each range of keys
END_HASH = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64


def tokens(text: str | None) -> list[str]:
    """Words of a whole text, A-Z in lower case, then END."""
    return [*(common.words(common.lower_ascii(text)) if text else ()), END]


def count_tokens(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """(word, c) over all rows: counted in the tasks, then summed. At most `limit` words are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for chunk in slices(batch, 0, 2_000_000):
                for text in chunk.column(0).to_pylist():
                    seen.update(tokens(text))
                if len(seen) >= limit:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the tokens of each text, END last; those of text i are first[i]:first[i + 1]."""
    h, first = hash_words(column)
    n = len(column)
    at = first + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    ends = np.zeros(len(out), bool)
    ends[at[1:] - 1] = True
    out[ends], out[~ends] = END_HASH, h
    return out, at


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash of each word; END is no word."""
    h, first = hash_words(pa.array(words, pa.string()))
    out = np.full(len(words), END_HASH)
    out[first[1:] > first[:-1]] = h
    return out


def pair_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key of (token before, token) for each position; END stands before a text."""
    before = np.concatenate((END_HASH[None], h[:-1]))[: len(h)]
    before[first[:-1][first[:-1] < len(h)]] = END_HASH
    with np.errstate(over="ignore"):
        return mix(before * _U(0x9E3779B97F4A7C15) + h)


@dataclass(frozen=True)
class Pairs:
    """Packed counts of pairs, the low bits that their keys lack, and the number of key ranges."""

    cells: DataFrame
    shift: int
    parts: int


def count_pairs(docs: DataFrame, total: int, per_part: int = PER_PART) -> Pairs:
    """All neighbouring words of `docs`, which hold `total` tokens, counted in the tasks by blocks of texts."""
    shift, parts = max(0, 56 - max(1, total).bit_length()), max(1, -(-total // per_part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in slices(batch, 0, CHUNK):
                keys, n = np.unique(pair_keys(*token_hashes(chunk.column(0))) >> _U(shift), return_counts=True)
                yield cells.batch_of(list(cells.cells_of(keys << _U(shift), n, 1, -1, shift, parts)))

    return Pairs(docs.select("text").mapInArrow(run, cells.SCHEMA), shift, parts)


def word_cells(counts: DataFrame, parts: int) -> DataFrame:
    """The counts of words (word, c) as cells by the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = word_hashes(batch.column(0).to_pylist())
            order = np.argsort(h)
            yield cells.batch_of(list(cells.cells_of(h[order], np.asarray(batch.column(1), np.uint64)[order], 0, -1, 0, parts)))

    return counts.select("word", "c").mapInArrow(run, cells.SCHEMA)


@dataclass
class Vocabulary:
    words: list[str]
    counts: np.ndarray
    classes: np.ndarray
    total: int  # N
    distinct: int  # V

    def __post_init__(self):
        h = word_hashes(self.words)
        self.rank = np.argsort(h)
        self.hashes = h[self.rank]

    def bare(self) -> Vocabulary:
        """A copy for the tasks, which know words by their hashes."""
        out = copy.copy(self)
        out.words = []
        return out

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The rank in the head of each hashed token, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.rank[at], -1)

    def buckets(self) -> np.ndarray:
        """What the word before a position contributes to its history; the last entry is for words outside the head."""
        rank = np.arange(len(self.counts))
        return np.append(np.where(rank < OWN, rank, OWN + self.classes), OWN).astype(np.int64)


def letter_classes(words: list[str], counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Classes 1 to LAST - 1 of head words: spherical k-means of hashed letter pairs and triples, weighted by counts."""
    k, width = CLASSES - 2, 64
    x = np.zeros((len(words), width), np.float32)
    for i, w in enumerate(words):
        p = f"^{w[:24]}$"
        for n in (2, 3):
            for j in range(len(p) - n + 1):
                h = zlib.crc32(p[j : j + n].encode())
                x[i, h % width] += 1 if h & 1024 else -1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    weight = np.sqrt(counts).astype(np.float32)
    for _ in range(12):
        at = np.concatenate([np.argmax(x[s : s + 20_000] @ centre.T, axis=1) for s in range(0, len(x), 20_000)])
        for c in range(len(centre)):
            if (own := at == c).any():
                m = (x[own] * weight[own, None]).sum(0)
                centre[c] = m / max(float(np.linalg.norm(m)), 1e-9)
    return 1 + at


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The head (at most `head` words, so bounded) and the totals over all counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(head).toArrow()
    words, c = top["word"].to_pylist(), np.asarray(top["c"], np.int64)
    classes = letter_classes(words, c) if words else np.zeros(0, np.int64)
    if END in words:
        classes[words.index(END)] = LAST
    return Vocabulary(words, c, classes.astype(np.int64), total, distinct)


def histories(ids: np.ndarray, first: np.ndarray, buckets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, class) of each position of the texts first[i]:first[i + 1], from head ranks; classes[-1] is the class of
    other words. Nothing is seen across the beginning of a text."""
    cls = classes[ids]
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    back = lambda x, n, none: np.where(place >= n, np.concatenate((np.full(n, none), x))[: len(x)], none)
    one, two, three = back(buckets[ids], 1, OWN + LAST), back(cls, 2, LAST), back(cls, 3, LAST)
    return (one * CLASSES + two) * CLASSES + three, cls


def gather(docs: DataFrame, vocab, width: int = BLOCKS) -> DataFrame:
    """(block, data): packed counts of (history, class) over all rows, summed in the tasks, then by block and salt, then
    by block. Sums run over a stream of parts, so a task holds at most one table of each block, at any input size."""

    def pack(block: int, table: np.ndarray) -> tuple[int, bytes]:
        at = np.flatnonzero(table)
        return block, zlib.compress(at.astype("<u4").tobytes() + table[at].astype("<i8").tobytes(), 1)

    def unpack(data: bytes, table: np.ndarray) -> None:
        raw = zlib.decompress(data)
        n = len(raw) // 12
        table[np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<i8", n, 4 * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        buckets, classes = v.buckets(), np.append(v.classes, 0)
        table = np.zeros(HISTORIES * CLASSES, np.uint32)
        for batch in batches:
            for chunk in slices(batch, 0, CHUNK):
                tokens_of, first = token_hashes(chunk.column(0))
                h, c = histories(v.ids(tokens_of), first, buckets, classes)
                at, n = np.unique(h * CLASSES + c, return_counts=True)
                table[at] += n.astype(np.uint32)
        salt = TaskContext.get().partitionId() % SALTS
        rows = [pack(b, own(table, b, width)) for b in range(width)]
        cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([salt] * width, pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["block", "salt", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                if block not in sums:
                    sums[block] = np.zeros(len(range(block, HISTORIES, width)) * CLASSES, np.int64)
                unpack(data.as_py(), sums[block])
        for block, table in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(block, table)[1]], pa.binary())], ["block", "data"])

    parts = docs.select("text").mapInArrow(run, "block int, salt int, data binary")
    once = parts.repartition("block", "salt").mapInArrow(add, "block int, data binary")
    return once.repartition("block").mapInArrow(add, "block int, data binary")


def own(table: np.ndarray, block: int, width: int) -> np.ndarray:
    """Cells of the histories block, block + width, block + 2 * width ..."""
    return table.reshape(HISTORIES, CLASSES)[block::width].ravel()


def rows_of(history: np.ndarray) -> list[np.ndarray]:
    """Rows of the weight table for each feature of a history: word before, two skips, hashed conjunction, bias."""
    one, two, three = history // (CLASSES * CLASSES), history // CLASSES % CLASSES, history % CLASSES
    joint = (one * 2654435761 + two * 40503) % (1 << 32) * JOINT >> 32
    base = BUCKETS + 2 * CLASSES
    return [one, BUCKETS + two, BUCKETS + CLASSES + three, base + joint, np.full(len(history), base + JOINT)]


ROWS = BUCKETS + 2 * CLASSES + JOINT + 1


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(table: DataFrame, totals: np.ndarray, rounds: int = 20, rate: float = 0.4, penalty: float = 1.0) -> np.ndarray:
    """Weights (features x classes) by gradient rounds over the gathered table: each task gives the gradient of its
    blocks, the driver adds them (bounded: features x classes) and takes an Adagrad step."""
    spark, n = table.sparkSession, max(1, int(totals.sum()))
    w = np.zeros((ROWS, CLASSES), np.float64)
    w[-1] = np.log((totals + 1) / (n + CLASSES))
    sums = np.full_like(w, 1e-8)
    for step in range(rounds):
        shared = spark.sparkContext.broadcast(w.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w, g, loss = shared.value, np.zeros((ROWS, CLASSES)), 0.0
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = zlib.decompress(data)
                    m = len(raw) // 12
                    at, c = np.frombuffer(raw, "<u4", m).astype(np.int64), np.frombuffer(raw, "<i8", m, 4 * m)
                    local, place = np.unique(at // CLASSES, return_inverse=True)
                    seen = np.zeros((len(local), CLASSES))
                    seen[place, at % CLASSES] = c
                    f = rows_of(local * BLOCKS + block)
                    logp = log_softmax(sum(w[r] for r in f))
                    loss -= float((seen * logp).sum())
                    off = seen.sum(1, keepdims=True) * np.exp(logp) - seen
                    for r in f:
                        order = np.argsort(r, kind="stable")
                        first = np.flatnonzero(np.diff(r[order], prepend=-1))
                        g[r[order][first]] += np.add.reduceat(off[order], first) if len(first) else 0
            yield pa.RecordBatch.from_arrays([pa.array([g.astype(np.float32).tobytes()], pa.binary()), pa.array([loss])], ["g", "loss"])

        parts = table.coalesce(8).mapInArrow(run, "g binary, loss double").collect()
        g = sum(np.frombuffer(bytes(p.g), np.float32).reshape(ROWS, CLASSES).astype(np.float64) for p in parts) + penalty * w * (np.arange(ROWS) < ROWS - 1)[:, None]
        g /= n
        sums += g * g
        w -= rate * g / np.sqrt(sums) * (0.5 if step < 2 else 1.0)
        shared.unpersist()
        log.debug("round %d: %.4f nats a token", step, sum(p.loss for p in parts) / n)
    return w


@dataclass
class Model:
    vocab: Vocabulary
    table: np.ndarray  # log10 P(class | history), histories x classes

    def __post_init__(self):
        v = self.vocab
        mass = np.bincount(v.classes, v.counts, CLASSES) if len(v.words) else np.zeros(CLASSES)
        self.inside = np.log10(v.counts / np.maximum(mass[v.classes], 1)) if len(v.words) else np.zeros(0)
        self.ends = int(v.counts[v.words.index(END)]) if END in v.words else 0  # what stands before a text
        rest = v.total - int(v.counts.sum()) + v.distinct - len(v.words) + 1
        self.inside = np.append(self.inside, -math.log10(rest))  # of another word, but for log10(c + 1)


def learn(docs: DataFrame, counts: DataFrame, head: int = HEAD) -> Model:
    """The model from all of `docs`, whose words are counted in `counts`."""
    vocab = vocabulary(counts, head)
    shared = docs.sparkSession.sparkContext.broadcast(vocab.bare())
    table = common.materialize(gather(docs, shared), "histories")
    totals = np.bincount(vocab.classes, vocab.counts, CLASSES) if len(vocab.words) else np.zeros(CLASSES)
    totals[0] += vocab.total - int(vocab.counts.sum())
    w = train(table, totals).astype(np.float32)
    out = np.empty((HISTORIES, CLASSES), np.float32)
    for s in range(0, HISTORIES, 32_768):
        h = np.arange(s, min(HISTORIES, s + 32_768))
        out[h] = log_softmax(sum(w[r] for r in rows_of(h))) / math.log(10)
    return Model(vocab, out)


def blocks_of(docs: DataFrame) -> DataFrame:
    """(chunk, data): the rows of `docs`, whose last column is the text, in compressed blocks of about CHUNK bytes."""
    at = len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, options = TaskContext.get().partitionId() << 36, pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for chunk in slices(batch, at, CHUNK):
                sink = pa.BufferOutputStream()
                own = pa.Table.from_batches([chunk]).combine_chunks().to_batches()[0]  # a slice would be written with its whole buffers
                with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                    out.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])
                number += 1

    return common.materialize(docs.mapInArrow(run, "chunk long, data binary"), "lm_blocks")


def block(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def score(docs: DataFrame, counts: DataFrame, pairs: Pairs, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, n_tokens, n_known, base_score and score of every row of `docs`.

    The documents are cut into blocks. A block asks for the counts of its words outside the head and of its pairs, all
    distinct, and is scored once the answers are back. Null or empty text is END alone. Repeated rows, null ids and
    equal ids stay rows of their own; extra columns are not read unless named in `keep`; an empty table gives an empty
    result, and an empty training set a model of one class."""
    light = copy.copy(model)
    light.vocab = model.vocab.bare()
    shared = docs.sparkSession.sparkContext.broadcast(light)
    shift, parts, last = pairs.shift, pairs.parts, len(keep) + 1
    each = math.log10(model.vocab.total + model.vocab.distinct + 1)
    blocks = blocks_of(docs.select("doc_id", *keep, "text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value.vocab
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, first = token_hashes(block(data.as_py()).column(last))
                keys = np.unique(pair_keys(h, first) >> _U(shift)) << _U(shift)
                rows = list(cells.cells_of(np.unique(h[v.ids(h) < 0]), None, 0, number, 0, parts))
                yield cells.batch_of(rows + list(cells.cells_of(keys, None, 1, number, shift, parts)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, texts, got = shared.value, None, ([], [])
        for batch in batches:
            for part, kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if part < 0:
                    if texts is not None:
                        yield scored(m, texts, got)
                    texts, got = block(data.as_py()), ([], [])
                else:
                    got[kind].append(cells.unpack(data.as_py()))
        if texts is not None:
            yield scored(m, texts, got)

    def scored(m: Model, texts: pa.RecordBatch, got: tuple[list, list]) -> pa.RecordBatch:
        v = m.vocab
        h, first = token_hashes(texts.column(last))
        ids = v.ids(h)
        c = np.append(v.counts, 0)[ids]
        rare = np.flatnonzero(ids < 0)
        if len(rare):
            c[rare] = np.concatenate(got[0]).astype(np.int64)[np.unique(h[rare], return_inverse=True)[1]]
        n = np.concatenate(got[1]).astype(np.int64)[np.unique(pair_keys(h, first) >> _U(shift), return_inverse=True)[1]]
        at, cls = histories(ids, first, v.buckets(), np.append(v.classes, 0))
        log_c = np.log10(c + 1.0)
        q = m.table[at, cls].astype(np.float64) + m.inside[ids] + np.where(ids < 0, log_c, 0)
        before = np.concatenate(([0], c[:-1]))
        before[first[:-1]] = m.ends
        each_score = np.log10(n + PRIOR * 10.0**q) - np.log10(before + PRIOR)
        sums = [np.add.reduceat(x, first[:-1]) for x in ((c > 0).astype(np.int64), log_c, each_score)]
        size = np.diff(first)
        own = [pa.array(size), pa.array(sums[0]), pa.array(sums[1] - size * each), pa.array(sums[2])]
        return pa.RecordBatch.from_arrays([*texts.columns[:-1], *own], [*texts.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    asked = blocks.mapInArrow(ask, cells.SCHEMA)
    told = cells.answer(word_cells(counts, parts).unionByName(pairs.cells), asked, (0, shift))
    both = blocks.select("chunk", F.lit(-1).alias("part"), F.lit(0).alias("kind"), "data").unionByName(told.select("chunk", "part", "kind", F.col("n").alias("data")))
    names = ["doc_id", *keep]
    schema = common.with_columns(docs.select(*names).schema, "n_tokens long, n_known long, base_score double, score double")
    return both.repartition("chunk").sortWithinPartitions("chunk", "part", "kind").mapInArrow(finish, schema)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those outside the held-out fold."""
    out = F.coalesce(common.fold(F.col("doc_id"), 7) == 2, F.lit(False))
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    seen = docs.where(~out)
    counts = common.materialize(count_tokens(seen), "word_counts")
    model = learn(seen, counts)
    total = model.vocab.total
    scored = score(docs, counts, count_pairs(seen, total), model)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
