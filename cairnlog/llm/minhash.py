"""Operator 7: near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: rounds throw the elements of a set into the coordinates; a coordinate keeps the least value of the first
round that reaches it. Rounds from the t-th on aim at one coordinate each, so after 2t rounds all are filled, and
agreement concentrates as with t independent minima, in time near to linear.

Documents with equal sets form one class, a node. Nodes that share a band are compared with a lead (a star, not all
pairs) by their full sets; members of a band that the stars leave apart are compared with each other in blocks, by
size, by sketch and then by their full sets. Components of the verified links are found by star rounds.

Shingles are 64-bit hashes. Tables in between are written to the shared folder and deleted once they are used up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlog.llm import common
from cairnlog.llm.bpe import slices
from cairnlog.llm.components import components
from cairnlog.llm.wordhash import mix, shingle_sets

ROWS, BANDS = 6, 40
SIZE = ROWS * BANDS  # coordinates; a pair at 0.8 shares no band with a chance of 5e-6
BYTES = 2_000_000  # of text that is hashed at a time
PARTS = 256  # in which the members of a group or the partners of a node are dealt out, so that no task holds them all
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_ERR = {"over": "ignore"}


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, A-Z in lower case."""
    return next(shingle_sets(pa.array([text], pa.string()), width))


def sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit elements."""
    out, n, start = np.full(size, _EMPTY), len(elements), 0
    chunk = max(1, min(size, 2 * size // n))
    with np.errstate(**_ERR):
        while start < 2 * size:
            stop = min(2 * size, start + chunk)
            if start < size < stop:
                stop = size
            rounds = np.arange(start, stop, dtype=np.uint64)[:, None]
            h = mix(elements[None, :] + rounds * _STEP)
            value = (rounds << _U(32)) | (h & _U(0xFFFFFFFF))
            if start < size:
                at = (((h >> _U(32)) * _U(size)) >> _U(32)).astype(np.int64)
                np.minimum.at(out, at.ravel(), value.ravel())
            else:
                out[start - size : stop - size] = np.minimum(out[start - size : stop - size], value.min(1))
            if not (out == _EMPTY).any():
                break
            start, chunk = stop, min(4 * chunk, max(chunk, 8192 // n))
    return out


def sketches(sets: list[np.ndarray], size: int = SIZE, budget: int = 100_000) -> np.ndarray:
    """The sketch of each set, a row each (rows of empty sets are never filled). Sets of 48 elements and more go through
    the rounds together, about `budget` elements at a time."""
    out = np.full((len(sets), size), _EMPTY)
    flat, n = out.reshape(-1), np.array([len(s) for s in sets], np.int64)
    for k in np.flatnonzero((n > 0) & (n < 48)).tolist():
        out[k] = sketch(sets[k], size)
    big = np.flatnonzero(n >= 48)
    upto, start = np.cumsum(n[big]), 0
    while start < len(big):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + budget, side="right")))
        docs, start = big[start:stop], stop
        x, base = np.concatenate([sets[k] for k in docs.tolist()]), np.repeat(docs * size, n[docs])
        with np.errstate(**_ERR):
            for r in range(size):
                h = mix(x + _U(r) * _STEP)
                at = base + (((h >> _U(32)) * _U(size)) >> _U(32)).astype(np.int64)
                np.minimum.at(flat, at, (_U(r) << _U(32)) | (h & _U(0xFFFFFFFF)))
                gaps = (out[docs] == _EMPTY).any(1)
                if not gaps.all():
                    kept = np.repeat(gaps, n[docs])
                    x, base, docs = x[kept], base[kept], docs[gaps]
                if not len(docs):
                    break
        for k in docs.tolist():  # as good as never: 240 rounds of 48 draws left a gap
            out[k] = sketch(sets[k], size)
    return out


def bands_of(s: np.ndarray) -> np.ndarray:
    """For each sketch, one hash for each run of ROWS coordinates, different for equal runs of different bands."""
    rows, out = s.reshape(len(s), BANDS, ROWS), np.tile(np.arange(BANDS, dtype=np.uint64), (len(s), 1))
    with np.errstate(**_ERR):
        for k in range(ROWS):
            out = mix(out * _STEP + rows[:, :, k])
    return out


def short(s: np.ndarray) -> np.ndarray:
    """A byte of each coordinate: enough to rule pairs out."""
    return (s & _U(0xFF)).astype(np.uint8)


def digest(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t (digest of the text), n (set size), key (digest of the set; null if empty) and bands (array<long>)."""
    names = ["doc_id", "t", "n", "key", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in slices(batch, 1, BYTES):
                sets = list(shingle_sets(chunk.column(1), width))
                n = np.array([len(s) for s in sets], np.int64)
                bands = bands_of(sketches(sets)).view(np.int64)[n > 0]
                ends = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))
                columns = [pa.array(n), pa.array([digest(s) for s in sets], pa.binary()), listed]
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), *columns], names)

    texts = docs.select("doc_id", "text", text_digest().alias("t"))
    return texts.mapInArrow(run, "doc_id long, t binary, n long, key binary, bands array<long>")


def text_digest():
    """A digest of the whole text; null for null."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def verify(pairs: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The partners of an `a` are dealt out in blocks, and its set is sent once to each block, so neither a task nor the
    shuffle depends on how many partners one node has."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).alias("blocks"))
    spread = pairs.withColumn("at", F.xxhash64("b")).withColumn("dealt", F.pmod("at", F.lit(PARTS)))
    each = spread.groupBy("a", "dealt").agg(F.count("*").alias("n"))  # at most PARTS rows a node
    each = each.select("a", "dealt", F.ceil(F.sum("n").over(W.partitionBy("a")) / block).alias("blocks"))
    partners = common.join(spread, each, ["a", "dealt"]).select("a", F.pmod("at", "blocks").alias("part"), F.col("b").alias("node"), F.lit(1).alias("role"))
    leads = size.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("role"))
    dealt = common.join(partners.unionByName(leads), sets.select("node", "elements"), "node").select("a", "part", "role", "node", "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            keep_a, keep_b = [], []
            for a, role, node, elements in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4), strict=True):
                x = np.frombuffer(elements.as_buffer(), np.uint64)
                if role == 0:
                    own = x.copy()
                elif similar(own, x, percent):
                    keep_a.append(a)
                    keep_b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])

    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) between nodes (node, doc_id, t, bands) that share a band; they join the same nodes as all
    links between those would.

    The lead of a band is the member that shares most bands with others, so usually the text that the rest of the
    band was copied from. Every node first meets the foremost of its leads, which joins most bands at once."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    multi = common.materialize(common.join(rows, shared, "band"), "shared_bands")
    most = multi.groupBy("node").agg(F.sum("c").alias("met"))
    sets = common.materialize(full_sets(docs, common.join(nodes.select("node", "doc_id", "t"), most, "node", "left_semi"), width), "sets")
    rank = F.struct("met", (-F.col("node")).alias("least"))
    leads = common.join(multi, most, "node").groupBy("band").agg(F.max_by("node", rank).alias("a"), F.max("met").alias("top"))
    leads = common.materialize(leads, "leads")
    foremost = common.join(multi, leads, "band").groupBy("node").agg(F.max_by("a", F.struct("top", (-F.col("a")).alias("least"))).alias("a"))
    stars = common.materialize(foremost.where("a != node").select("a", F.col("node").alias("b")), "stars")
    first = common.materialize(verify(stars, sets, percent), "star_links")
    label = components(first)
    more = leftovers(multi.select("band", F.col("node").alias("b")), leads.select("band", "a"), label, sets, percent)
    out = common.materialize(first.unionByName(more), "all_links")
    common.discard(multi, sets, leads, stars, first, label)
    return out


def leftovers(bands: DataFrame, leads: DataFrame, label: DataFrame, sets: DataFrame, percent: int, block: int = 128) -> DataFrame:
    """Verified links (a, b) that join nodes of one band which the links so far leave apart.

    Bands whose members are in one component need nothing more. The others are gathered by the component of their
    lead: members outside of it meet all members, block by block, so no task holds a group and no pair leaves its
    block unless it is a link. In a block, sketches rule pairs out first (agreement 4.6 standard deviations under the
    threshold), then full sets decide; of the links those that join something new are given."""
    own = label.withColumnsRenamed({"node": "b", "component": "own"})
    lead = label.withColumnsRenamed({"node": "a", "component": "g"})
    m = common.join(bands, own, "b", "left").select("band", "b", F.coalesce("own", "b").alias("own"))
    mixed = m.groupBy("band").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo != hi")
    mixed = common.join(common.join(mixed, leads, "band"), lead, "a", "left").select("band", F.coalesce("g", "a").alias("g"))
    gathered = common.materialize(common.join(m, mixed, "band").select("g", "b", "own").distinct(), "apart")
    apart = F.col("own") != F.col("g")
    m = gathered.withColumn("at", F.xxhash64("b")).withColumn("part", F.pmod("at", F.lit(PARTS)))
    size = m.groupBy("g", "part").agg(F.count("*").alias("n"), F.count(F.when(apart, 1)).alias("s"))  # at most PARTS rows a group
    blocks = lambda n: F.ceil(F.sum(n).over(W.partitionBy("g")) / block)
    asked = common.join(m, size.select("g", "part", blocks("n").alias("mb"), blocks("s").alias("sb")).where("sb > 0"), ["g", "part"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    all_of = asked.select("g", F.pmod("at", "mb").alias("i"), each("sb").alias("j"), F.lit(False).alias("single"), "b", "own")
    singles = asked.where(apart).select("g", each("mb").alias("i"), F.pmod("at", "sb").alias("j"), F.lit(True).alias("single"), "b", "own")
    least = SIZE * (percent / 100 - 0.12)

    def run(t: pa.Table) -> pa.Table:
        single, b, own = (np.asarray(t[c]) for c in ("single", "b", "own"))
        s = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SIZE)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["elements"]]
        n = np.array([len(x) for x in sets])
        joined, found = Joined(own.tolist()), []
        y = np.flatnonzero(~single)
        for k in np.flatnonzero(single):
            near = y[(own[y] != own[k]) & (100 * np.minimum(n[y], n[k]) >= percent * np.maximum(n[y], n[k]))]
            near = near[(s[near] == s[k]).sum(1) >= least]
            for i in near:
                if joined.apart(own[k], own[i]) and similar(sets[k], sets[i], percent):
                    joined.join(own[k], own[i])
                    found.append((min(b[k], b[i]), max(b[k], b[i])))
        return pa.table({c: pa.array([f[at] for f in found], pa.int64()) for at, c in enumerate("ab")})

    dealt = common.join(all_of.unionByName(singles), sets.withColumnRenamed("node", "b"), "b")
    out = common.materialize(dealt.groupBy("g", "i", "j").applyInArrow(run, "a long, b long").distinct(), "leftover_links")
    common.discard(gathered)
    return out


class Joined(dict):
    """Disjoint sets of component numbers, for one block."""

    def __init__(self, numbers: list[int]):
        super().__init__(zip(numbers, numbers, strict=True))

    def top(self, x: int) -> int:
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def apart(self, x: int, y: int) -> bool:
        return self.top(x) != self.top(y)

    def join(self, x: int, y: int) -> None:
        self[self.top(x)] = self.top(y)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, elements binary, sketch binary) of the nodes (node, doc_id, t), from the texts that stand for them.

    Equal rows become one before and after the one shuffle of texts; the join keeps that partitioning, and sets are made
    behind it, so no set is shuffled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in slices(batch, 1, BYTES):
                sets = list(shingle_sets(chunk.column(1), width))
                columns = [[s.tobytes() for s in sets], [x.tobytes() for x in short(sketches(sets))]]
                yield pa.RecordBatch.from_arrays([chunk.column(0), *(pa.array(c, pa.binary()) for c in columns)], ["node", "elements", "sketch"])

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", text_digest().alias("t"))
    texts = texts.groupBy("doc_id", "t").agg(F.first("text").alias("text"))  # equal rows, so any is right
    return common.join(texts, nodes, ["doc_id", "t"]).select("node", "text").mapInArrow(run, "node long, elements binary, sketch binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes). rows: doc_id, t, n and key of every row. classes: for each key of a row with a doc_id, the number
    `top` of its group, and the least doc_id of the group as `least`."""
    docs = docs.select("doc_id", "text")
    signs = common.materialize(signatures(docs, width), "signatures")
    real = signs.where("key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = real.groupBy("key").agg(F.min_by(F.struct("doc_id", "t", "bands"), "doc_id").alias("w"))
    # The number of a node is drawn once, when this table is written.
    nodes = common.materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "w.doc_id", "w.t", "w.bands"), "nodes")
    joined = links(docs, nodes, width, percent)
    label = components(joined)
    classes = common.join(nodes.select("node", "key", "doc_id"), label, "node", "left").select("key", "doc_id", F.coalesce("component", "node").alias("top"))
    least = classes.groupBy("top").agg(F.min("doc_id").alias("least"))
    classes = common.materialize(common.join(classes, least, "top").select("key", "top", "least"), "classes")
    common.discard(nodes, joined, label)
    return signs.select("doc_id", "t", "n", "key"), classes


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links, itself included), kept (it is that one).

    Links: Jaccard similarity of the shingle sets of at least `percent` hundredths, checked on full sets. A text of
    fewer words than `width` is one shingle; null, empty and wordless texts have none and stay alone. Repeated rows
    and rows of one doc_id with different texts each give a row, by its own text. A row with a null doc_id links with
    nothing and is kept, with a null component. Columns beyond doc_id and text are not read. An empty table gives an
    empty result.
    """
    rows, classes = grouped(docs, width, percent)
    out = common.join(rows, classes.select("key", "least"), "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each group of near-duplicates: the one of the least doc_id.

    Rows are told apart by doc_id and text, so a doc_id on several rows neither saves copies nor loses other texts: of
    equal least doc_ids the least digest of the text stays, and of rows that are equal in both one stays. Rows with a
    null doc_id, and rows of null, empty and wordless texts, all stay. An empty table gives an empty result."""
    rows, classes = grouped(docs, width, percent)
    real = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "t", "key").agg(F.count("*").alias("times"))
    real = common.materialize(common.join(real, classes, "key").select("doc_id", "t", "times", "top", "least"), "told_apart")
    # Only rows of a group's least doc_id can stay, so nothing is joined by the group over all of its rows.
    best = real.where("doc_id = least").groupBy("top").agg(F.min("t").alias("best"))
    mine = common.join(real.where("doc_id = least"), best, "top").withColumn("once", F.col("t") == F.col("best"))
    gone = real.where("doc_id <> least").select("doc_id", "t", F.lit(False).alias("once"))
    gone = common.materialize(gone.unionByName(mine.where("NOT once OR times > 1").select("doc_id", "t", "once")), "not_all_kept")
    name = "t" + "_" * max(map(len, docs.columns))  # no column of docs
    told = docs.withColumn(name, text_digest())
    known = told["doc_id"].isNotNull() & told[name].isNotNull()
    sure = told.where(known)  # the same rows and columns on both sides below, so texts are shuffled at most once
    on = lambda g: (sure["doc_id"] == g["doc_id"]) & (sure[name] == g["t"])
    once = gone.where("once")
    kept = common.join(sure, gone, on(gone), "left_anti").unionByName(common.join(sure, once, on(once), "left_semi").dropDuplicates(["doc_id", name])).unionByName(told.where(~known))
    return kept.select(common.columns(docs))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2)
