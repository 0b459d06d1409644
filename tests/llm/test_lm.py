"""The language model against plain counting and a plain recomputation of its scores."""

import math
from collections import Counter

import numpy as np
import pytest

from cairnlog.llm import cells, lm


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(13)
    return [" ".join(f"w{rng.integers(600)}" for _ in range(20)) + f" left{k % 300} right{k % 300}" for k in range(900)]


def pair_key(a, b, shift):
    h = lm.word_hashes([a, b])
    return int(lm.pair_keys(h, np.array([0, 2]))[1]) >> shift


def test_pairs_of_rare_words_are_counted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = Counter(p for t in texts for p in zip([lm.END, *lm.tokens(t)], lm.tokens(t), strict=False))
    total = sum(want.values())
    pairs = lm.count_pairs(docs, total, per_part=2000)
    got, parts = Counter(), set()
    for r in pairs.cells.collect():
        keys = cells.unpack_keys(bytes(r.keys), pairs.shift)
        assert (cells.part_of(keys, pairs.parts) == r.part).all()
        parts.add(r.part)
        got.update(dict(zip((keys >> np.uint64(pairs.shift)).tolist(), cells.unpack(bytes(r.n)).tolist(), strict=True)))
    assert len(parts) == pairs.parts == 11
    folded = Counter()
    for (a, b), n in want.items():
        folded[pair_key(a, b, pairs.shift)] += n
    assert got == folded and len(folded) > 0.99 * len(want)


@pytest.mark.parametrize("head", [400, 10_000])  # pairs of words outside the head, and inside
def test_scores_equal_a_plain_recomputation(spark, texts, head, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 5000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = Counter(p for t in texts for p in zip([lm.END, *lm.tokens(t)], lm.tokens(t), strict=False))
    counts = lm.count_tokens(docs).cache()
    model = lm.learn(docs, counts, head)
    asked = [(1, "left250 right250"), (2, "left250 right251"), (3, "never seen"), (4, "left250 never"), (5, None), (6, texts[7]), (6, texts[8])]
    pairs = lm.count_pairs(docs, model.vocab.total, per_part=3000)
    rows = lm.score(spark.createDataFrame(asked, "doc_id long, text string"), counts, pairs, model).collect()
    c, v = {r.word: r.c for r in counts.collect()}, model.vocab
    find, buckets, classes = {w: k for k, w in enumerate(v.words)}, v.buckets(), np.append(v.classes, 0)
    expected = Counter()
    for i, text in asked:
        w = lm.tokens(text)
        ids = [find.get(x, -1) for x in w]
        s = known = base = 0
        for k, x in enumerate(w):
            cls = lambda j: int(classes[ids[j]]) if j >= 0 else lm.LAST
            one = int(buckets[ids[k - 1]]) if k else lm.OWN + lm.LAST
            h = (one * lm.CLASSES + cls(k - 2)) * lm.CLASSES + cls(k - 3)
            q = 10 ** float(model.table[h, cls(k)] + model.inside[ids[k]]) * (1 if ids[k] >= 0 else c.get(x, 0) + 1)
            before = w[k - 1] if k else lm.END
            s += math.log10((want[before, x] + lm.PRIOR * q) / (c.get(before, 0) + lm.PRIOR))
            known += c.get(x, 0) > 0
            base += math.log10((c.get(x, 0) + 1) / (v.total + v.distinct + 1))
        expected[i, len(w), known, round(base, 3), round(s, 3)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3), round(r.score, 3)) for r in rows) == expected
    got = {r.doc_id: r.score for r in rows}
    assert got[1] > got[2] + 0.5


def test_packed_numbers_come_back():
    rng = np.random.default_rng(16)
    for x in (np.zeros(0, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64), rng.integers(0, 2**40, 5000).astype(np.uint64)):
        assert (cells.unpack(cells.pack(x)) == x).all()
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) >> np.uint64(20) << np.uint64(20))
    assert (cells.unpack_keys(cells.pack_keys(keys, 20), 20) == keys).all()
    assert (np.diff(cells.part_of(keys, 37)) >= 0).all()
