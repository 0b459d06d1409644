import random

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from cairnlog.operators import folds


def fold(sizes, limit, held=0):
    piece, out = 0, []
    for s in sizes:
        if held >= limit:
            piece, held = piece + 1, 0
        held += s
        out.append(piece)
    return out, held


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 60), st.integers(0, 90))
def test_behaviour_tells_what_a_fold_does(sizes, limit, entered):
    pieces, left = fold(sizes, limit, entered)
    at = folds.starts_of(np.array(sizes, np.int64), entered, limit)
    assert [int((at <= i).sum()) for i in range(len(sizes))] == pieces
    hit = [b for b in folds.behaviour(np.array(sizes, np.int64), limit) if b[0] <= entered <= b[1]]
    assert (hit[0][2], hit[0][3]) == (pieces[-1], left) if hit else (pieces[-1] == 0 and left == entered + sum(sizes))


def test_pieces_over_partitions(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(0, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, b long").repartition(5)
    got = {r.seq: r.piece for r in folds.reset_pieces(df, ["seq"], "b", 100).collect()}
    assert [got[i] for i in range(3000)] == fold([b for _, b in rows], 100)[0]


def test_no_rows(spark):
    assert folds.reset_pieces(spark.createDataFrame([], "seq long, b long"), ["seq"], "b", 100).count() == 0
