"""Fences of the quality rules follow what is usual in a group."""

import math
from collections import Counter, defaultdict

import numpy as np

from cairnlog.llm import common, rules


def test_fences_differ_between_groups(spark):
    rng = np.random.default_rng(12)
    text = lambda n, symbols: " ".join(["#" if k < symbols else f"w{rng.integers(10**6)}" for k in rng.permutation(n)])
    rows = [(k, text(100, 0), "en", "prose") for k in range(900)] + [(1000 + k, text(100, int(rng.integers(20, 40))), "en", "code") for k in range(60)]
    rows += [(2000, text(1000, 300), "en", "code"), (2001, text(1000, 300), "en", "prose"), (2002, text(1000, 60), "en", "prose"), (2003, text(20, 0).replace("w", "#", 2), "en", "prose")]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[2000].kept and not got[2001].kept and not got[2002].kept and got[2003].kept
    assert got[2000].hi_symbol_rate > got[2001].hi_symbol_rate + 0.2
    assert all(got[k].kept for k in range(900))


def test_fences_change_smoothly_with_the_count(spark):
    def fence(n):
        rows = [(k, "en", "big", 100, 1, 0.0) for k in range(400)] + [(1000 + k, "en", "own", 100, 1, 0.3 + 0.002 * (k % 50)) for k in range(n)]
        d = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, n_lines long, symbol_rate double")
        d = d.selectExpr("*", "false AS base_failed", "0D AS dup_line_rate", "0D AS repeat_rate", "0D AS stutter_rate", "5D AS mean_word")
        return next(r.hi_symbol_rate for r in rules.fences(d).collect() if r.source == "own")

    assert abs(fence(100) - fence(99)) < 0.01 and fence(20) < fence(100)


def plain_quantile(values, p):
    """The value of the bucket in which the share p of the values is reached."""
    bucket = lambda x: math.ceil(math.log(x) / math.log(rules.RATIO)) if x > 0 else None
    counts, upto = Counter(map(bucket, values)), 0
    for b in sorted(counts, key=lambda b: -(10**9) if b is None else b):
        upto += counts[b]
        if upto >= p * len(values):
            return 0.0 if b is None else rules.RATIO**b * 2 / (rules.RATIO + 1)


def test_verdicts_equal_a_plain_recomputation(spark, sf):
    rows = [r.asDict() for r in rules.judge(common.table(spark, sf, "documents")).collect()]
    good = [r for r in rows if not r["base_failed"]]
    of = defaultdict(list)
    for r in good:
        for key in ((r["lang"], r["source"]), (r["lang"],), ()):
            of[key].append(r)

    def at(key, c, p):
        parent = at(key[:-1], c, p) if key else None
        q = plain_quantile([r[c] for r in of[key]], p) if of[key] else None
        return q if not key else parent if q is None else (len(of[key]) * q + rules.LEAST_DOCS * parent) / (len(of[key]) + rules.LEAST_DOCS)

    def far(r, c, side, tail):
        own, lang = (r["lang"], r["source"]), (r["lang"],)
        return rules.FENCE * max(abs(at(own, c, side) - at(own, c, 0.5)), abs(at(lang, c, tail) - at(lang, c, 0.5)), 2 * rules.ERROR * at(own, c, 0.5))

    assert good and len(of) > 10
    for r in rows:
        kept = not r["base_failed"]
        for c, tail in rules.UPPER.items():
            fence = at((r["lang"], r["source"]), c, 0.5) + far(r, c, 0.75, tail)
            assert abs(fence - r[f"hi_{c}"]) < 1e-9
            n, unit = rules.SLACK.get(c, (0, "n_words"))
            kept = kept and r[c] is not None and r[c] <= fence + (n / r[unit] if r[unit] else 0) + 1e-12
        fence = at((r["lang"], r["source"]), "mean_word", 0.5) - far(r, "mean_word", 0.25, rules.LOWER["mean_word"])
        assert r["kept"] == (kept and r["mean_word"] >= fence - 1e-12)


def test_fences_do_not_depend_on_the_run(spark, sf):
    docs = common.table(spark, sf, "documents")
    one, two = ({tuple(r) for r in rules.judge(d).select("doc_id", "kept", "hi_symbol_rate", "lo_mean_word").collect()} for d in (docs, docs.repartition(7)))
    assert one == two


def test_sketch_error(spark):
    x = np.random.default_rng(19).lognormal(0, 2, 5000)
    d = spark.createDataFrame([(float(v),) for v in x], "v double").select(rules.value_of(rules.bucket_of(rules.F.col("v"))).alias("s"), "v")
    assert all(abs(r.s - r.v) <= rules.ERROR * 1.0001 * r.v for r in d.collect())
