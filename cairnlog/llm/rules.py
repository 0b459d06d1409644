"""Operator 2: quality rules with adaptive thresholds, in DataFrame functions only.

Document statistics are one projection. Their distributions per language and source are quantile sketches of logarithmic
buckets: a sketch is the counts of its buckets, so sketches merge by adding counts, before and after the shuffle (a hot
source costs no more than another), in any order with the same result, and a quantile is right within `ERROR` of its
value. The same documents always get the same fences. Quantiles of a group are blended with those of its language, and those of a language with those of all, by the number of documents.
A fence lies around the group's own median, as far as the group's quartile or the language's tail is wide (or a bucket), and a join
on the small table of fences filters. The median and quartile withstand junk in up to a quarter of a group, the tail
in up to 1 - `level` of a language. No rate is fixed: what is left beside the sketches is a few occurrences.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlog.llm import common

#: Statistic -> level of the language's tail. Most texts repeat no line and no passage: only a far tail shows those that do.
UPPER = {"symbol_rate": 0.9, "dup_line_rate": 0.98, "repeat_rate": 0.98, "stutter_rate": 0.9, "mean_word": 0.9}
LOWER = {"mean_word": 0.1}
#: Statistic -> occurrences that a short text may have beyond its fence, and what they are counted in. One repeat of eight words covers 16.
SLACK = {"symbol_rate": (2, "n_words"), "dup_line_rate": (1, "n_lines"), "repeat_rate": (16, "n_words"), "stutter_rate": (2, "n_words")}
#: A fence is `FENCE` widths away; a parent's quantiles weigh as much as `LEAST_DOCS` documents.
FENCE, LEAST_DOCS, ERROR = 5.0, 25, 0.0005
#: Ratio of neighbouring bucket edges for that error.
RATIO = (1 + ERROR) / (1 - ERROR)
ZERO = -1_000_000  # the bucket of zero


def sized(words: str) -> Column:
    return F.size(words).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutters (words equal
    to the one before) of whole texts.

    Null or empty text: all zero. Repeated rows and null ids stay. Extra columns are not read."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, common.SPACE, "")) > 0)
    d = docs.select(
        "doc_id", "lang", "source",
        F.length(F.translate(text, common.SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h"),
    )
    at = lambda i, k: F.get("h", i + k)
    starts = F.when(F.size("h") >= 8, F.sequence(F.lit(0), F.size("h") - 8)).otherwise(F.array().cast("array<int>"))
    d = d.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", sized("h").alias("n_words"), sized("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("h", lambda x, i: (i > 0) & (x == F.get("h", i - 1)))).cast("long").alias("n_stutters"),
        F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(8)])).alias("w"),
    )
    repeats = F.size("w") > F.size(F.array_distinct("w"))
    ranked = F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(repeats, ranked))
    same = lambda j, k: F.get("s", j)["x"] == F.get("s", j + k)["x"]
    again = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.coalesce(same(j, -1), F.lit(False)) | F.coalesce(same(j, 1), F.lit(False)))
    d = d.drop("w").withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(again, lambda j: F.get("s", j)["i"])))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(8), F.coalesce(F.get("p", k + 1) - x, F.lit(8)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def rates(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the rates that the fences judge; those of a text without words are null."""
    words = F.nullif(F.col("n_words"), F.lit(0))
    return stats.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "stutter_rate": F.col("n_stutters") / words,
        "mean_word": F.col("word_chars") / words,
    })


def bucket_of(x: Column) -> Column:
    """The sketch bucket of a value that is not negative: b holds RATIO^(b - 1) < x <= RATIO^b."""
    return F.when(x > 0, F.ceil(F.log(x) / math.log(RATIO)).cast("int")).otherwise(ZERO)


def value_of(bucket: Column) -> Column:
    """The value that stands for a bucket."""
    return F.when(bucket == ZERO, 0.0).otherwise(F.pow(F.lit(RATIO), bucket) * (2 / (RATIO + 1)))


def quantiles(sketch: DataFrame, by: list[str], levels: dict[str, list[float]]) -> DataFrame:
    """(by..., n, <stat>_<percent>...) from sketch rows (by..., stat, bucket, c), merged over all other columns. A level's
    quantile is the first bucket at which that share of the count is reached."""
    merged = sketch.groupBy(*by, "stat", "bucket").agg(F.sum("c").alias("c"))
    group = W.partitionBy(*by, "stat")  # at most some ten thousand buckets, whatever the count
    ranked = merged.withColumns({"n": F.sum("c").over(group), "upto": F.sum("c").over(group.orderBy("bucket"))})
    at = lambda c, p: F.min(F.when((F.col("stat") == c) & (F.col("upto") >= p * F.col("n")), value_of(F.col("bucket"))))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[at(c, p).alias(f"{c}_{int(p * 100)}") for c in levels for p in levels[c]])


def fences(rated: DataFrame) -> DataFrame:
    """lang, source, hi_<rate>, lo_<rate>: per language and source, from the documents that pass the base rules."""
    names = list(UPPER)
    levels = {c: sorted({0.25, 0.5, 0.75, UPPER[c], LOWER.get(c, 0.5)}) for c in names}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), bucket_of(F.col(c)).alias("bucket")) for c in names])).alias("x")
    sketch = rated.where(~F.col("base_failed")).select("lang", "source", each).select("lang", "source", "x.*")
    sketch = sketch.groupBy("lang", "source", "stat", "bucket").agg(F.count("*").alias("c"))
    merged = lambda by: quantiles(sketch, by, levels)
    columns = F.struct("n", *[f"{c}_{int(p * 100)}" for c in names for p in levels[c]])
    lang = merged(["lang"]).select(F.col("lang").alias("lang_l"), columns.alias("of_lang"))
    every = merged([]).select(columns.alias("of_all"))
    own = merged(["lang", "source"]).select("lang", "source", columns.alias("own"))
    groups = rated.select("lang", "source").distinct()
    g = groups.alias("g").join(own.alias("o"), F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left")
    g = g.select("g.lang", "g.source", "o.own")
    g = g.join(lang, g["lang"].eqNullSafe(lang["lang_l"]), "left").join(F.broadcast(every))  # `every` is one row

    def blended(of: str, at: str, parent: Column) -> Column:
        n = F.col(of)["n"]
        return F.coalesce((n * F.col(of)[at] + LEAST_DOCS * parent) / (n + LEAST_DOCS), parent)

    of_lang = lambda c, at: blended("of_lang", f"{c}_{int(at * 100)}", F.col("of_all")[f"{c}_{int(at * 100)}"])
    of_own = lambda c, at: blended("own", f"{c}_{int(at * 100)}", of_lang(c, at))
    far = lambda c, side, tail: FENCE * F.greatest(
        F.abs(of_own(c, side) - of_own(c, 0.5)), F.abs(of_lang(c, tail) - of_lang(c, 0.5)), 2 * ERROR * of_own(c, 0.5)
    )
    return g.select(
        "lang", "source",
        *[(of_own(c, 0.5) + far(c, 0.75, tail)).alias(f"hi_{c}") for c, tail in UPPER.items()],
        *[(of_own(c, 0.5) - far(c, 0.25, tail)).alias(f"lo_{c}") for c, tail in LOWER.items()],
    )


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept of every row of `docs`.

    Null lang and null source are groups of their own. If no document passes the base rules there is no fence and
    none is kept. Repeated rows and null ids are judged like others, columns beyond doc_id, text, lang and source are not
    read, and an empty table gives an empty result. Windows of eight words are compared by 64-bit hashes, so two
    different ones of a text count as equal with a chance of 2^-64 for each pair.
    """
    rated = rates(common.materialize(statistics(docs), "rule_statistics"))
    limits = fences(rated)
    j = rated.alias("r").join(limits.alias("f"), F.col("r.lang").eqNullSafe(F.col("f.lang")) & F.col("r.source").eqNullSafe(F.col("f.source")), "left")
    slack = {c: n / F.nullif(F.col(f"r.{of}"), F.lit(0)) for c, (n, of) in SLACK.items()}
    within = [F.col(f"r.{c}") <= F.col(f"f.hi_{c}") + slack.get(c, F.lit(0.0)) for c in UPPER] + [F.col(f"r.{c}") >= F.col(f"f.lo_{c}") for c in LOWER]
    held = ~F.col("r.base_failed")
    for w in within:
        held = held & F.coalesce(w, F.lit(False))
    return j.select("r.*", *[f"f.hi_{c}" for c in UPPER], *[f"f.lo_{c}" for c in LOWER], held.alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules over all documents."""
    return judge(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "symbol_rate", "dup_line_rate", "repeat_rate", "stutter_rate", "mean_word",
    )
