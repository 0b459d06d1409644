"""Analyses of replicated logs: commit index, conflicts, reconciliation, application, votes.

Log rows are (node, idx, term, op, k, v), op 0 for a no-op. The traces that the queries use are synthetic: they are
derived from the events and orders tables by fixed arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlog.operators import versions
from cairnlog.sources.scratch import fixed

SNAPSHOT_TRIGGER = 128


def majority_index(acks: DataFrame) -> DataFrame:
    """(shard, idx): the highest index that a majority holds, from (shard, node, match). Members of a shard are few,
    so their list is short; shards are aggregated in parallel."""
    held = F.reverse(F.array_sort(F.collect_list("match")))
    return acks.groupBy("shard").agg(held.alias("m")).select("shard", F.element_at("m", (F.floor(F.size("m") / 2) + 1).cast("int")).alias("idx"))


def commit(acks: DataFrame, terms: DataFrame, current: DataFrame) -> DataFrame:
    """(shard, idx, committed): committed only if the entry at the majority index is of the current term."""
    j = majority_index(acks).join(terms, ["shard", "idx"], "left").join(current, "shard", "left")
    return j.select("shard", "idx", F.coalesce(F.col("term") == F.col("current"), F.lit(False)).alias("committed"))


def conflict(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(idx): the first index at which an offered log differs from the own one, or which the own one lacks."""
    t = theirs.alias("t").join(mine.alias("m"), "idx", "left")
    same = (F.col("m.term") == F.col("t.term")) & (F.col("m.op") == F.col("t.op")) & (F.col("m.k") == F.col("t.k")) & (F.col("m.v") == F.col("t.v"))
    return t.where(~F.coalesce(same, F.lit(False))).agg(F.min("idx").alias("idx"))


def reconcile(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """The own log after accepting the offered one: own entries before the first conflict, offered ones from there on;
    with no conflict the own log stays whole."""
    at = F.broadcast(conflict(mine, theirs).select(F.col("idx").alias("cut")))  # one row
    kept = mine.crossJoin(at).where(F.col("cut").isNull() | (F.col("idx") < F.col("cut"))).drop("cut")
    new = theirs.crossJoin(at).where(F.col("idx") >= F.col("cut")).drop("cut")
    return kept.unionByName(new)


def violations(log: DataFrame, current: int, longest: int = 1 << 20) -> DataFrame:
    """(node, idx, what) of entries that break an invariant: a term that falls or is beyond the current one, a delete
    with a value, a no-op with content, content over the limit, an index that skips."""
    w = W.partitionBy("node").orderBy("idx")
    seen = log.withColumns({"before": F.lag("term").over(w), "prev": F.lag("idx").over(w)})
    size = F.octet_length("k") + F.octet_length("v")
    rules = {
        "term_falls": F.col("term") < F.col("before"),
        "term_beyond": F.col("term") > current,
        "delete_value": (F.col("op") == 2) & (F.col("v") != ""),
        "noop_content": (F.col("op") == 0) & (size > 0),
        "too_long": size > longest,
        "index_gap": F.col("idx") != F.col("prev") + 1,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return seen.select("node", "idx", F.explode(found).alias("what"))


def applied(log: DataFrame, after: int, upto: int) -> DataFrame:
    """The live image that entries in (after, upto] alone give; no-ops are skipped."""
    rows = log.where(F.col("idx").between(after + 1, upto) & (F.col("op") != 0))
    return versions.newest(rows, "k", rank="idx").select("k", "op", "v")


def snapshot_plus(image: DataFrame, suffix: DataFrame) -> DataFrame:
    """A live image (k, v) overlaid by newer changes (k, op, v), deletes included."""
    both = image.select("k", F.lit(1).alias("op"), "v", F.lit(0).alias("layer")).unionByName(suffix.select("k", "op", "v", F.lit(1).alias("layer")))
    return both.groupBy("k").agg(F.max_by(F.struct("op", "v"), "layer").alias("w")).where("w.op = 1").select("k", "w.v")


def install(image: DataFrame, current: DataFrame) -> DataFrame:
    """(k, op, v): the changes that turn the current image into the given one."""
    a, b = image.select("k", F.col("v").alias("new")), current.select("k", F.col("v").alias("old"))
    j = a.join(b, "k", "full")
    return j.where(F.col("new").isNull() | F.col("old").isNull() | (F.col("new") != F.col("old"))).select(
        "k", F.when(F.col("new").isNull(), 2).otherwise(1).alias("op"), F.coalesce("new", F.lit("")).alias("v")
    )


def election(votes: DataFrame, members: int) -> DataFrame:
    """(term, candidate, votes, elected) from granted votes: distinct voters over half of the members."""
    n = votes.where("granted").groupBy("term", "candidate").agg(F.countDistinct("voter").alias("votes"))
    return n.withColumn("elected", F.col("votes") > members // 2)


def fresh(own_term, own_idx):
    """Whether a candidate's (last_term, last_idx) is at least the own one, term first."""
    return F.struct("last_term", "last_idx") >= F.struct(own_term, own_idx)


def one_vote_a_term(requests: DataFrame) -> DataFrame:
    """(voter, term, candidate): the first fresh request of a term gets the vote."""
    return requests.where(fresh(F.col("own_term"), F.col("own_idx"))).groupBy("voter", "term").agg(F.min_by("candidate", "seq").alias("candidate"))


def entries_from(log: DataFrame, start: int, limit: int) -> DataFrame:
    """(idx, term, op, k, v, prev_term): a bounded slice of one log with the term before it."""
    before = F.coalesce(F.lag("term").over(W.orderBy("idx")), F.lit(0))
    return log.where(F.col("idx").between(start - 1, start + limit - 1)).withColumn("prev_term", before).where(F.col("idx") >= start)  # limit rows


def catch_up(acks: DataFrame, batch: int = 8) -> DataFrame:
    """(shard, node, gap, batches) that each replica lacks against the longest one of its shard."""
    last = acks.groupBy("shard").agg(F.max("match").alias("last"))
    j = acks.join(last, "shard").withColumn("gap", F.col("last") - F.col("match"))
    return j.select("shard", "node", "gap", F.ceil(F.col("gap") / batch).alias("batches"))


def quantiles(rows: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """(name, v): exact order statistics at floor(q * (n - 1)). Distinct values are counted and dealt out in ranges; sums
    over ranges tell in which one a point lies, and only those ranges are ordered."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    dealt = fixed(seen.repartitionByRange("v").withColumn("pid", F.spark_partition_id()))  # bounds come from a sample
    sums = dealt.groupBy("pid").agg(F.sum("c").alias("s"))
    sums = sums.select("pid", (F.sum("s").over(W.orderBy("pid")) - F.col("s")).alias("base"), "s")  # a row for each range
    n = dealt.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    asked = rows.sparkSession.createDataFrame(list(points.items()), "name string, q double")
    place = asked.crossJoin(F.broadcast(n)).select("name", F.floor(F.col("q") * (F.col("n") - 1)).alias("at"))  # one row
    where = sums.join(F.broadcast(place), (F.col("at") >= F.col("base")) & (F.col("at") < F.col("base") + F.col("s")))  # a few points
    upto = dealt.join(F.broadcast(where), "pid").withColumn("upto", F.col("base") + F.sum("c").over(W.partitionBy("name").orderBy("v")))
    return upto.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c"))).select("name", "v")


def append_outcomes(log: DataFrame, requests: DataFrame, entries: DataFrame, term: int, committed: int, base: int = 0, longest: int = 1 << 20, most: int = 256) -> DataFrame:
    """(req, outcome, match, cut): what a member with `log` (idx, term, op, k, v) answers to each request, one by one.

    A request is (req, term, prev_idx, prev_term); its entries are (req, pos from 1, term, op, k, v). Outcomes, the first
    that holds: invalid_request (too many entries, a previous term beyond the request's), invalid_entry (terms that fall
    or pass the request's, unknown op, content where none may be, too long), stale_term, no_match (of the entry before),
    differs (an own entry of the same term has other content), committed (it would rewrite a committed entry), accepted.
    Accepted requests have match, the last index that now agrees, and cut, the index from which entries are stored (null
    if the log holds all). Requests without entries are probes of the previous entry."""
    size = F.octet_length("k") + F.octet_length("v")
    before = F.coalesce(F.lag("term").over(W.partitionBy("req").orderBy("pos")), F.col("prev_term"))
    e = entries.join(requests.select("req", F.col("term").alias("of"), "prev_idx", "prev_term"), "req").withColumn("before", before)
    bad = (F.col("term") < F.col("before")) | (F.col("term") > F.col("of")) | ~F.col("op").isin(0, 1, 2) | ((F.col("op") == 0) & (size > 0))
    bad = bad | ((F.col("op") == 2) & (F.octet_length("v") > 0)) | (size > longest)
    e = e.withColumn("at", F.col("prev_idx") + F.col("pos"))
    own = log.select(F.col("idx").alias("at"), F.col("term").alias("t"), F.col("op").alias("o"), F.col("k").alias("key"), F.col("v").alias("value"))
    j = e.join(own, "at", "left")
    same = (F.col("t") == F.col("term")) & (F.col("o") == F.col("op")) & (F.col("key") == F.col("k")) & (F.col("value") == F.col("v"))
    off = F.when(~F.coalesce(same, F.lit(False)), F.struct("at", (F.coalesce(F.col("t"), F.lit(-1)) == F.col("term")).alias("clash"), F.col("t").isNotNull().alias("held")))
    told = j.groupBy("req").agg(F.count("*").alias("n"), F.max(bad).alias("bad"), F.min(off).alias("off"))
    previous = log.select(F.col("idx").alias("prev_idx"), F.col("term").alias("own_prev"))
    r = requests.join(previous, "prev_idx", "left").join(told, "req", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fits = F.coalesce(F.when(F.col("prev_idx") == 0, F.lit(0)).otherwise(F.col("own_prev")) == F.col("prev_term"), F.lit(False)) & (F.col("prev_idx") >= base)
    outcome = (
        F.when((F.col("n") > most) | (F.col("prev_term") > F.col("term")) | (F.col("term") < 1), "invalid_request")
        .when(F.col("bad"), "invalid_entry")
        .when(F.col("term") < term, "stale_term")
        .when(~fits, "no_match")
        .when(F.col("off.clash"), "differs")
        .when(F.col("off.held") & (F.col("off.at") <= committed), "committed")
        .otherwise("accepted")
    )
    r = r.withColumn("outcome", outcome)
    ok = F.col("outcome") == "accepted"
    return r.select("req", "outcome", F.when(ok, F.col("prev_idx") + F.col("n")).alias("match"), F.when(ok, F.col("off.at")).alias("cut"))


def install_outcomes(requests: DataFrame, term: int, committed: int) -> DataFrame:
    """(req, outcome, match, drops_log): what a member answers to each offered snapshot (req, term, snap_idx, snap_term).
    A snapshot at or under the own commit changes nothing and succeeds at the own commit; a newer one replaces the image
    and drops the whole log."""
    bad = (F.col("term") < 1) | (F.col("snap_idx") < 1) | (F.col("snap_term") < 1) | (F.col("snap_term") > F.col("term"))
    outcome = F.when(bad, "invalid_request").when(F.col("term") < term, "stale_term").when(F.col("snap_idx") <= committed, "held").otherwise("installed")
    match = F.when(F.col("outcome") == "held", F.lit(committed)).when(F.col("outcome") == "installed", F.col("snap_idx"))
    return requests.withColumn("outcome", outcome).select("req", "outcome", match.alias("match"), (F.col("outcome") == "installed").alias("drops_log"))


def vote_trace(requests: DataFrame) -> DataFrame:
    """(voter, seq, current, demoted, granted) of vote requests (voter, seq, term, candidate, last_term, last_idx, own_term,
    own_idx), each voter's in order of seq: a higher term demotes the voter and frees its vote; a request of an older term
    is refused; the first fresh candidate of a term has the vote and keeps it when it asks again. A voter's trace is
    sorted by one task, which may spill."""
    order = W.partitionBy("voter").orderBy("seq")
    current = F.max("term").over(order)
    r = requests.withColumn("current", current).withColumn("demoted", F.col("term") > F.coalesce(F.max("term").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    fits = (F.col("term") == F.col("current")) & fresh(F.col("own_term"), F.col("own_idx"))
    chosen = F.min(F.when(fits, F.struct("seq", "candidate"))).over(W.partitionBy("voter", "term"))
    return r.withColumn("chosen", chosen).select("voter", "seq", "current", "demoted", (fits & (F.col("chosen.candidate") == F.col("candidate"))).alias("granted"))


def leaders_open_with_noop(log: DataFrame) -> DataFrame:
    """(term, idx, ok): the first entry of each term, and whether it is the no-op that a new leader appends."""
    return log.groupBy("term").agg(F.min(F.struct("idx", "op")).alias("f")).select("term", "f.idx", (F.col("f.op") == 0).alias("ok"))


def numbered(log: DataFrame, commands: DataFrame, term: int) -> DataFrame:
    """(idx, term, op, k, v): commands (seq, op, k, v) as the entries that a leader appends, in order of seq. Counts of
    ranges of seq are added up first, so no task orders all commands."""
    spread = commands.agg(F.ceil(F.sqrt(F.count("*"))).alias("w"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / F.greatest("w", F.lit(1))), F.lit(1))
    c = commands.crossJoin(F.broadcast(spread.select("lo", width.alias("width")))).withColumn("part", F.floor((F.col("seq") - F.col("lo")) / F.col("width")))  # one row
    parts = c.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    last = F.broadcast(log.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last")))  # one row
    c = c.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy("seq"))).join(parts, "part").crossJoin(last)
    return c.select((F.col("last") + F.col("base") + F.col("own")).alias("idx"), F.lit(term).cast("long").alias("term"), "op", "k", "v")


def matched(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, status, value) of every request, by the response of its id: status is null where none came. Responses of ids
    that nobody asked for go; of several for one id the first counts (by `at`, which may be a struct; of those with one
    `at` the least status, then the least value, so every run gives the same). A field that is null there comes from the
    first response that has it, as with arg_min in SQL; a response with a null `at` does not count."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("at", "status", "value")))[c].alias(c)
    told = responses.where(F.col("at").isNotNull()).groupBy("id").agg(first("status"), first("value"))
    return requests.select("id").distinct().join(told, "id", "left").select("id", "status", "value")


def limits(log: DataFrame, known: tuple[int, ...] = (0, 1, 2), longest: int = 1 << 20, first: int = 1, last: int | None = None) -> DataFrame:
    """(node, idx, what) of entries with an unknown operation, content over the limit, or an index outside of first..last
    (the entry after the snapshot, and the end of the log)."""
    rules = {
        "unknown_op": ~F.col("op").isin(*known),
        "too_long": F.octet_length("k") + F.octet_length("v") > longest,
        "past_bounds": (F.col("idx") < first) | (F.lit(False) if last is None else F.col("idx") > last),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return log.select("node", "idx", F.explode(found).alias("what"))
