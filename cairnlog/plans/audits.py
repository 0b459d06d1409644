"""More registered queries with their SQL: table files, log rules with refusals, and inputs that hold faults.

Added to those of catalog.py. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlog.functions import text
from cairnlog.operators import replicas, segments, versions
from cairnlog.operators.versions import change_log
from cairnlog.plans.catalog import BROKEN, LOGS, NEWEST, TABLES, customer_keys, logs, query, tables
from cairnlog.sources import tablefile

NUM = "CAST(substr(k, 1, 1) AS BIGINT)"


def files(spark, d):
    """The newest row of each key as table files by first digit."""
    return tablefile.encoded(versions.newest(change_log(spark, d), "k").withColumn("num", F.substring("k", 1, 1).cast("long")))


@query("sstable_scan", f"WITH {NEWEST} SELECT {NUM} AS num, k, op, v FROM newest")
def sstable_scan(spark, d):
    """Table files written and read back, block by block."""
    return tablefile.scan(files(spark, d)).select("num", F.col("key").cast("string").alias("k"), "op", F.col("value").cast("string").alias("v"))


@query("sstable_get", f"WITH {NEWEST}, p AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer) SELECT p.k, n.op, n.v FROM p LEFT JOIN newest n ON p.k = n.k")
def sstable_get(spark, d):
    """Lookups by Bloom filter, index and block; most keys are absent."""
    asked = customer_keys(spark, d).select("k", F.substring("k", 1, 1).cast("long").alias("num"), F.col("k").alias("key"))
    return tablefile.probe(files(spark, d), asked).select(F.col("key").cast("string").alias("k"), "op", F.col("value").cast("string").alias("v"))


#: Requests of eight kinds, each with up to four entries: 0 as held, 1 wrong previous term, 2 other content in the same
#: term, 3 newer terms, 4 an old term, 5 a no-op with content, 6 beyond the end, 7 a term that falls.
OFFERS = f"""{LOGS}, m AS (SELECT max(idx) AS last, (max(idx) * 6) // 10 AS cm FROM node1),
r AS (SELECT idx // 50 AS req, (idx // 50) % 8 AS kind, idx + CASE WHEN (idx // 50) % 8 = 6 THEN 1000000 ELSE 0 END AS prev_idx, term + CASE WHEN (idx // 50) % 8 = 1 THEN 1 ELSE 0 END AS prev_term, CASE WHEN (idx // 50) % 8 = 4 THEN 500 ELSE 1000 END AS term, idx FROM node1 WHERE idx % 50 = 0),
e AS (SELECT r.req, n.idx - r.idx AS pos, CASE WHEN kind = 3 THEN n.term + 1 WHEN kind = 7 AND n.idx - r.idx = 2 THEN 0 ELSE n.term END AS term, CASE WHEN kind = 5 AND n.idx - r.idx = 3 THEN 0 ELSE op END AS op, CASE WHEN kind = 2 AND n.idx - r.idx = 2 THEN k || 'x' ELSE k END AS k, v FROM r JOIN node1 n ON n.idx > r.idx AND n.idx <= r.idx + 4),
x AS (SELECT e.*, r.term AS of, r.prev_idx + pos AS at, coalesce(lag(e.term) OVER (PARTITION BY e.req ORDER BY pos), r.prev_term) AS before FROM e JOIN r ON e.req = r.req),
y AS (SELECT x.req, count(*) AS n, bool_or(x.term < before OR x.term > of OR (x.op = 0 AND strlen(x.k) + strlen(x.v) > 0) OR (x.op = 2 AND x.v <> '')) AS bad,
  min(CASE WHEN o.idx IS NULL OR o.term <> x.term OR o.op <> x.op OR o.k <> x.k OR o.v <> x.v THEN x.at END) AS off FROM x LEFT JOIN node1 o ON o.idx = x.at GROUP BY x.req),
z AS (SELECT r.*, coalesce(y.n, 0) AS n, y.bad, y.off, p.term AS own_prev, o.term AS own_off, f.term AS new_off FROM r LEFT JOIN y ON y.req = r.req LEFT JOIN node1 p ON p.idx = r.prev_idx LEFT JOIN node1 o ON o.idx = y.off LEFT JOIN x f ON f.req = r.req AND f.at = y.off),
w AS (SELECT req, CASE WHEN bad THEN 'invalid_entry' WHEN term < 900 THEN 'stale_term' WHEN own_prev IS NULL OR own_prev <> prev_term THEN 'no_match' WHEN own_off = new_off THEN 'differs' WHEN own_off IS NOT NULL AND off <= cm THEN 'committed' ELSE 'accepted' END AS outcome, prev_idx + n AS m, off FROM z, m)"""


@query("append_outcomes", f"WITH {OFFERS} SELECT req, outcome, CASE WHEN outcome = 'accepted' THEN m END AS match, CASE WHEN outcome = 'accepted' THEN off END AS cut FROM w")
def append_outcomes(spark, d):
    """Offered entries that a member accepts, and refusals of each kind."""
    log = logs(spark, d)[0]
    req, kind = F.floor(F.col("idx") / 50), F.floor(F.col("idx") / 50) % 8
    r = log.where("idx % 50 = 0").select(
        req.alias("req"), kind.alias("kind"), "idx", (F.col("idx") + F.when(kind == 6, 1000000).otherwise(0)).alias("prev_idx"),
        (F.col("term") + F.when(kind == 1, 1).otherwise(0)).alias("prev_term"), F.when(kind == 4, 500).otherwise(1000).alias("term"),
    )
    offered = r.select("req", "kind", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos"), "idx").withColumn("idx", F.col("idx") + F.col("pos")).join(log, "idx")
    k, at = F.col("kind"), F.col("pos")
    e = offered.select(
        "req", "pos", F.when(k == 3, F.col("term") + 1).when((k == 7) & (at == 2), 0).otherwise(F.col("term")).alias("term"),
        F.when((k == 5) & (at == 3), 0).otherwise(F.col("op")).alias("op"), F.when((k == 2) & (at == 2), F.concat("k", F.lit("x"))).otherwise(F.col("k")).alias("k"), "v",
    )
    last = log.agg(F.max("idx")).first()[0] or 0
    return replicas.append_outcomes(log, r.drop("kind", "idx"), e, 900, last * 6 // 10)


@query("install_outcomes", """WITH q AS (SELECT o_orderkey AS req, o_orderkey % 13 AS term, o_orderkey % 100 AS i, 1 + o_orderkey % 7 AS t FROM orders),
o AS (SELECT *, CASE WHEN term < 1 OR i < 1 OR t > term THEN 'invalid_request' WHEN term < 5 THEN 'stale_term' WHEN i <= 40 THEN 'held' ELSE 'installed' END AS outcome FROM q)
SELECT req, outcome, CASE outcome WHEN 'held' THEN 40 WHEN 'installed' THEN i END AS match, outcome = 'installed' AS drops_log FROM o""")  # fmt: skip
def install_outcomes(spark, d):
    k = F.col("o_orderkey")
    q = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("req"), (k % 13).alias("term"), (k % 100).alias("snap_idx"), (1 + k % 7).alias("snap_term"))
    return replicas.install_outcomes(q, 5, 40)


TRACE = "t AS (SELECT event_id AS seq, user_id % 5 AS voter, 1 + event_id // 10 - (event_id % 7) // 5 AS term, user_id % 7 AS candidate, event_id % 4 AS lt, user_id AS li FROM events)"


@query("vote_trace", f"""WITH {TRACE}, c AS (SELECT *, max(term) OVER (PARTITION BY voter ORDER BY seq) AS current, coalesce(max(term) OVER (PARTITION BY voter ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM t),
f AS (SELECT *, term = current AND (lt > 2 OR (lt = 2 AND li >= 75)) AS fits FROM c), g AS (SELECT voter, term, min_by(candidate, seq) AS chosen FROM f WHERE fits GROUP BY voter, term)
SELECT f.voter, f.seq, f.current, f.term > f.prior AS demoted, f.fits AND coalesce(g.chosen = f.candidate, FALSE) AS granted FROM f LEFT JOIN g ON f.voter = g.voter AND f.term = g.term""")  # fmt: skip
def vote_trace(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    t = spark.read.parquet(f"{d}/events.parquet").select(
        e.alias("seq"), (u % 5).alias("voter"), (1 + F.floor(e / 10) - F.floor(e % 7 / 5)).alias("term"), (u % 7).alias("candidate"),
        (e % 4).alias("last_term"), u.alias("last_idx"), F.lit(2).cast("long").alias("own_term"), F.lit(75).cast("long").alias("own_idx"),
    )
    r = replicas.vote_trace(t)
    return r.withColumn("granted", F.coalesce("granted", F.lit(False)))


@query("leader_noops", f"WITH {LOGS} SELECT term, min(idx) AS idx, arg_min(CASE WHEN idx % 2000 = 0 THEN 0 ELSE op END, idx) = 0 AS ok FROM node1 GROUP BY term")
def leader_noops(spark, d):
    """Every second term begins with a no-op, the others break the rule."""
    return replicas.leaders_open_with_noop(logs(spark, d)[0].withColumn("op", F.when(F.col("idx") % 2000 == 0, 0).otherwise(F.col("op"))))


@query("propose_numbers", f"WITH {LOGS} SELECT c + row_number() OVER (ORDER BY idx) AS idx, CAST(99 AS BIGINT) AS term, op, k, v FROM node1, c WHERE idx > c")
def propose_numbers(spark, d):
    """Commands after the first seven tenths of the log, numbered as a leader appends them."""
    log = logs(spark, d)[0]
    cut = F.broadcast(log.agg(F.floor(F.max("idx") * 7 / 10).alias("c")))  # one row
    parted = log.crossJoin(cut)
    return replicas.numbered(parted.where("idx <= c"), parted.where("idx > c").select(F.col("idx").alias("seq"), "op", "k", "v"), 99)


@query("response_match", """WITH q AS (SELECT DISTINCT o_orderkey AS id FROM orders), s AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS INTEGER) AS status, 'v' || o_custkey AS value, o_orderkey * 2 AS tick FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT o_orderkey, 2, 'late', o_orderkey * 2 + 1 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT -o_orderkey, 0, 'stray', 1 FROM orders), f AS (SELECT id, arg_min(status, tick) AS status, arg_min(value, tick) AS value FROM s GROUP BY id)
SELECT q.id, f.status, f.value FROM q LEFT JOIN f ON q.id = f.id""")  # fmt: skip
def response_match(spark, d):
    """Answers with gaps, repeats and strays, matched by id. Of answers at one tick (id 0 has two) the one counts that
    the SQL lists first; DuckDB leaves that open and gives either."""
    k = F.col("o_orderkey")
    at = lambda tick, place: F.struct(tick.alias("tick"), F.lit(place).alias("place")).alias("at")
    o = spark.read.parquet(f"{d}/orders.parquet")
    own = o.where(k % 4 != 0).select(k.alias("id"), (k % 3).cast("int").alias("status"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("value"), at(k * 2, 0))
    late = o.where(k % 5 == 0).select(k.alias("id"), F.lit(2).alias("status"), F.lit("late").alias("value"), at(k * 2 + 1, 1))
    stray = o.select((-k).alias("id"), F.lit(0).alias("status"), F.lit("stray").alias("value"), at(F.lit(1).cast("long"), 2))
    return replicas.matched(o.select(k.alias("id")), own.unionByName(late).unionByName(stray))


@query("pick_compaction_over", f"WITH {TABLES} SELECT min(level) AS level FROM (SELECT level, sum(bytes) * 100 AS b FROM tables WHERE level > 0 GROUP BY level) WHERE b > 8000 * power(10, level - 1) AND level BETWEEN 1 AND 5 HAVING min(level) IS NOT NULL")
def pick_compaction_over(spark, d):
    """Deep levels a hundred times as large, so that limits are crossed."""
    return segments.pick(segments.level_bytes(tables(spark, d).where("level > 0").withColumn("bytes", F.col("bytes") * 100)))


@query("trivial_moves", f"""WITH {TABLES}, u AS (SELECT * FROM tables WHERE level = 1), l AS (SELECT * FROM tables WHERE level = 2 AND num % 2 = 0)
SELECT u.num, count(l.num) AS lower, count(l.num) = 0 AS move FROM u LEFT JOIN l ON u.lo <= l.hi AND u.hi >= l.lo GROUP BY u.num""")  # fmt: skip
def trivial_moves(spark, d):
    """Each table of level 1 against a fixture of level 2 with gaps: some may move as they are, others may not."""
    t = tables(spark, d)
    j = t.where("level = 1").alias("u").join(t.where("level = 2 AND num % 2 = 0").alias("l"), segments.overlaps("u", "l"), "left")
    return j.groupBy(F.col("u.num").alias("num")).agg(F.count("l.num").alias("lower")).withColumn("move", F.col("lower") == 0)


@query("peer_parse_faults", """WITH p AS (SELECT s_suppkey AS n, s_suppkey % 4 AS kind FROM supplier)
SELECT CASE kind WHEN 0 THEN 0 WHEN 3 THEN NULL ELSE n END AS id, CASE kind WHEN 3 THEN '' ELSE 'h' || n || ':1' END AS raft_addr, CASE kind WHEN 3 THEN '' ELSE 'h' || n || ':2' END AS client_addr, kind IN (1, 2) AS ok FROM p""")  # fmt: skip
def peer_parse_faults(spark, d):
    """Members with zero ids and malformed ones among good ones."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    good = F.concat(F.when(n == 0, "0").otherwise(k), F.lit("=h"), k, F.lit(":1@h"), k, F.lit(":2"))
    return text.peers(spark.read.parquet(f"{d}/supplier.parquet").select(F.when(n == 3, F.concat(k, F.lit("=nowhere"))).otherwise(good).alias("line")))


@query("peer_addresses", """WITH p AS (SELECT 'h' || (s_suppkey % 7) || ':1' AS a, 'c' || s_suppkey || ':1' AS b FROM supplier), x AS (SELECT a AS addr FROM p UNION ALL SELECT b FROM p) SELECT addr, count(*) AS members FROM x GROUP BY addr HAVING count(*) > 1""")
def peer_addresses(spark, d):
    """Addresses that more than one member claims."""
    k = F.col("s_suppkey")
    line = F.concat(k.cast("string"), F.lit("=h"), (k % 7).cast("string"), F.lit(":1@c"), k.cast("string"), F.lit(":1"))
    return text.shared_addresses(text.peers(spark.read.parquet(f"{d}/supplier.parquet").select(line.alias("line"))))


@query("log_limits", f"""WITH {BROKEN.split('w AS (')[0].rstrip().rstrip(',')} SELECT node, idx, 'too_long' AS what FROM bad WHERE strlen(k) + strlen(v) > 12
UNION ALL SELECT node, idx, 'unknown_op' FROM bad WHERE op NOT IN (0, 1) UNION ALL SELECT node, idx, 'past_bounds' FROM bad WHERE idx NOT BETWEEN 10 AND 200""")  # fmt: skip
def log_limits(spark, d):
    """Limits set low, so that each is crossed: length, known operations, and the span between snapshot and end."""
    i, one = F.col("idx"), logs(spark, d)[0].where("idx % 1511 <> 0")
    bad = one.select((1 + i % 3).alias("node"), F.floor(i / 3).alias("idx"), F.when(i % 499 == 0, 0).otherwise(F.col("op")).alias("op"), "k", F.when(i % 503 == 0, "x").otherwise(F.col("v")).alias("v"))
    return replicas.limits(bad, known=(0, 1), longest=12, first=10, last=200)
