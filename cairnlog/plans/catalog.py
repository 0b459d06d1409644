"""All registered queries over versioned key-value data, with their SQL. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.functions import sketch, text
from cairnlog.operators import replicas, segments, versions
from cairnlog.operators.versions import change_log

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LOG = """log AS (SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
  CAST(user_id AS VARCHAR) AS k, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || CAST(event_id AS VARCHAR) END AS v FROM events)"""
NEWEST = f"{LOG}, newest AS (SELECT k, max(seq) AS seq, max_by(op, seq) AS op, max_by(v, seq) AS v FROM log GROUP BY k)"
#: Tables of the levelled fixture: the last 4,000 changes are four level-0 tables, the 3,000 before them level 1 and the
#: rest level 2, both cut by first digit of the key. Deeper levels keep the newest row of a key.
TABLES = f"""{LOG}, m AS (SELECT max(seq) AS m FROM log),
aged AS (SELECT log.*, m - seq AS age FROM log, m),
placed AS (SELECT seq, op, k, v, CASE WHEN age < 4000 THEN 0 WHEN age < 7000 THEN 1 ELSE 2 END AS level,
  CASE WHEN age < 4000 THEN 1000 - age // 1000 ELSE CAST(substr(k, 1, 1) AS BIGINT) + CASE WHEN age < 7000 THEN 100 ELSE 200 END END AS num FROM aged),
rows_of AS (SELECT level, num, k, max(seq) AS seq, max_by(op, seq) AS op, max_by(v, seq) AS v FROM placed GROUP BY level, num, k),
tables AS (SELECT level, num, min(k) AS lo, max(k) AS hi, count(*) AS n, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes FROM rows_of GROUP BY level, num)"""
REPLICAS = """acks AS (SELECT o_orderkey AS shard, node, (o_orderkey * (node * 7 + 3)) % 101 AS match FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS node))"""
LOGS = f"""{LOG}, node1 AS (SELECT seq AS idx, 1 + seq // 1000 AS term, op, k, v FROM log),
c AS (SELECT (max(seq) * 7) // 10 AS c FROM log),
node2 AS (SELECT idx, CASE WHEN idx > c THEN term + 1 ELSE term END AS term, op, k, v FROM node1, c)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, num, k, seq, op, v): rows of the levelled fixture's tables."""
    log = change_log(spark, sf_dir)
    log = log.crossJoin(F.broadcast(log.agg(F.max("seq").alias("m")))).withColumn("age", F.col("m") - F.col("seq"))  # one row
    level = F.when(F.col("age") < 4000, 0).when(F.col("age") < 7000, 1).otherwise(2)
    deep = F.substring("k", 1, 1).cast("long") + F.when(F.col("age") < 7000, 100).otherwise(200)
    num = F.when(F.col("age") < 4000, 1000 - F.floor(F.col("age") / 1000)).otherwise(deep)
    return versions.newest(log.select("seq", "op", "k", "v", level.alias("level"), num.alias("num")), "level", "num", "k")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.ranges(placed(spark, sf_dir), "level", "num")


def logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two synthetic replicas: the second has later terms in its last three tenths."""
    log = change_log(spark, sf_dir)
    one = log.select(F.col("seq").alias("idx"), (1 + F.floor(F.col("seq") / 1000)).alias("term"), "op", "k", "v")
    cut = F.broadcast(log.agg(F.floor(F.max("seq") * 7 / 10).alias("c")))  # one row
    return one, one.crossJoin(cut).withColumn("term", F.col("term") + (F.col("idx") > F.col("c")).cast("long")).drop("c")


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("shard"))
    o = o.select("shard", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("node"))
    return o.select("shard", "node", ((F.col("shard") * (F.col("node") * 7 + 3)) % 101).alias("match"))


@query("live_snapshot", f"WITH {NEWEST} SELECT k, v FROM newest WHERE op = 1")
def live_snapshot(spark, d):
    return versions.live(change_log(spark, d))


@query("merge_keep_tombstones", f"WITH {NEWEST} SELECT k, seq, op, v FROM newest")
def merge_keep_tombstones(spark, d):
    return versions.newest(change_log(spark, d), "k")


@query("point_get", f"WITH {NEWEST} SELECT k, v FROM newest WHERE op = 1 AND k = '7'")
def point_get(spark, d):
    return versions.get(change_log(spark, d), "7")


@query("multi_get", f"WITH {NEWEST}, p AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer) SELECT p.k, n.v IS NOT NULL AS found, n.v FROM p LEFT JOIN (SELECT * FROM newest WHERE op = 1) n ON p.k = n.k")
def multi_get(spark, d):
    probe = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("k"))
    return versions.multi_get(change_log(spark, d), probe)


@query("snapshot_anti_join", f"WITH {LOG}, p AS (SELECT k, max(seq) AS seq, max_by(v, seq) AS v FROM log WHERE op = 1 GROUP BY k) SELECT k, v FROM p WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.op = 2 AND l.k = p.k AND l.seq > p.seq)")
def snapshot_anti_join(spark, d):
    return versions.live_by_anti_join(change_log(spark, d))


@query("as_of_commit", f"WITH {LOG}, c AS (SELECT (max(seq) * 6) // 10 AS c FROM log), n AS (SELECT k, max_by(op, seq) AS op, max_by(v, seq) AS v FROM log, c WHERE seq <= c GROUP BY k) SELECT k, v FROM n WHERE op = 1")
def as_of_commit(spark, d):
    log = change_log(spark, d)
    cut = F.broadcast(log.agg(F.floor(F.max("seq") * 6 / 10).alias("c")))  # one row
    return versions.as_of(log.crossJoin(cut), F.col("c"))


@query("cumulative_bytes", f"WITH {LOG} SELECT seq, CAST(sum(strlen(k) + strlen(v)) OVER (ORDER BY seq) AS BIGINT) AS total FROM log")
def cumulative_bytes(spark, d):
    return versions.running_bytes(change_log(spark, d))


SEGMENTS = f"{LOG}, s AS (SELECT (seq - 1) // 1000 AS seg, min(k) AS lo, max(k) AS hi, count(*) AS n, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes FROM log GROUP BY 1)"


def flushed(spark: SparkSession, d: str) -> DataFrame:
    return change_log(spark, d).withColumn("seg", F.floor((F.col("seq") - 1) / 1000))


@query("segment_ranges", f"WITH {SEGMENTS} SELECT * FROM s")
def segment_ranges(spark, d):
    return segments.ranges(flushed(spark, d), "seg")


@query("segment_overlap", f"WITH {SEGMENTS} SELECT a.seg AS a, b.seg AS b FROM s a JOIN s b ON a.seg < b.seg AND a.lo <= b.hi AND a.hi >= b.lo")
def segment_overlap(spark, d):
    return segments.overlapping(segments.ranges(flushed(spark, d), "seg"), "seg")


@query("kway_merge", f"WITH {LOG}, l AS (SELECT (seq - 1) // 1000 AS layer, * FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY layer DESC, seq DESC) AS n FROM l) SELECT k, layer, op, v FROM r WHERE n = 1")
def kway_merge(spark, d):
    return versions.merge_layers(flushed(spark, d).withColumnRenamed("seg", "layer"))


@query("table_ranges", f"WITH {TABLES} SELECT * FROM tables")
def table_ranges(spark, d):
    return tables(spark, d)


@query("key_range", f"WITH {TABLES} SELECT level, min(lo) AS lo, max(hi) AS hi FROM tables GROUP BY level")
def key_range(spark, d):
    return tables(spark, d).groupBy("level").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


GC = """, u AS (SELECT k, max_by(op, seq) AS op, max_by(v, seq) AS v FROM rows_of WHERE level <= {0} GROUP BY k), r AS (SELECT min(lo) AS lo, max(hi) AS hi FROM tables WHERE level <= {0}),
b AS (SELECT NOT EXISTS (SELECT 1 FROM tables t, r WHERE t.level > {0} + 1 AND t.lo <= r.hi AND t.hi >= r.lo) AS bottom) SELECT k, op, v FROM u, b WHERE NOT (bottom AND op = 2)"""


def compacted(spark: SparkSession, d: str, level: int) -> DataFrame:
    """All tables down to `level` merged into the next one, deletes dropped only at the bottom."""
    rows, t = placed(spark, d), tables(spark, d)
    merged = versions.newest(rows.where(F.col("level") <= level), "k").select("k", "op", "v")
    return segments.collect_garbage(merged, segments.is_bottom(t, level + 1, t.where(F.col("level") <= level)))


@query("tombstone_gc_kept", f"WITH {TABLES}{GC.format(0)}")
def tombstone_gc_kept(spark, d):
    return compacted(spark, d, 0)


@query("tombstone_gc_dropped", f"WITH {TABLES}{GC.format(1)}")
def tombstone_gc_dropped(spark, d):
    return compacted(spark, d, 1)


@query("candidates", f"""WITH {TABLES}, p AS (SELECT DISTINCT k FROM log), d AS (SELECT p.k, t.level, min_by(t.num, t.hi) AS num FROM p JOIN tables t ON t.level > 0 AND t.hi >= p.k GROUP BY p.k, t.level)
SELECT k, level, num FROM p, tables WHERE level = 0 UNION ALL SELECT * FROM d""")  # fmt: skip
def candidates(spark, d):
    return segments.candidates(tables(spark, d), change_log(spark, d).select("k").distinct())


@query("level_bytes", f"WITH {TABLES} SELECT level, count(*) AS tables, CAST(sum(bytes) AS BIGINT) AS bytes FROM tables GROUP BY level")
def level_bytes(spark, d):
    return segments.level_bytes(tables(spark, d))


PICK = "SELECT min(level) AS level FROM (SELECT level, count(*) AS n, sum(bytes) AS b FROM tables {0} GROUP BY level) WHERE CASE WHEN level = 0 THEN n >= 4 ELSE b > 8000 * power(10, level - 1) AND level BETWEEN 1 AND 5 END HAVING min(level) IS NOT NULL"


@query("pick_compaction", f"WITH {TABLES} {PICK.format('')}")
def pick_compaction(spark, d):
    return segments.pick(segments.level_bytes(tables(spark, d)))


@query("pick_compaction_deep", f"WITH {TABLES} {PICK.format('WHERE level > 0')}")
def pick_compaction_deep(spark, d):
    return segments.pick(segments.level_bytes(tables(spark, d).where("level > 0")))


@query("round_robin_pick", f"WITH {TABLES} SELECT level, arg_min(num, CAST(hi <= '5' AS VARCHAR) || hi) AS num FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY hi <= '5', hi, num) AS r FROM tables) WHERE r = 1 GROUP BY level")
def round_robin_pick(spark, d):
    return segments.round_robin(tables(spark, d), "5")


@query("trivial_move", f"""WITH {TABLES}, u AS (SELECT * FROM tables WHERE level = 1 AND num = 101), l AS (SELECT * FROM tables WHERE level = 2 AND num <> 201),
j AS (SELECT u.num AS un, l.num AS ln FROM u LEFT JOIN l ON u.lo <= l.hi AND u.hi >= l.lo) SELECT count(DISTINCT un) AS upper, count(DISTINCT ln) AS lower, count(DISTINCT un) = 1 AND count(DISTINCT ln) = 0 AS move FROM j""")  # fmt: skip
def trivial_move(spark, d):
    t = tables(spark, d)
    return segments.trivial_move(t.where("level = 1 AND num = 101"), t.where("level = 2 AND num <> 201"))


FOLD = """, c AS (SELECT {0} AS o, {1} AS b, CAST(sum({1}) OVER (ORDER BY {0}) AS BIGINT) AS cum, row_number() OVER (ORDER BY {0}) AS i FROM {2}), z AS (SELECT max(i) AS z FROM c),
f(g, lo, hi) AS (SELECT 0, CAST(1 AS BIGINT), (SELECT coalesce(min(i), (SELECT z FROM z)) FROM c WHERE cum >= {3}) UNION ALL
SELECT g + 1, hi + 1, (SELECT coalesce(min(c.i), (SELECT z FROM z)) FROM c WHERE c.cum - (SELECT x.cum FROM c x WHERE x.i = f.hi) >= {3}) FROM f, z WHERE hi < z)"""


@query("rotate_segments", f"WITH RECURSIVE {LOG}{FOLD.format('seq', 'strlen(k) + strlen(v)', 'log', 4096)} SELECT CAST(g AS BIGINT) AS segment, min(o) AS lo_seq, max(o) AS hi_seq, CAST(sum(b) AS BIGINT) AS bytes FROM f JOIN c ON c.i BETWEEN lo AND hi GROUP BY g")
def rotate_segments(spark, d):
    return segments.rotate(change_log(spark, d), 4096)


@query("output_cuts", f"WITH RECURSIVE {NEWEST}{FOLD.format('k', 'strlen(k) + strlen(v) + 4', 'newest', 256)} SELECT CAST(g AS BIGINT) AS num, min(o) AS lo, max(o) AS hi, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM f JOIN c ON c.i BETWEEN lo AND hi GROUP BY g")
def output_cuts(spark, d):
    return segments.output_cuts(versions.newest(change_log(spark, d), "k"), 256)


KEYS = "keys AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer)"
FNV = f"""{KEYS}, h(k, i, h) AS (SELECT k, 0, CAST(14695981039346656037 AS HUGEINT) FROM keys UNION ALL
SELECT k, i + 1, (xor(h, CAST(ascii(substr(k, i + 1, 1)) AS HUGEINT)) * 1099511628211) % 18446744073709551616 FROM h WHERE i < strlen(k)),
hashed AS (SELECT k, CAST(h // 4294967296 AS BIGINT) AS hi, CAST(h % 4294967296 AS BIGINT) AS lo FROM h WHERE i = strlen(k))"""
BLOOM = f"{FNV}, inside AS (SELECT * FROM hashed WHERE CAST(k AS BIGINT) % 2 = 0), size AS (SELECT CAST(ceil(greatest(count(*) * 10, 64) / 8.0) * 8 AS BIGINT) AS bits FROM inside), bit AS (SELECT DISTINCT (lo + i * hi) % bits AS bit FROM inside, size, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i))"


def customer_keys(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("k")).distinct()


@query("fnv1a64", f"WITH RECURSIVE {FNV} SELECT k, hi, lo FROM hashed")
def fnv1a64(spark, d):
    return customer_keys(spark, d).withColumn("h", sketch.fnv1a(F.col("k"))).select("k", "h.hi", "h.lo")


@query("bloom_build", f"WITH RECURSIVE {BLOOM} SELECT bit FROM bit")
def bloom_build(spark, d):
    return sketch.bloom_bits(customer_keys(spark, d).where("CAST(k AS bigint) % 2 = 0"))


@query("bloom_probe", f"WITH RECURSIVE {BLOOM}, asked AS (SELECT DISTINCT k, (lo + i * hi) % bits AS b FROM hashed, size, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i)) SELECT k, count(bit) = count(*) AS maybe FROM asked LEFT JOIN bit ON b = bit GROUP BY k")
def bloom_probe(spark, d):
    keys = customer_keys(spark, d)
    return sketch.bloom_maybe(keys.where("CAST(k AS bigint) % 2 = 0"), keys)


@query("crc32c", f"""WITH RECURSIVE {KEYS}, h(k, i, c) AS (SELECT k, 0, CAST(4294967295 AS BIGINT) FROM keys UNION ALL
SELECT k, i + 1, xor(x >> 1, 2197175160 * (x & 1)) FROM (SELECT k, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(k, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM h WHERE i < 8 * strlen(k)))
SELECT k, xor(c, 4294967295) AS crc FROM h WHERE i = 8 * strlen(k)""")  # fmt: skip
def crc32c(spark, d):
    return customer_keys(spark, d).select("k", sketch.crc32c(F.col("k")).alias("crc"))


MAJORITY = f"{REPLICAS}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY match DESC, node) AS i, count(*) OVER (PARTITION BY shard) AS n FROM acks), q AS (SELECT shard, match AS idx FROM r WHERE i = n // 2 + 1)"


@query("quorum_commit", f"WITH {MAJORITY} SELECT shard, idx, 1 + idx // 10 = 1 + shard % 11 AS committed FROM q")
def quorum_commit(spark, d):
    a = acks(spark, d)
    terms = replicas.majority_index(a).select("shard", "idx", (1 + F.floor(F.col("idx") / 10)).alias("term"))
    current = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("shard"), (1 + F.col("o_orderkey") % 11).alias("current")).distinct()
    return replicas.commit(a, terms, current)


@query("catch_up_gap", f"WITH {REPLICAS}, l AS (SELECT shard, max(match) AS last FROM acks GROUP BY shard) SELECT shard, CAST(node AS INTEGER) AS node, last - match AS gap, CAST(ceil((last - match) / 8.0) AS BIGINT) AS batches FROM acks JOIN l USING (shard)")
def catch_up_gap(spark, d):
    return replicas.catch_up(acks(spark, d))


@query("log_conflict", f"WITH {LOGS} SELECT min(b.idx) AS idx FROM node2 b LEFT JOIN node1 a ON a.idx = b.idx WHERE a.idx IS NULL OR a.term <> b.term OR a.op <> b.op OR a.k <> b.k OR a.v <> b.v")
def log_conflict(spark, d):
    return replicas.conflict(*logs(spark, d))


@query("log_reconcile", f"WITH {LOGS}, x AS (SELECT min(b.idx) AS x FROM node2 b LEFT JOIN node1 a ON a.idx = b.idx WHERE a.term <> b.term) SELECT idx, term, op, k, v FROM node1, x WHERE idx < x UNION ALL SELECT idx, term, op, k, v FROM node2, x WHERE idx >= x")
def log_reconcile(spark, d):
    return replicas.reconcile(*logs(spark, d))


BROKEN = f"""{LOGS}, bad AS (SELECT 1 + idx % 3 AS node, idx // 3 AS idx, CASE WHEN idx % 997 = 0 THEN 0 WHEN idx % 1009 = 0 THEN 10000 ELSE term END AS term, CASE WHEN idx % 499 = 0 THEN 0 ELSE op END AS op, k, CASE WHEN idx % 503 = 0 THEN 'x' ELSE v END AS v FROM node1 WHERE idx % 1511 <> 0),
w AS (SELECT *, lag(term) OVER (PARTITION BY node ORDER BY idx) AS pt, lag(idx) OVER (PARTITION BY node ORDER BY idx) AS pi FROM bad)
SELECT node, idx, 'term_falls' AS what FROM w WHERE term < pt UNION ALL SELECT node, idx, 'term_beyond' FROM w WHERE term > 5000 UNION ALL SELECT node, idx, 'delete_value' FROM w WHERE op = 2 AND v <> ''
UNION ALL SELECT node, idx, 'noop_content' FROM w WHERE op = 0 AND strlen(k) + strlen(v) > 0 UNION ALL SELECT node, idx, 'index_gap' FROM w WHERE idx <> pi + 1"""


@query("log_invariants", f"WITH {BROKEN}")
def log_invariants(spark, d):
    """A log with faults of each kind planted at fixed places; every one is reported."""
    i, one = F.col("idx"), logs(spark, d)[0].where("idx % 1511 <> 0")
    bad = one.select(
        (1 + i % 3).alias("node"), F.floor(i / 3).alias("idx"),
        F.when(i % 997 == 0, 0).when(i % 1009 == 0, 10000).otherwise(F.col("term")).alias("term"),
        F.when(i % 499 == 0, 0).otherwise(F.col("op")).alias("op"), "k", F.when(i % 503 == 0, "x").otherwise(F.col("v")).alias("v"),
    )
    return replicas.violations(bad, 5000)


@query("apply_committed", f"WITH {LOGS} SELECT k, max_by(op, idx) AS op, max_by(v, idx) AS v FROM node1 WHERE idx BETWEEN 201 AND 900 GROUP BY k")
def apply_committed(spark, d):
    return replicas.applied(logs(spark, d)[0], 200, 900)


@query("snapshot_plus_suffix", f"WITH {NEWEST} SELECT k, v FROM newest WHERE op = 1")
def snapshot_plus_suffix(spark, d):
    log = change_log(spark, d)
    return replicas.snapshot_plus(versions.as_of(log, 600), versions.newest(log.where("seq > 600"), "k"))


@query("install_diff", f"""WITH {LOG}, o AS (SELECT k, max_by(op, seq) AS op, max_by(v, seq) AS v FROM log WHERE seq <= 600 GROUP BY k), n AS (SELECT k, max_by(op, seq) AS op, max_by(v, seq) AS v FROM log GROUP BY k),
a AS (SELECT k, v FROM n WHERE op = 1), b AS (SELECT k, v FROM o WHERE op = 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 2 ELSE 1 END AS op, coalesce(a.v, '') AS v FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")  # fmt: skip
def install_diff(spark, d):
    log = change_log(spark, d)
    return replicas.install(versions.live(log), versions.as_of(log, 600))


VOTES = "votes AS (SELECT o_orderkey // 8 AS term, o_custkey % 3 AS candidate, o_orderkey % 5 AS voter, o_totalprice > 100000 AS granted FROM orders)"


@query("vote_majority", f"WITH {VOTES} SELECT term, candidate, count(DISTINCT voter) AS votes, count(DISTINCT voter) > 2 AS elected FROM votes WHERE granted GROUP BY term, candidate")
def vote_majority(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return replicas.election(o.select(F.floor(F.col("o_orderkey") / 8).alias("term"), (F.col("o_custkey") % 3).alias("candidate"), (F.col("o_orderkey") % 5).alias("voter"), (F.col("o_totalprice") > 100000).alias("granted")), 5)


REQUESTS = "requests AS (SELECT event_id AS seq, user_id % 5 AS voter, event_id // 10 AS term, user_id % 7 AS candidate, event_id % 4 AS last_term, user_id AS last_idx, 2 AS own_term, 75 AS own_idx FROM events)"


def requests(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return spark.read.parquet(f"{d}/events.parquet").select(e.alias("seq"), (u % 5).alias("voter"), F.floor(e / 10).alias("term"), (u % 7).alias("candidate"), (e % 4).alias("last_term"), u.alias("last_idx"), F.lit(2).cast("long").alias("own_term"), F.lit(75).cast("long").alias("own_idx"))


@query("vote_freshness", f"WITH {REQUESTS} SELECT seq, last_term > own_term OR (last_term = own_term AND last_idx >= own_idx) AS fresh FROM requests")
def vote_freshness(spark, d):
    return requests(spark, d).select("seq", replicas.fresh(F.col("own_term"), F.col("own_idx")).alias("fresh"))


@query("vote_once_a_term", f"WITH {REQUESTS} SELECT voter, term, min_by(candidate, seq) AS candidate FROM requests WHERE last_term > own_term OR (last_term = own_term AND last_idx >= own_idx) GROUP BY voter, term")
def vote_once_a_term(spark, d):
    return replicas.one_vote_a_term(requests(spark, d))


@query("entries_from", f"WITH {LOGS}, l AS (SELECT *, coalesce(lag(term) OVER (ORDER BY idx), 0) AS prev_term FROM node1) SELECT idx, term, op, k, v, prev_term FROM l WHERE idx BETWEEN 500 AND 755")
def entries_from(spark, d):
    return replicas.entries_from(logs(spark, d)[0], 500, 256)


@query("latency_quantiles", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events), q AS (SELECT * FROM (VALUES ('max', 1.0), ('p50', 0.5), ('p99', 0.99), ('p999', 0.999)) t(name, q)) SELECT name, value AS v FROM r, q WHERE i = CAST(floor(q * (n - 1)) AS BIGINT)")
def latency_quantiles(spark, d):
    return replicas.quantiles(spark.read.parquet(f"{d}/events.parquet"), "value", {"p50": 0.5, "p99": 0.99, "p999": 0.999, "max": 1.0})


@query("write_amplification", f"WITH {TABLES} SELECT CAST((SELECT sum(bytes) FROM tables) AS DOUBLE) / CAST((SELECT sum(strlen(k) + strlen(v)) FROM log) AS DOUBLE) AS amplification")
def write_amplification(spark, d):
    put = change_log(spark, d).agg(F.sum(F.octet_length("k") + F.octet_length("v")).alias("put"))
    return tables(spark, d).agg(F.sum("bytes").alias("b")).crossJoin(F.broadcast(put)).select((F.col("b").cast("double") / F.col("put").cast("double")).alias("amplification"))  # one row each


@query("peer_parse", """WITH p AS (SELECT s_suppkey AS id, 'h' || s_suppkey || ':1' AS a, 'h' || s_suppkey || ':2' AS b FROM supplier UNION ALL SELECT s_suppkey, 'dup:1', 'dup:2' FROM supplier WHERE s_suppkey <= 3)
SELECT id, a AS raft_addr, b AS client_addr, id > 0 AND count(*) OVER (PARTITION BY id) = 1 AS ok FROM p""")  # fmt: skip
def peer_parse(spark, d):
    k = F.col("s_suppkey").cast("string")
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.concat(k, F.lit("=h"), k, F.lit(":1@h"), k, F.lit(":2")).alias("line"))
    more = s.where("s_suppkey <= 3").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("=dup:1@dup:2")).alias("line"))
    return text.peers(s.select("line").unionByName(more))


@query("request_response", f"""WITH {NEWEST}, q AS (SELECT o_orderkey AS id, 1 + o_orderkey % 4 AS op, CAST(o_custkey AS VARCHAR) AS k FROM orders)
SELECT q.id, CASE WHEN q.op > 3 THEN 2 WHEN q.op = 1 AND n.k IS NULL THEN 1 ELSE 0 END AS status, CASE WHEN q.op = 1 THEN coalesce(n.v, '') ELSE '' END AS v FROM q LEFT JOIN (SELECT * FROM newest WHERE op = 1) n ON q.k = n.k""")  # fmt: skip
def request_response(spark, d):
    """A batch of requests (1 get, 2 put, 3 delete, others unknown) answered from one image: 0 ok, 1 absent, 2 error."""
    q = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 4).alias("op"), F.col("o_custkey").cast("string").alias("k"))
    j = q.join(versions.live(change_log(spark, d)), "k", "left")
    status = F.when(F.col("op") > 3, 2).when((F.col("op") == 1) & F.col("v").isNull(), 1).otherwise(0)
    return j.select("id", status.alias("status"), F.when(F.col("op") == 1, F.coalesce("v", F.lit(""))).otherwise("").alias("v"))


@query("recover_files", f"WITH {TABLES}, f AS (SELECT p_partkey AS num, CASE p_partkey % 3 WHEN 0 THEN 'sst' WHEN 1 THEN 'wal' ELSE 'tmp' END AS kind FROM part) SELECT lpad(CAST(f.num AS VARCHAR), 6, '0') || '.' || kind AS name, kind, CASE WHEN kind = 'tmp' THEN 'delete' WHEN kind = 'sst' THEN CASE WHEN t.num IS NULL THEN 'delete' ELSE 'open' END WHEN f.num >= 50 THEN 'replay' ELSE 'delete' END AS action FROM f LEFT JOIN tables t ON f.num = t.num")
def recover_files(spark, d):
    n = F.col("p_partkey")
    kind = F.when(n % 3 == 0, "sst").when(n % 3 == 1, "wal").otherwise("tmp")
    names = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lpad(n.cast("string"), 6, "0"), F.lit("."), kind).alias("name"))
    return text.liveness(names, tables(spark, d), 50)


@query("manifest_tables", f"WITH {TABLES} SELECT level, CAST(row_number() OVER (PARTITION BY level ORDER BY num) - 1 AS INTEGER) AS pos, num FROM tables")
def manifest_tables(spark, d):
    """Writes the fixture's manifest lines and parses them back."""
    lines = tables(spark, d).groupBy("level").agg(F.array_sort(F.collect_list("num")).alias("n"))
    return text.manifest(lines.select(F.concat_ws(" ", F.lit("level"), F.col("level").cast("string"), F.array_join("n", " ")).alias("line")))


@query("term_at", f"WITH {LOGS}, p AS (SELECT p_partkey AS idx FROM part) SELECT p.idx, coalesce(term, 0) AS term FROM p LEFT JOIN node1 ON p.idx = node1.idx")
def term_at(spark, d):
    probe = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("idx"))
    return probe.join(logs(spark, d)[0], "idx", "left").select("idx", F.coalesce("term", F.lit(0)).alias("term"))


@query("log_info", f"WITH {LOGS} SELECT max(idx) AS last, max_by(term, idx) AS last_term, count(*) AS n, CAST(min(idx) - 1 AS BIGINT) AS base FROM node2")
def log_info(spark, d):
    return logs(spark, d)[1].agg(F.max("idx").alias("last"), F.max_by("term", "idx").alias("last_term"), F.count("*").alias("n"), (F.min("idx") - 1).alias("base"))


@query("broadcast_messages", "WITH n AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey <= 5) SELECT a.id AS source, b.id AS target FROM n a, n b WHERE a.id <> b.id")
def broadcast_messages(spark, d):
    n = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey <= 5").select(F.col("s_suppkey").alias("id"))
    return n.select(F.col("id").alias("source")).join(F.broadcast(n.select(F.col("id").alias("target"))), F.col("source") != F.col("target"))  # members
