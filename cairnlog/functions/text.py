"""Small parsers as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def peers(lines: DataFrame) -> DataFrame:
    """(id, raft_addr, client_addr, ok) of `id=raft@client` lists in column `line`; not ok: malformed, zero or repeated ids."""
    one = lines.select(F.explode(F.split("line", ",")).alias("p"))
    got = one.select(
        F.expr("try_cast(regexp_extract(p, '^([0-9]+)=([^@]+)@(.+)$', 1) AS bigint)").alias("id"),
        F.regexp_extract("p", r"^([0-9]+)=([^@]+)@(.+)$", 2).alias("raft_addr"),
        F.regexp_extract("p", r"^([0-9]+)=([^@]+)@(.+)$", 3).alias("client_addr"),
    )
    n = got.groupBy("id").agg(F.count("*").alias("c"))
    j = got.join(n, got["id"].eqNullSafe(n["id"]), "left").select(got["*"], "c")
    return j.select("id", "raft_addr", "client_addr", F.coalesce((F.col("id") > 0) & (F.col("c") == 1), F.lit(False)).alias("ok"))


def manifest(lines: DataFrame) -> DataFrame:
    """(level, pos, num) from manifest lines `level L n n ...`; the older `tables n ...` means level 0."""
    parts = lines.select(F.split(F.trim("line"), " +").alias("p"))
    level = F.when(F.col("p")[0] == "tables", F.lit(0)).otherwise(F.expr("try_cast(get(p, 1) AS int)"))
    skip = F.when(F.col("p")[0] == "tables", 2).otherwise(3)
    rows = parts.where(F.col("p")[0].isin("level", "tables")).select(level.alias("level"), F.slice("p", skip, F.size("p")).alias("n"))
    return rows.select("level", F.posexplode("n").alias("pos", "num")).select("level", "pos", F.col("num").cast("long").alias("num"))


def liveness(files: DataFrame, live: DataFrame, log_num: int) -> DataFrame:
    """(name, kind, action) of a store's directory: tables outside the manifest and older logs go, later logs replay."""
    f = files.select(
        "name", F.regexp_extract("name", r"\.([a-z]+)$", 1).alias("kind"),
        F.expr("try_cast(regexp_extract(name, '^([0-9]+)\\\\.', 1) AS bigint)").alias("num"),
    )
    j = f.join(live.select("num", F.lit(True).alias("listed")), "num", "left")
    return j.select("name", "kind", F.when(F.col("kind") == "tmp", "delete")
        .when(F.col("kind") == "sst", F.when(F.col("listed"), "open").otherwise("delete"))
        .when(F.col("kind") == "wal", F.when(F.col("num") >= log_num, "replay").otherwise("delete"))
        .otherwise("ignore").alias("action"))


def shared_addresses(peers_: DataFrame) -> DataFrame:
    """(addr, members): addresses, of either kind, that more than one member names."""
    one = peers_.select(F.explode(F.array("raft_addr", "client_addr")).alias("addr"))
    return one.where("addr <> ''").groupBy("addr").agg(F.count("*").alias("members")).where("members > 1")
