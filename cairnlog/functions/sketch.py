"""Hashes and Bloom filters as expressions over bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 4294967295
_SEED_HI, _SEED_LO, _PRIME_LO = 3421674724, 2216829733, 435


def byte_list(key: Column) -> Column:
    """The bytes of a string or binary column as array<bigint>."""
    data = key.cast("binary")
    at = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))


def fnv1a(key: Column) -> Column:
    """64-bit FNV-1a as struct(hi, lo) of unsigned 32-bit limbs: no product leaves 63 bits."""
    start = F.struct(F.lit(_SEED_HI).cast("bigint").alias("hi"), F.lit(_SEED_LO).cast("bigint").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        y = h["lo"].bitwiseXOR(c)
        low = y * _PRIME_LO
        high = h["hi"] * _PRIME_LO + F.shiftright(low, 32) + F.shiftleft(y, 8)
        return F.struct(high.bitwiseAND(MASK).alias("hi"), low.bitwiseAND(MASK).alias("lo"))

    return F.aggregate(byte_list(key), start, step)


def crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = crc_table()


def crc32c(key: Column) -> Column:
    """Castagnoli CRC of the bytes, as bigint."""
    table = F.array(*[F.lit(n).cast("bigint") for n in _CRC])
    step = lambda a, c: F.shiftrightunsigned(a, 8).bitwiseXOR(F.get(table, a.bitwiseXOR(c).bitwiseAND(255).cast("int")))
    return F.aggregate(byte_list(key), F.lit(MASK).cast("bigint"), step, lambda a: a.bitwiseXOR(MASK))


def probes(hash_: str, bits: Column | int, count: int = 7) -> Column:
    """Bit positions of a hashed key."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (F.col(hash_)["lo"] + i * F.col(hash_)["hi"]) % bits)


def bloom_size(n: Column) -> Column:
    """Bits for n keys: ten each, 64 at least, whole bytes."""
    return (F.ceil(F.greatest(n * 10, F.lit(64)) / 8) * 8).cast("bigint")


def bloom_bits(keys: DataFrame) -> DataFrame:
    """(bit): the set bits of the filter over distinct keys `k`; its size follows their number."""
    keys = keys.select("k").distinct()
    size = keys.agg(bloom_size(F.count("*")).alias("bits"))
    hashed = keys.select(fnv1a(F.col("k")).alias("h")).crossJoin(F.broadcast(size))  # one row
    return hashed.select(F.explode(probes("h", F.col("bits"))).alias("bit")).distinct()


def bloom_maybe(keys: DataFrame, probe: DataFrame) -> DataFrame:
    """(k, maybe): whether all probes of each probed key are set."""
    size = keys.select("k").distinct().agg(bloom_size(F.count("*")).alias("bits"))
    asked = probe.select("k").distinct().withColumn("h", fnv1a(F.col("k"))).crossJoin(F.broadcast(size))  # one row
    asked = asked.select("k", F.explode(F.array_distinct(probes("h", F.col("bits")))).alias("bit"))
    hit = asked.join(bloom_bits(keys).withColumn("one", F.lit(1)), "bit", "left")
    return hit.groupBy("k").agg((F.count("one") == F.count("*")).alias("maybe"))
