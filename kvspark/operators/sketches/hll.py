"""HyperLogLog in relational form: (reg, rank). Merging takes the larger rank.

Register: the top p bits of a 32-bit hash; rank: one more than the hash's trailing zeros, 33 for 0.
Small counts are corrected up to five times the registers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.functions.hashing import md5_32


def _check(p: int) -> None:
    if not 4 <= p <= 16:
        raise ValueError("p must be from 4 to 16")


def alpha(p: int) -> float:
    m = 1 << p
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def registers(rows: DataFrame, col: str, p: int, by: tuple[str, ...] = (), hashed: Column | None = None) -> DataFrame:
    """(by..., reg, rank)."""
    _check(p)
    h = md5_32(F.col(col).cast("string")) if hashed is None else hashed
    named = rows.where(F.col(col).isNotNull()).select(*by, h.alias("_h"))
    rank = F.when(F.col("_h") == 0, 33).otherwise(F.bit_count(F.col("_h").bitwiseAND(-F.col("_h")) - 1) + 1)
    return named.groupBy(*by, F.shiftright("_h", 32 - p).cast("int").alias("reg")).agg(F.max(rank).alias("rank"))


def merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy([c for c in out.columns if c != "rank"]).agg(F.max("rank").alias("rank"))


def estimate(regs: DataFrame, p: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., estimate): distinct values, cut to an integer."""
    _check(p)
    m = 1 << p
    sums = regs.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_s"), F.count(F.lit(1)).alias("_used"))
    empty = F.lit(m) - F.col("_used")
    raw = F.lit(alpha(p) * m * m) / (F.coalesce("_s", F.lit(0.0)) + empty)
    small = F.lit(float(m)) * F.log(F.lit(float(m)) / empty)
    large = -F.lit(2.0**32) * F.log(1 - raw / F.lit(2.0**32))
    value = F.when((empty > 0) & (raw <= 5 * m), small).when(raw > 2.0**32 / 30, large).otherwise(raw)
    return sums.select(*by, F.floor(value).cast("long").alias("estimate"))
