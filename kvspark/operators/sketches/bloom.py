"""Bloom filters in relational form: the set of bits that are on. Merging is a union."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.functions.hashing import md5_32


def parameters(n: int, p: float) -> tuple[int, int]:
    """(bits, hash functions) for n elements at false-positive rate p."""
    if n <= 0 or not 0 < p < 1:
        raise ValueError("n must be positive and p between 0 and 1")
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, math.floor(m / n * math.log(2) + 0.5))


def positions(x: Column, m: int, k: int) -> Column:
    h1, h2 = md5_32(x, 0), md5_32(x, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h1 + i * h2) % m)


def build(rows: DataFrame, col: str, m: int, k: int) -> DataFrame:
    """(bit): the bits that are on."""
    return rows.where(F.col(col).isNotNull()).select(F.explode(positions(F.col(col).cast("string"), m, k)).alias("bit")).distinct()


def merge(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for other in filters[1:]:
        out = out.unionByName(other)
    return out.distinct()


def probe(rows: DataFrame, col: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """(col, maybe) for each distinct value: whether all its bits are on."""
    values = rows.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()
    hit = values.withColumn("bit", F.explode(F.array_distinct(positions(F.col(col), m, k)))).join(bits.withColumn("_on", F.lit(1)), "bit", "left")
    return hit.groupBy(col).agg((F.count("_on") == F.count(F.lit(1))).alias("maybe"))


def packed(bits: DataFrame, m: int) -> bytearray:
    """The filter as bytes, low bit first, of the size that m fixes."""
    out = bytearray((m + 7) // 8)
    for row in bits.selectExpr("bit div 8 AS b", "shiftleft(1, cast(bit % 8 AS int)) AS v").groupBy("b").agg(F.bit_or("v").alias("v")).toLocalIterator():
        out[row["b"]] = row["v"]
    return out


def _word_places(x: Column, m: int, k: int) -> list[Column]:
    """Places of the k bits of x in a filter of m bits, from two halves of one 64-bit hash: all built-in functions."""
    h = F.xxhash64(x)
    h1, h2 = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [(h1 + i * h2) % m for i in range(k)]


def words(keys: DataFrame, col: str, m: int, k: int) -> list[int]:
    """The filter over a column as words of 64 bits: m / 64 rows come to the driver at most."""
    places = keys.select(F.explode(F.array(*_word_places(F.col(col), m, k))).alias("_at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % 64).cast("int"))
    out = [0] * ((m + 63) // 64)
    for row in places.groupBy(F.floor(F.col("_at") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("v")).collect():
        out[row["w"]] = row["v"]
    return out


def all_on(x: Column, on: list[int], m: int, k: int) -> Column:
    """Whether all bits of x are on: k tests of words, in generated code."""
    filled = F.lit(on)
    tests = [F.call_function("shiftright", F.get(filled, F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for at in _word_places(x, m, k)]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, p: float = 0.01, most_bits: int = 1 << 22) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``: a Bloom filter of the right keys drops most others before the exact join.

    The filter stands in the plan as a constant; beyond ``most_bits`` (512 kB) the plain join runs, with
    what Spark's own runtime filters do. A small right side is broadcast by Spark either way, and then the
    filter saves nothing: it is for a left side that would shuffle.
    """
    kind = left.schema[left_key].dataType
    keys = right.select(F.col(right_key).cast(kind).alias("_k")).where("_k is not null").distinct()
    n = max(1, keys.count())
    m, k = parameters(n, p)
    if m <= most_bits:
        left = left.where(all_on(F.col(left_key), words(keys, "_k", m, k), m, k))
    return left.join(keys, F.col(left_key) == F.col("_k"), "left_semi")
