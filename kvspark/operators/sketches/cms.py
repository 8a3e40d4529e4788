"""Count-Min sketches in relational form: (row, col, cnt). Merging adds counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.functions.hashing import salted_32


def parameters(epsilon: float, delta: float) -> tuple[int, int]:
    """(columns, rows); one row more than the textbook has."""
    if not 0 < epsilon < 1 or not 0 < delta < 1:
        raise ValueError("epsilon and delta must be between 0 and 1")
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def _cells(rows: DataFrame, col: Column, m: int, k: int) -> DataFrame:
    return rows.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("col", salted_32(col, F.col("row")) % m)


def build(rows: DataFrame, col: str, m: int, k: int) -> DataFrame:
    """Values are counted first, so each distinct value is hashed once a row."""
    counted = rows.select(F.col(col).cast("string").alias("_x")).where("_x is not null").groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    return _cells(counted, F.col("_x"), m, k).groupBy("row", "col").agg(F.sum("_n").alias("cnt"))


def merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def query(values: DataFrame, col: str, sketch: DataFrame, m: int, k: int) -> DataFrame:
    """(col, estimate) for each distinct value: the least of its cells."""
    distinct = values.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()
    hit = _cells(distinct, F.col(col), m, k).join(F.broadcast(sketch), ["row", "col"], "left")  # m * k cells at most
    return hit.groupBy(col).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def top(values: DataFrame, col: str, sketch: DataFrame, m: int, k: int, n: int) -> DataFrame:
    return query(values, col, sketch, m, k).orderBy(F.desc("estimate"), col).limit(n)
