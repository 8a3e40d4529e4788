"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.staging import HEAVY, cut, drop_cut, drop_staged, join_back, partitions, release, stable, staged, tasks

__all__ = ["HEAVY", "cut", "drop_cut", "drop_staged", "join_back", "mix64", "partitions", "release", "stable", "staged", "table", "tasks", "tree_merge"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts of one segment that a task merges at most, about.
FAN_IN = 64


def tree_merge(parts: DataFrame, merge: Callable, segments: int, inputs: int) -> DataFrame:
    """Parts (segment, ...) that ``inputs`` tasks made, merged to one a segment, by a tree whose width follows their number."""
    kinds = parts.schema
    while inputs > FAN_IN:
        inputs = -(-inputs // FAN_IN)
        placed = parts.withColumn("_group", F.spark_partition_id() % inputs).repartition(segments * inputs, "segment", "_group")
        parts = placed.drop("_group").mapInArrow(merge, kinds)
    return parts.repartition(segments, "segment").mapInArrow(merge, kinds)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
