"""Compaction as queries: merging runs, size-tiered and leveled placement, removal of tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.operators.versions import lww, newest


def merge(runs: DataFrame, gc: bool = False) -> DataFrame:
    """One run from many. Tombstones stay unless ``gc``; that is only right if the runs hold all versions of their keys."""
    merged = lww(runs)
    return merged.where(~F.col("tombstone")) if gc else merged


def tiered_counts(flushes: int, threshold: int, max_levels: int) -> list[tuple[int, int]]:
    """(level, tables) after so many flushes when a full level merges into one table of the next; the last but one keeps all."""
    last = max(1, max_levels - 1)
    return [(level, flushes // threshold ** (level - 1) % threshold if level < last else flushes // threshold ** (level - 1)) for level in range(1, last + 1)]


def tiered_level(segment: Column, flushes: int, threshold: int, max_levels: int) -> tuple[Column, Column]:
    """Level and table of each segment (numbered from 0 by age) in that state: the oldest lie deepest."""
    level, number, done = F.lit(1), segment, 0
    chosen_level, chosen_number = None, None
    for depth, tables in reversed(tiered_counts(flushes, threshold, max_levels)):
        size = threshold ** (depth - 1)
        start, done = done, done + tables * size
        here = segment < done
        inside = F.floor((segment - start) / size).cast("int")
        chosen_level = F.when(here, F.lit(depth)) if chosen_level is None else chosen_level.when(here, F.lit(depth))
        chosen_number = F.when(here, inside) if chosen_number is None else chosen_number.when(here, inside)
    return chosen_level.otherwise(level), chosen_number.otherwise(number)


def merge_tables(rows: DataFrame) -> DataFrame:
    """Newest versions inside each (level, table_no)."""
    return newest(rows, "level", "table_no", "key")


def overlapping(manifest: DataFrame, level: int) -> DataFrame:
    """The tables of level + 1 whose key range meets that of the first table of a level, and that table."""
    first = manifest.where(F.col("level") == level).agg(F.min_by(F.struct("segment_id", "min_key", "max_key"), "segment_id").alias("f"))
    below = manifest.where(F.col("level") == level + 1)
    meets = (F.col("min_key") <= F.col("f.max_key")) & (F.col("f.min_key") <= F.col("max_key"))
    return below.join(F.broadcast(first), meets).select(F.col("f.segment_id").alias("upper"), F.col("segment_id").alias("lower"))  # one row is broadcast


def level_limit(level: Column, multiplier: int) -> Column:
    """Tables that a level may hold under leveled compaction."""
    return F.pow(F.lit(multiplier), level).cast("long")
