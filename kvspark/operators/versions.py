"""Last writer wins: the newest version of each key, and reads over it.

All are one shuffle by key, before which each task keeps its own newest version of a key, so a hot key is
combined first. Filters on the key pass into the Parquet scan; the tombstone filter comes after, never before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.model import RESERVED


def newest(oplog: DataFrame, *by: str) -> DataFrame:
    """(by..., value, tombstone, ts, seq), with key among ``by``: the newest version of each group by (ts, seq).

    Each task keeps the newest rows of its own before the shuffle (a window group limit). A stream has no
    such windows and aggregates.
    """
    columns = ["value", "tombstone", "ts", "seq"]
    if oplog.isStreaming:
        return oplog.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("v")).select(*by, "v.*")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("seq")))
    return oplog.select(*by, *columns, place.alias("_place")).where("_place = 1").drop("_place")


def lww(oplog: DataFrame) -> DataFrame:
    """(key, value, tombstone, ts, seq): the newest version of every key by (ts, seq)."""
    return newest(oplog, "key")


def visible(oplog: DataFrame) -> DataFrame:
    return lww(oplog).where(~F.col("tombstone"))


def user_keys(rows: DataFrame) -> DataFrame:
    """Without the store's own keys."""
    return rows.where(~F.col("key").startswith(RESERVED))


def get(oplog: DataFrame, key: str) -> DataFrame:
    """No row for a key that is absent or deleted."""
    return visible(oplog.where(F.col("key") == key))


def multi_get(oplog: DataFrame, keys: DataFrame) -> DataFrame:
    """Newest visible versions of the keys of a table (key); keys outside it are dropped before the aggregation."""
    return visible(oplog.join(keys.select("key").distinct(), "key", "left_semi"))


def missing(oplog: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of a table that are absent or deleted."""
    return keys.select("key").distinct().join(visible(oplog), "key", "left_anti")


def exists(oplog: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, present) for each distinct key of a table."""
    found = multi_get(oplog, keys).select("key", F.lit(True).alias("_there"))
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("_there", F.lit(False)).alias("present"))


def as_of(oplog: DataFrame, moment: Column) -> DataFrame:
    """The visible state at a moment."""
    return visible(oplog.where(F.col("ts") <= moment))


def ranked(oplog: DataFrame) -> DataFrame:
    """All versions with their rank, 1 the newest."""
    order = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq"))
    return oplog.withColumn("version_rank", F.row_number().over(order))
