"""The log as a source and a sink: appends with checksums, replay that skips damage, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _be8(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def record_crc(key: str = "key", value: str = "value", tombstone: str = "tombstone", ts: str = "ts") -> Column:
    """CRC-32 of a record's bytes: flag, time, tombstone, both sizes (8 bytes, big end first), key, value."""
    k, v = F.col(key).cast("binary"), F.coalesce(F.col(value), F.lit("")).cast("binary")
    dead = F.when(F.col(tombstone), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.crc32(F.concat(F.unhex(F.lit("00")), _be8(F.col(ts)), dead, _be8(F.octet_length(k)), _be8(F.octet_length(v)), k, v))


def with_crc(oplog: DataFrame) -> DataFrame:
    return oplog.withColumn("crc", record_crc())


def valid(oplog: DataFrame) -> DataFrame:
    """Records whose checksum holds."""
    return oplog.where(F.col("crc") == record_crc())


def append(oplog: DataFrame, path: str, segment_ops: int | None = None) -> None:
    """Write operations with checksums; existing files are never changed."""
    writer = with_crc(oplog).write.mode("append")
    (writer.option("maxRecordsPerFile", segment_ops) if segment_ops else writer).parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """All undamaged operations of a log."""
    return valid(spark.read.parquet(path)).drop("crc")


def after(oplog: DataFrame, low_water_mark: int) -> DataFrame:
    """What truncation below a mark keeps."""
    return oplog.where(F.col("seq") > low_water_mark)
