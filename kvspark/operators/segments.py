"""Immutable sorted segments: assignment, manifest, sparse index, offsets, pruning and the sink."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvspark.operators.folds import ordered_fold
from kvspark.operators.versions import newest

HEADER_BYTES = 30


def assign(oplog: DataFrame, segment_ops: int) -> DataFrame:
    """Operations in segments of equal ranges of the write order; no shuffle."""
    return oplog.withColumn("segment_id", F.floor(F.col("seq") / segment_ops).cast("long"))


def newest_in_segment(oplog: DataFrame) -> DataFrame:
    """What a flush writes: one version a key and segment, tombstones included."""
    return newest(oplog, "segment_id", "key")


def manifest(segments: DataFrame) -> DataFrame:
    """(segment_id, min_key, max_key, n_records, n_tombstones)."""
    return segments.groupBy("segment_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_records"), F.count_if("tombstone").alias("n_tombstones"))


def may_hold(low: str, high: str | None = None) -> Column:
    """Manifest rows whose key range meets a key, or an inclusive range."""
    return (F.col("max_key") >= low) & (F.col("min_key") <= (low if high is None else high))


def may_hold_prefix(prefix: str) -> Column:
    return (F.col("max_key") >= prefix) & ((F.col("min_key") <= prefix) | F.col("min_key").startswith(prefix))


def record_bytes() -> Column:
    return (F.lit(HEADER_BYTES) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def varint_bytes(n: Column) -> Column:
    """Bytes of an unsigned LEB128 number."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def varint_encode(n: Column) -> Column:
    """A non-negative long as unsigned LEB128, in hex: seven bits a byte, the lowest first, the high bit on where more follow."""
    last = varint_bytes(n) - 1
    byte = lambda i: F.call_function("shiftright", n, i * 7).bitwiseAND(F.lit(127)) + F.when(i < last, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def varint_decode(coded: Column) -> Column:
    """The number that varint_encode() made."""
    places = F.sequence(F.lit(0), (F.length(coded) / 2 - 1).cast("int"))
    value = lambda i: F.conv(F.substr(coded, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127))
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, i: total + F.call_function("shiftleft", value(i), i * 7))


def offsets(segments: DataFrame) -> DataFrame:
    """Adds each record's byte offset in its segment, in the order of keys."""
    run = Window.partitionBy("segment_id").orderBy("key", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("byte_offset", F.coalesce(F.sum(record_bytes()).over(run), F.lit(0)).cast("long"))


def sparse(rows: DataFrame, every: int, order: tuple[str, ...]) -> DataFrame:
    """Of each segment every ``every``-th row, from the first, and the last."""
    place = F.row_number().over(Window.partitionBy("segment_id").orderBy(*order))
    total = F.count(F.lit(1)).over(Window.partitionBy("segment_id"))
    return rows.withColumn("_place", place).withColumn("_total", total).where((F.col("_place") % every == 1 % every) | (F.col("_place") == F.col("_total"))).drop("_place", "_total")


def lookup_offset(index: DataFrame, key: str) -> DataFrame:
    """Where to start reading each segment for a key: the last index entry at or before it, else the first."""
    at = F.max_by("byte_offset", F.when(F.col("key") <= key, F.struct("key", "seq")))
    return index.groupBy("segment_id").agg(F.coalesce(at, F.min("byte_offset")).alias("start_offset"))


def write(segments: DataFrame, path: str) -> None:
    """The sink: one folder a segment, sorted by key, with Parquet Bloom filters on the key and a manifest beside it."""
    rows = segments.repartition("segment_id").sortWithinPartitions("segment_id", "key")
    rows.write.mode("append").partitionBy("segment_id").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/data")
    manifest(segments).write.mode("append").parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Segments of a path; with a key range only those whose manifest row meets it, by partition pruning."""
    rows = spark.read.parquet(f"{path}/data")
    if low is None:
        return rows
    kept = spark.read.parquet(f"{path}/manifest").where(may_hold(low, high)).select("segment_id")
    return rows.join(kept, "segment_id", "left_semi").where(F.col("key").between(low, low if high is None else high))


def generations(oplog: DataFrame, shard: str, max_keys: int, tables: int = 1) -> DataFrame:
    """(seq, key, generation, flushed): the memtable each operation enters and whether it is flushed in the end.

    A memtable that reaches ``max_keys`` distinct keys is full and the next operation opens another; when
    all ``tables`` memtables are full, the oldest is flushed. Shards run side by side.
    """

    def step(state: dict, rows: dict) -> tuple[list[int]]:
        out = []
        for key in rows["key"]:
            keys = state.setdefault("keys", set())
            keys.add(key)
            out.append(state.get("n", 0))
            if len(keys) >= max_keys:
                state |= {"keys": set(), "n": state.get("n", 0) + 1}
        return (out,)

    rows = oplog.select(F.col(shard).alias("_shard"), "seq", "key")
    kind = rows.schema["_shard"].dataType.simpleString()
    found = ordered_fold(rows, "_shard", ["seq"], dict, step, ["generation"], [pa.int64()], f"_shard {kind}, seq long, key string, generation long")
    sizes = found.groupBy("_shard", "generation").agg(F.countDistinct("key").alias("_keys"))
    full = sizes.groupBy("_shard").agg(F.count_if(F.col("_keys") >= max_keys).alias("_full"))
    return found.join(full, "_shard").select("seq", "key", "generation", (F.col("generation") < F.col("_full") - (tables - 1)).alias("flushed"))
