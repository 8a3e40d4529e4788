"""Streaming forms: continuous upserts, incremental sketches and a stateful rate limiter.

Late data needs no watermark to be right: an older version loses whenever it comes. The aggregations of
the operators (newest version, registers, counters) run on streams as they are; what is here adds sinks
and state that SQL has no form for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from kvspark.operators.versions import lww


def log_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New files of a log folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's newest versions to a log; a batch that runs again overwrites its own folder.

    Reading the log with versions.lww gives the state; compaction folds old folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        lww(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str) -> DataFrame:
    """Newest versions over all batches of upsert()."""
    return lww(spark.read.parquet(path).select("key", "value", "tombstone", "ts", "seq"))


def latest(stream: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregation (update or complete mode)."""
    return lww(stream)


def token_bucket(requests: DataFrame, max_tokens: int, interval: int) -> DataFrame:
    """(who, order, allowed, tokens_left) for a stream (who string, s long, order long); the bucket is the state of its key.

    Requests of a batch are taken in the order of time; those of an earlier time in a later batch use the bucket as it is.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = held.get if held.exists else (max_tokens, None)
        rows = pd.concat(list(parts)).sort_values(["s", "order"])
        allowed, left = [], []
        for t in rows["s"]:
            if last is None or t - last >= interval:
                tokens, last = max_tokens, int(t)
            allowed.append(tokens > 0)
            tokens -= tokens > 0
            left.append(tokens)
        held.update((tokens, last))
        yield rows.assign(allowed=allowed, tokens_left=left)[["who", "order", "allowed", "tokens_left"]]

    return requests.select("who", F.col("s").cast("long"), F.col("order").cast("long")).groupBy("who").applyInPandasWithState(
        run, "who string, order long, allowed boolean, tokens_left long", "tokens long, last long", "append", "NoTimeout"
    )
