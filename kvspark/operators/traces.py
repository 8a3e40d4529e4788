"""Ordered folds over traces: an LRU cache and a token bucket. State is one cache or one bucket a group."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.operators.folds import ordered_fold


def lru(trace: DataFrame, shard: str, key: str, order: str, capacity: int) -> DataFrame:
    """(shard, order, key, hit): whether each access finds its key among the last ``capacity`` distinct ones."""
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def step(cache: OrderedDict, rows: dict) -> tuple[list[bool]]:
        hits = []
        for k in rows["_k"]:
            hits.append(k in cache)
            cache[k] = True
            cache.move_to_end(k)
            if len(cache) > capacity:
                cache.popitem(last=False)
        return (hits,)

    s = trace.select(F.col(shard).alias("_s"), F.col(order).cast("long").alias("_o"), F.col(key).cast("string").alias("_k"))
    done = ordered_fold(s, "_s", ["_o"], OrderedDict, step, ["hit"], [pa.bool_()], f"_s {s.schema['_s'].dataType.simpleString()}, _o long, _k string, hit boolean")
    return done.select(F.col("_s").alias(shard), F.col("_o").alias(order), F.col("_k").alias(key), "hit")


def token_bucket(requests: DataFrame, who: str, at_seconds: str, order: str, max_tokens: int, interval: int) -> DataFrame:
    """(who, order, allowed, tokens_left): a bucket is full at its first request, refills whole once the interval has passed, and gives one token a request."""
    if max_tokens < 1 or interval < 1:
        raise ValueError("tokens and interval must be positive")

    def step(bucket: dict, rows: dict) -> tuple[list[bool], list[int]]:
        allowed, left = [], []
        for t in rows["_t"]:
            if not bucket or t - bucket["last"] >= interval:
                bucket |= {"tokens": max_tokens, "last": t}
            allowed.append(bucket["tokens"] > 0)
            bucket["tokens"] -= bucket["tokens"] > 0
            left.append(bucket["tokens"])
        return allowed, left

    s = requests.select(F.col(who).alias("_w"), F.col(order).cast("long").alias("_o"), F.col(at_seconds).cast("long").alias("_t"))
    done = ordered_fold(s, "_w", ["_t", "_o"], dict, step, ["allowed", "tokens_left"], [pa.bool_(), pa.int64()], f"_w {s.schema['_w'].dataType.simpleString()}, _o long, _t long, allowed boolean, tokens_left long")
    return done.select(F.col("_w").alias(who), F.col("_o").alias(order), "allowed", "tokens_left")
