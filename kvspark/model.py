"""Data model: the versioned operation log, its configuration and the reserved namespace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The state of a store is this relation; everything else is a query over it. seq is the total order of writes.
OPLOG = T.StructType([
    T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType()), T.StructField("tombstone", T.BooleanType(), False),
    T.StructField("ts", T.LongType(), False), T.StructField("seq", T.LongType(), False),
])

#: Keys of the store's own objects: hidden from scans, refused by put, get and delete.
RESERVED = "system_"
SKETCH_PREFIXES = {"bloom": "system_bf_", "cms": "system_cms_", "hll": "system_hll_", "simhash": "system_sh_"}


@dataclass(frozen=True)
class Config:
    """Settings that have a meaning for queries; defaults are the reference values."""

    segment_ops: int = 512
    memtables: int = 4
    memtable_keys: int = 1000
    max_levels: int = 7
    tables_per_level: int = 3
    level_size_multiplier: int = 10
    index_sparsity: int = 32
    summary_sparsity: int = 64
    bloom_rate: float = 0.01
    cache_capacity: int = 10
    max_tokens: int = 20
    refill_seconds: int = 10

    def __post_init__(self) -> None:
        for name in ("segment_ops", "memtables", "memtable_keys", "max_levels", "tables_per_level", "level_size_multiplier", "index_sparsity", "summary_sparsity", "cache_capacity", "max_tokens", "refill_seconds"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if not 0 < self.bloom_rate < 1:
            raise ValueError("bloom_rate must be between 0 and 1")
