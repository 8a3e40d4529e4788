"""Line dedup across documents: two Bloom filters pick suspects, an exact shuffle decides.

1. Every task takes bits for each of its lines in a once-seen filter, and in a twice-seen filter where
   they were taken before. Filters merge as a monoid (what two filters both saw is seen twice), segment
   by segment, in a tree whose width follows the input.
2. The size of the filters follows the number of lines, eight bits a line, up to 2**30 bits. The
   twice-seen filter is broadcast. Lines it rejects occur in one document only; they never shuffle. There
   are no false negatives: all bits of a line seen by two documents are set in it.
3. Suspects shuffle by the line itself: the smallest and largest document holding it decide exactly.
   Lines with more than 1/1,024 of all suspects are dealt over SALTS tasks each.
4. Each document gets the list of its lines to drop. Beyond the filter's capacity (from about 130 million
   lines on) more lines are suspects and shuffle; results stay the same.

A key is a line without ASCII white space at both ends and with A-Z in lower case; keys shorter than
``min_chars`` code points stay. Cases: null or empty text is one empty line; texts and lines of any length
are taken whole; rows with the same id count as one document, as do those with a null id, which comes after
all others; an empty table gives an empty table; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kvspark.llm.common import HEAVY, cut, stable, tasks, tree_merge

WHITE = b" \t\n\v\f\r"
SEGMENT_BITS, MOST_BITS, SALTS = 20, 30, 64
#: Bytes that a task of a scan reads, about; bits that a task gathers before it sorts them.
SPLIT_BYTES, SEEN_AT_ONCE = 128 << 20, 1 << 20


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    """The distinct keys of a text's lines that are long enough."""
    found = {line.strip(WHITE) for line in text.encode().lower().split(b"\n")} if text else ()
    return [k for k in found if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)]


def _bits(keys: Iterable[bytes], n: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
    return (h & np.uint64(mask)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(mask)).astype(np.int64)


def _filters(batches: Iterable[pa.RecordBatch], filter_bits: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """The segments of a task's own filters; what it holds is its bits, sorted, not the whole filters."""
    size, found, room = 1 << filter_bits, [], 0
    once, counts = np.zeros(0, np.int64), np.zeros(0, np.int8)

    def settle() -> None:
        nonlocal once, counts, found, room
        bits = np.concatenate([once, once[counts > 1], *found])
        once, n = np.unique(bits, return_counts=True)
        counts, found, room = np.minimum(n, 2).astype(np.int8), [], 0

    for batch in batches:
        for text in batch.column(0).to_pylist():
            keys = _keys(text, min_chars)
            if keys:
                found.append(np.unique(np.concatenate(_bits(keys, len(keys), size - 1))))
                room += len(found[-1])
                if room > SEEN_AT_ONCE + len(once):
                    settle()
    settle()
    squeeze = zstandard.ZstdCompressor(level=3).compress
    cuts = np.searchsorted(once, np.arange((size >> SEGMENT_BITS) + 1) << SEGMENT_BITS)
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if lo == hi:
            continue
        planes = []
        for own in (once[lo:hi], once[lo:hi][counts[lo:hi] > 1]):
            plane = np.zeros(1 << SEGMENT_BITS, bool)
            plane[own - (k << SEGMENT_BITS)] = True
            planes.append(pa.array([squeeze(np.packbits(plane).tobytes())], pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *planes], ["segment", "once", "twice"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    read, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor().compress
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            once, twice = np.frombuffer(read(once), np.uint8), np.frombuffer(read(twice), np.uint8)
            if segment in found:
                a, b = found[segment]
                found[segment] = a | once, b | twice | (a & once)
            else:
                found[segment] = once, twice
    for segment, planes in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), *(pa.array([squeeze(x.tobytes())], pa.binary()) for x in planes)], ["segment", "once", "twice"])


def bits_for(lines: int) -> int:
    """Size of a filter as a power of two: eight bits a line."""
    return min(MOST_BITS, max(SEGMENT_BITS, math.ceil(math.log2(8 * max(lines, 1)))))


def suspects(docs: DataFrame, min_chars: int, filter_bits: int) -> DataFrame:
    """(_id, _key): the distinct lines of each document that the twice-seen filter holds."""
    if not SEGMENT_BITS <= filter_bits <= MOST_BITS:
        raise ValueError("filter_bits must be from 20 to 30")
    spark = docs.sparkSession
    segments = 1 << (filter_bits - SEGMENT_BITS)
    parts = docs.select("_text").mapInArrow(lambda b: _filters(b, filter_bits, min_chars), "segment int, once binary, twice binary")
    merged = tree_merge(parts, _merge, segments, tasks(docs, SPLIT_BYTES)).select("segment", "twice")
    twice = np.zeros(1 << (filter_bits - 3), np.uint8)
    for row in merged.collect():  # 2**filter_bits bits at most
        own = row["segment"] << (SEGMENT_BITS - 3)
        twice[own : own + (1 << (SEGMENT_BITS - 3))] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["twice"])), np.uint8)
    shared = spark.sparkContext.broadcast(twice)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            per = [_keys(text, min_chars) for text in batch.column("_text").to_pylist()]
            counts = np.fromiter(map(len, per), np.int64, len(per))
            keys = [k for x in per for k in x]
            a, b = _bits(keys, len(keys), (1 << filter_bits) - 1)
            hit = ((seen[a >> 3] >> (7 - (a & 7))) & (seen[b >> 3] >> (7 - (b & 7))) & 1).astype(bool)
            ids = batch.column("_id").take(pa.array(np.repeat(np.arange(len(per)), counts)[hit]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([keys[i].decode() for i in np.flatnonzero(hit).tolist()], pa.string())], ["_id", "_key"])

    return docs.select("_id", "_text").mapInArrow(run, "_id long, _key string")


def _repeats(found: DataFrame) -> DataFrame:
    """(_id, _key): the suspects that go, because a smaller document holds the line too; a null id is larger than all others."""
    total = found.count()
    several = (F.col("_first") < F.col("_last")) | (F.col("_null") & F.col("_first").isNotNull())
    firsts = found.groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.max(F.col("_id").isNull()).alias("_null"), F.count(F.lit(1)).alias("_n"))
    firsts = cut(firsts.where(several).select("_key", "_first", "_n", F.xxhash64("_key").alias("_hash")))
    heavy = F.col("_n") * HEAVY > total  # fewer than HEAVY lines
    marks = F.broadcast(firsts.where(heavy).select("_hash").distinct())
    goes = (F.col("_id") > F.col("_first")) | (F.col("_id").isNull() & F.col("_first").isNotNull())
    named = found.withColumn("_hash", F.xxhash64("_key"))
    light = named.join(marks, "_hash", "left_anti").join(firsts.drop("_hash"), "_key")
    salted = named.join(marks, "_hash").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    dealt = firsts.join(marks, "_hash").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hot = salted.drop("_hash").join(dealt.drop("_hash"), ["_key", "_salt"])
    return light.where(goes).select("_id", "_key").unionByName(hot.where(goes).select("_id", "_key"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, filter_bits: int | None = None) -> DataFrame:
    """(row struct, kept string, n_lines long, n_dropped long): each input row and its text without repeated lines."""
    rows = stable(docs).select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    if filter_bits is None:
        filter_bits = bits_for(rows.agg(F.sum(F.regexp_count("_text", F.lit("\n")) + 1)).first()[0] or 0)
    found = cut(suspects(rows, min_chars, filter_bits))
    drops = _repeats(found).groupBy(F.col("_id").alias("_own")).agg(F.collect_set("_key").alias("_drop"))
    joined = rows.join(drops, F.col("_id").eqNullSafe(F.col("_own")), "left").select("_row", "_text", "_drop")
    out = StructType([joined.schema["_row"], StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, drop in zip(batch.column("_text").to_pylist(), batch.column("_drop").to_pylist(), strict=True):
                own = (text or "").split("\n")
                lines.append(len(own))
                if drop:
                    gone = {k.encode() for k in drop}
                    own = [x for x in own if x.encode().lower().strip(WHITE) not in gone]
                    kept.append("\n".join(own))
                else:
                    kept.append(text or "")
                dropped.append(lines[-1] - len(own))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["_row", "kept", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, out)
