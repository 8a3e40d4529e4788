"""Removal of long repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else. To keep suffix
arrays small and independent, every such string is first sent to the one place where all its equals are.

1. Each window of ``length`` bytes names its anchor: the rightmost smallest hash among its ``GRAM``-byte
   grams. Equal windows name equal anchors at equal places. The windows of one anchor are a segment.
2. Anchors that occur once end here. Where all segments of an anchor are equal, they are repeats whole.
   Segments that occur twice are too. Each distinct segment of the other anchors is fetched once.
3. Groups of distinct segments with a common anchor are concatenated and sorted: suffixes smaller than
   their successors directly, the others induced by bucket scans in the order of first bytes; adjacent
   common prefixes of at least ``length`` bytes mark the repeats.
4. Groups above ``group`` segments (passages that very many texts share, each with its own surroundings)
   are split first: the windows of a segment are halved by their distance from the anchor, and what all
   windows of a half have in common becomes the half's key. Equal halves are settled, unique ones too,
   so in each round one half of a segment at most is left, until a group is small or a key is a window.
5. Each text gets the ranges to remove. Ranges are judged on the input.

Cases: null counts as empty; texts shorter than ``length`` stay; texts of any length are taken whole; among
grams with the same smallest hash the rightmost is the anchor; rows repeated with id and text each lose what
the other repeats; null ids are ids; an empty table gives an empty table; only id and text are read, so
other columns may have any names. Documents are told apart by 128 bits (two hashes of id and text); a
segment by the hashes of its anchor and of its bytes, 64 bits each, and pieces that are sorted by their bytes.

The rounds of step 4 halve the windows, so there are log2(length) of them at most. Anchors, halves and
documents with very many segments are joined by broadcast, fewer than 1,024 heavy ones at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.ann import sorted_groups
from kvspark.llm.common import cut, drop_cut, join_back, mix64, stable, tasks

GRAM, GROUP, BATCH_BYTES, CHUNK_BYTES, EDGE = 48, 2048, 1 << 19, 1 << 17, 0xFF  # no UTF-8 text holds the byte EDGE

#: Input for each task of the shuffles.
TASK_BYTES = 16 << 20
ROW = ["_r1", "_r2"]  # the two hashes that name a document


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data)
    h8 = mix64(np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)))
    join = lambda a, b, step, m: a[: n - m + 1] * np.uint64(0x9E3779B97F4A7C15) + (b[step : step + n - m + 1] ^ (b[step : step + n - m + 1] >> np.uint64(29)))
    h16 = join(h8, h8, 8, 16)
    h32 = join(h16, h16, 16, 32)
    return mix64(join(h32, h16, 32, 48))


def _content(grams: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each segment, from the grams that lie end to end in it and the one at its end."""
    if not len(first):
        return np.zeros(0, np.uint64)
    n = -(-lengths // GRAM)
    begins = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(begins, n)
    at = np.repeat(first, n) + np.minimum(place * GRAM, np.repeat(lengths - GRAM, n))
    mixed = mix64(grams[at] ^ mix64((place + 1).astype(np.uint64)))
    return mix64(np.add.reduceat(mixed, begins) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of concatenated texts (each ends in EDGE): hashes of the anchor and of the content, first window, windows, place of the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length + 1:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h = _grams(data)
    width = length - GRAM + 1
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    last = len(h) - 1
    key = (h >> bits << bits) | (last - np.arange(len(h))).astype(np.uint64)
    size, low = 1, key
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    windows = len(h) - width + 1
    low = np.minimum(low[:windows], low[width - size : width - size + windows])
    place = last - (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    inside = np.concatenate((np.zeros(1, np.int64), np.cumsum(data == EDGE)))
    whole = inside[np.arange(windows) + length] == inside[:windows]
    start = whole.copy()
    start[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    end = whole.copy()
    end[:-1] &= (place[1:] != place[:-1]) | ~whole[1:]
    first, final = np.flatnonzero(start), np.flatnonzero(end)
    return h[place[first]], _content(h, first, final - first + length), first, final - first + 1, place[first]


def _gather(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in chunks: number of the first, their bytes, each ended by EDGE, and where each begins."""
    at = 0
    while at < len(texts):
        parts, n = [], 0
        to = at
        while to < len(texts) and (to == at or n < CHUNK_BYTES):
            raw = (texts[to] or "").encode()
            parts += [raw, b"\xff"]
            n += len(raw) + 1
            to += 1
        begins = np.cumsum([0, *(len(x) + 1 for x in parts[::2])])
        yield at, np.frombuffer(b"".join(parts), np.uint8), begins
        at = to


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes at least, by two-stage sorting."""
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    # A suffix is small if it is less than its successor: decided where bytes next differ; the last is not.
    differ = np.flatnonzero(t[1:] != t[:-1])
    nxt = np.searchsorted(differ, np.arange(n - 1))
    small = np.zeros(n, bool)
    ok = nxt < len(differ)
    at = differ[np.minimum(nxt, max(len(differ) - 1, 0))] if len(differ) else np.zeros(n - 1, np.int64)
    small[:-1][ok] = t[at[ok]] < t[at[ok] + 1]
    direct = np.flatnonzero(small).tolist()
    direct.sort(key=lambda i: data[i : i + depth])
    direct_of = np.array(direct, np.int64)
    bounds = np.searchsorted(t[direct_of], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[t[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        own = [wave]
        while len(wave):  # predecessors with the same byte follow in the same bucket
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & ~small[before]]
            own.append(wave)
        bucket = np.concatenate([*own, direct_of[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(t[before] > c) & ~small[before]]
        order = np.argsort(t[before], kind="stable")
        before = before[order]
        values, cuts = np.unique(t[before], return_index=True)
        for v, part in zip(values.tolist(), np.split(before, cuts[1:]), strict=True) if len(values) else ():
            queues[v].append(part)
    return np.concatenate(out)


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment the windows (by first byte) that another window of any segment equals."""
    data = b"\xff".join([*segments, b""])
    order = suffix_array(data, length)
    t = np.frombuffer(data + b"\xff" * 8, np.uint8)
    ends = np.cumsum([len(s) + 1 for s in segments])
    begins = ends - np.array([len(s) + 1 for s in segments])
    of = np.searchsorted(ends, order, "right")
    order, of = order[order + length < ends[of]], None  # suffixes that hold a whole window
    words = np.ndarray((len(t) - 7,), "<u8", t, strides=(1,))
    alive = np.arange(len(order) - 1)
    for step in range(0, length - 7, 8):  # adjacent common prefixes, eight bytes at a time
        alive = alive[words[order[alive] + step] == words[order[alive + 1] + step]]
    if length % 8:
        alive = alive[words[order[alive] + length - 8] == words[order[alive + 1] + length - 8]]
    hit = np.unique(np.concatenate((order[alive], order[alive + 1]))) if len(order) > 1 else np.zeros(0, np.int64)
    where = np.searchsorted(ends, hit, "right")
    cuts = np.searchsorted(where, np.arange(len(segments) + 1))
    return [hit[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], begins.tolist(), strict=True)]


def _ranges(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the windows cover."""
    cuts = np.flatnonzero(np.diff(windows) > length)
    return [(int(windows[a]), int(windows[b]) + length) for a, b in zip([0, *(cuts + 1)], [*cuts, len(windows) - 1], strict=True)] if len(windows) else []


def _bytes_hash(raw: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(raw)
    return h - (1 << 64) if h >> 63 else h


def _segments(rows: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = (np.asarray(batch.column(c)) for c in ROW)
            for at, data, begins in _gather(batch.column("_text").to_pylist()):
                h, s, first, windows, place = anchors(data, length)
                of = np.searchsorted(begins, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(r1[at + of]), pa.array(r2[at + of]), pa.array((first - begins[of]).astype(np.int32)), pa.array((windows - 1 + length).astype(np.int32)), pa.array((place - first).astype(np.int32))],
                    ["h", "s", *ROW, "a", "len", "off"],
                )

    return rows.select(*ROW, "_text").mapInArrow(find, "h long, s long, _r1 long, _r2 long, a int, len int, off int")


def _settle(pieces: DataFrame, length: int, parts: int) -> DataFrame:
    """(h, s, lo, hi): repeated ranges of pieces (key, h, s, base, piece), key by key, with suffix arrays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        total = 0

        def close() -> Iterator[pa.RecordBatch]:
            same: dict[bytes, list[tuple[int, int, int]]] = {}
            for h, s, base, piece in held:
                same.setdefault(piece, []).append((h, s, base))
            segments = list(same)
            out = []
            for piece, found in zip(segments, repeated_windows(segments, length), strict=True):
                ranges = [(0, len(piece))] if len(same[piece]) > 1 else _ranges(found, length)
                out += [(h, s, base + lo, base + hi) for h, s, base in same[piece] for lo, hi in ranges]
            if out:
                h, s, lo, hi = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["h", "s", "lo", "hi"])

        for group in sorted_groups(batches):
            rows = {(h, s, base): piece for h, s, base, piece in zip(*(group.column(c).to_pylist() for c in ("h", "s", "base", "piece")), strict=True)}
            if len(rows) < 2:
                continue
            if held and total + sum(map(len, rows.values())) > BATCH_BYTES:
                yield from close()
                held, total = [], 0
            held += [(*k, v) for k, v in rows.items()]
            total += sum(map(len, rows.values()))
        if held:
            yield from close()

    sorted_rows = pieces.select(F.col("key").alias("_cell"), "h", "s", "base", "piece").repartition(parts, "_cell").sortWithinPartitions("_cell")
    return sorted_rows.mapInArrow(run, "h long, s long, lo int, hi int")


def _halve(pieces: DataFrame, length: int) -> DataFrame:
    """Both halves of each piece's windows: by distance from the anchor; key and content hash of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, s, off, base, low, high, key, piece in zip(*(batch.column(c).to_pylist() for c in ("h", "s", "off", "base", "low", "high", "key", "piece")), strict=True):
                middle = (low + high) // 2
                anchor = off - base  # place in the piece
                for a, b in ((low, middle), (middle, high)):
                    # windows that start from anchor - (b - 1) to anchor - a, as far as the piece has them
                    first, last = max(anchor - b + 1, 0), min(anchor - a, len(piece) - length)
                    if a >= b or first > last:
                        continue
                    core = piece[anchor - a : anchor - b + 1 + length]
                    own = piece[first : last + length]
                    new = int(mix64(np.array([_bytes_hash(core) ^ key ^ (a * 1009 + b)]).astype(np.int64).view(np.uint64)).view(np.int64)[0])
                    out.append((h, s, off, base + first, a, b, new, _bytes_hash(own), own))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "s", "off", "base", "low", "high", "key", "c", "piece"])

    return pieces.select("h", "s", "off", "base", "low", "high", "key", "piece").mapInArrow(run, "h long, s long, off int, base int, low int, high int, key long, c long, piece binary")


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed before they shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([squeeze((x or "").encode()) for x in batch.column("_text").to_pylist()], pa.binary())], [*batch.schema.names[:-1], "_packed"])

    from pyspark.sql.types import BinaryType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1]]).add("_packed", BinaryType()))


def _fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of segments (h, s, _r1, _r2, a, len, off, hot)."""
    lists = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("h", "s", "a", "len", "off", "hot")).alias("_want"))
    both = _packed(rows.select(*ROW, "_text")).join(lists, ROW).select("_packed", "_want")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, want in zip(batch.column("_packed"), batch.column("_want").to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(packed.as_py())
                columns = [pa.array([w["h"] for w in want], pa.int64()), pa.array([w["s"] for w in want], pa.int64()), pa.array([w["off"] for w in want], pa.int32()), pa.array([raw[w["a"] : w["a"] + w["len"]] for w in want], pa.binary()), pa.array([w["hot"] for w in want], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "s", "off", "piece", "hot"])

    from kvspark.llm.ann import _merged

    return both.mapInArrow(lambda b: _merged(run(b), 2048), "h long, s long, off int, piece binary, hot boolean")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group: int = GROUP) -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans) for each row."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    source = stable(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    parts = tasks(source, TASK_BYTES)
    text, name = F.coalesce(F.col("_text").cast("string"), F.lit("")), F.col("_id").cast("string")
    rows = source.select("_id", F.xxhash64(name, text).alias("_r1"), F.xxhash64(F.lit(1), text, F.lit(2), name).alias("_r2"), text.alias("_text"))
    found = cut(_segments(rows.where(F.octet_length("_text") >= length), length))
    kinds = found.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), F.min("s").alias("_lo"), F.max("s").alias("_hi")).where("_n > 1")
    kinds = cut(kinds.select("h", "_n", (F.col("_lo") < F.col("_hi")).alias("_mixed")))
    marked = cut(join_back(found, kinds, "h", found.count()).drop("_n"))
    drop_cut(found)
    same = marked.where("not _mixed").select(*ROW, F.col("a").alias("lo"), (F.col("a") + F.col("len")).alias("hi"))
    mixed = marked.where("_mixed")
    distinct = mixed.groupBy("h", "s").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*ROW, "a", "len", "off")).alias("_one"))
    distinct = cut(distinct.select("h", "s", "_n", "_one.*"))
    crowds = cut(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("_m")))
    wanted = join_back(distinct, crowds, "h", distinct.count(), "_m").withColumn("hot", F.col("_m") > group)
    pieces = _fetch(rows, wanted).dropDuplicates(["h", "s"]).withColumn("base", F.lit(0)).withColumn("key", F.col("h"))
    if crowds.where(F.col("_m") > group).first() is not None:
        pieces = cut(pieces)
        columns = ["key", "h", "s", "base", "piece"]
        small, equal = pieces.where("not hot").select(columns), []
        hot = pieces.where("hot").withColumn("low", F.lit(0)).withColumn("high", F.lit(length - GRAM + 1))
        while True:
            halves = cut(_halve(hot, length))
            state = cut(halves.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_n > 1"))
            halves = cut(join_back(halves, state, "key", halves.count()))
            equal.append(halves.where("_lo = _hi").select("h", "s", F.col("base").alias("lo"), (F.col("base") + F.length("piece")).alias("hi")))
            small = small.unionByName(halves.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") <= group)).select(columns))
            hot = halves.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > group))
            if hot.first() is None:
                break
        settled = reduce(DataFrame.unionByName, equal, _settle(small, length, parts))
    else:
        settled = _settle(pieces, length, parts)
    ones = distinct.where("_n = 1").select("h", "s", *ROW, "a")  # segments that occur twice go whole
    ranges = settled.join(ones, ["h", "s"]).select(*ROW, (F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi")).alias("hi"))
    twice = cut(distinct.where("_n > 1").select(F.struct("h", "s").alias("_hs"), "_n"))
    whole = join_back(mixed.select(F.struct("h", "s").alias("_hs"), *ROW, "a", "len"), twice, "_hs", mixed.count())
    whole = whole.select(*ROW, F.col("a").alias("lo"), (F.col("a") + F.col("len")).alias("hi"))
    ranges = same.unionByName(whole).unionByName(ranges).groupBy(*ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    both = _packed(rows.select("_id", *ROW, "_text")).join(ranges, ROW, "left").select("_id", "_packed", "_ranges")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for packed, own in zip(batch.column("_packed"), batch.column("_ranges").to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(packed.as_py())
                out, at, n = [], 0, 0
                for lo, hi in sorted((r["lo"], r["hi"]) for r in own or ()):
                    if lo > at or (lo == at == 0 and n == 0):  # a new run starts
                        out.append(raw[at:lo])
                        n += 1
                    at = max(at, hi)
                out.append(raw[at:])
                kept.append(b"".join(out))
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                spans.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["_id", "kept", "n_bytes", "n_removed", "n_spans"])

    id_kind = rows.schema["_id"].dataType.simpleString()
    return both.mapInArrow(remove, f"_id {id_kind}, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("_id", id_col)
