"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Encoding runs in three steps.

1. Texts are gathered into blocks. A block's pre-tokens become positions, that is numbers into the
   block's own list of distinct words; only that list is exploded, by word hash, into buckets.
2. A bucket holds every occurrence of its words over all blocks. Each distinct word is merged once.
3. The ids go back to their blocks, where the positions put them in order.

A word appears at most once for a block, so a frequent word makes no hot key, and what is shuffled
is distinct words and packed positions instead of one row for each token. Decoding joins ids with
the token-byte table, which is bounded by the vocabulary and therefore broadcast.

Cases: null text counts as empty and gives no ids; a text of any length is in one block, where it is
tokenised whole and put in order a slice at a time; repeated rows and null or repeated ids each keep
their row; an empty table gives an empty table; other columns are not carried, so their names
cannot clash. Inside a block words are told apart by two independent 64-bit hashes of their code points,
where the first alone is not enough by the second; between blocks by their bytes. The texts are read
twice, so an input that comes out of a shuffle is written to the shared folder first.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm import textvec
from kvspark.llm.common import mix64, stable, tasks

#: Tokens and distinct words after which a block is closed: its size in a worker's memory.
BLOCK_TOKENS, BLOCK_WORDS = 3_000_000, 400_000
#: Characters that are tokenised at once.
CHUNK_CHARS = 50_000
#: Tokens that are put in order at once.
SLICE_TOKENS = 200_000
#: Input for each task of the shuffles, and distinct words that an encoder remembers at most: beyond, a word may be merged again.
TASK_BYTES, KNOWN_WORDS = 32 << 20, 1_000_000


@functools.lru_cache(maxsize=2)
def _vocabulary(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


@functools.lru_cache(maxsize=2)
def _merger(raw: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_vocabulary(raw), special_tokens={})._core_bpe


@functools.lru_cache(maxsize=2)
def _token_bytes(raw: bytes) -> list[bytes]:
    ranks = _vocabulary(raw)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(kinds)
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


class _Block:
    """Texts of one block while it grows."""

    def __init__(self) -> None:
        self.ids: list = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.seconds: list[np.ndarray] = []
        self.spans: list[tuple[np.ndarray, np.ndarray, str]] = []
        self.tokens = self.seen = 0

    def add(self, ids: list, texts: list[str]) -> None:
        cp, starts, ends, of, joined = textvec.pretokens(texts)
        self.ids += ids
        self.counts.append(np.bincount(of, minlength=len(texts)).astype(np.int64))
        self.hashes.append(textvec.span_hashes(cp, starts, ends))
        self.seconds.append(textvec.span_hashes(cp, starts, ends, 1))
        self.spans.append((starts.astype(np.int32), ends.astype(np.int32), joined))  # within a chunk
        self.tokens += len(starts)
        self.seen += len(pd.unique(self.hashes[-1])) // 3  # words of a chunk that are new to the block, roughly

    def close(self) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Key, positions, pre-tokens of each text, hash of each word and the words."""
        hashes = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        seconds = np.concatenate(self.seconds) if self.seconds else np.zeros(0, np.uint64)
        self.hashes.clear()
        self.seconds.clear()
        codes, words, first = _distinct(hashes, seconds)
        sizes = [len(s) for s, _, _ in self.spans]
        texts: list[str] = []
        base = 0
        for (starts, ends, joined), size in zip(self.spans, sizes, strict=True):
            own = first[(first >= base) & (first < base + size)] - base
            texts += [joined[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            base += size
        self.spans.clear()
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        a = b = 0
        for at in range(0, len(hashes), 1 << 18):  # two checksums of the order of the words name the block
            part = hashes[at : at + (1 << 18)]
            place = np.arange(at + 1, at + len(part) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            a += int(np.sum(part * (place | np.uint64(1)), dtype=np.uint64))
            b += int(np.sum(mix64(part ^ place), dtype=np.uint64))
        key = f"{a % 2**64:016x}-{b % 2**64:016x}-{len(hashes)}-{len(counts)}"
        return key, codes, counts, words, texts


def _distinct(hashes: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word among the distinct ones, their first hashes and their first places; words with equal first hashes differ by the second."""
    codes, words = pd.factorize(hashes)
    first = np.empty(len(words), np.int32)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1, dtype=np.int32)
    odd = np.flatnonzero(seconds != seconds[first[codes]])
    if len(odd):  # other words with a hash that is taken: they get numbers of their own
        more, others = pd.factorize(pd.MultiIndex.from_arrays([hashes[odd], seconds[odd]]))
        codes[odd] = len(words) + more
        words = np.concatenate((words, np.array([x for x, _ in others], np.uint64)))
        codes, order = pd.factorize(codes)  # numbers by first place, as before
        words = words[order]
        first = np.empty(len(words), np.int32)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1, dtype=np.int32)
    return codes.astype(np.int32), words, first


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    block = _Block()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        lengths = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + CHUNK_CHARS, "right")))
            block.add(ids[at:to], [t or "" for t in texts.slice(at, to - at).to_pylist()])
            at = to
            if block.tokens >= BLOCK_TOKENS or block.seen >= BLOCK_WORDS:
                yield block
                block = _Block()
                pa.default_memory_pool().release_unused()
    if block.ids:
        yield block


def _word_rows(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        key, _, _, hashes, words = block.close()
        bucket = (hashes >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        numbers, starts = np.unique(bucket[order], return_index=True)
        blobs = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)] if len(starts) else [], strict=True):
            own = order[a:b]
            raw = [words[i].encode() for i in own.tolist()]
            blobs.append(_pack(own.astype(np.uint32), np.fromiter(map(len, raw), np.uint32, len(raw)), np.frombuffer(b"".join(raw), np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(blobs)), pa.array(numbers.astype(np.int64)), pa.array(blobs, pa.binary())], ["block", "bucket", "words"])


def _text_rows(batches: Iterable[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        key, codes, counts, _, _ = block.close()
        codes = codes.astype(np.uint32)
        planes = [((codes >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8) for k in range(4)]  # bytes of one weight together compress best
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([block.ids], pa.list_(id_type)), pa.array([_pack(counts, *planes)], pa.binary())], ["block", "ids", "positions"])


def _encode_words(batches: Iterable[pa.RecordBatch], raw: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    merge, known, here = _merger(raw, pattern), {}, None
    for batch in batches:
        blobs = []
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
            if bucket != here or len(known) > KNOWN_WORDS:  # a word is in one bucket only
                known, here = {}, bucket
            numbers, lengths, text = _unpack(blob, np.uint32, np.uint32, np.uint8)
            text, at, out = text.tobytes(), 0, []
            for n in lengths.tolist():
                word = text[at : at + n]
                at += n
                if (ids := known.get(word)) is None:
                    ids = known[word] = merge.encode_single_piece(word)
                out.append(ids)
            blobs.append(_pack(numbers, np.fromiter(map(len, out), np.uint32, len(out)), np.fromiter((i for x in out for i in x), np.uint32)))
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(blobs, pa.binary())], ["block", "encoded"])


def _decode(ids: pa.ListArray, known: list[bytes]) -> pa.Array:
    return pa.array([None if x is None else b"".join([known[i] for i in x.values.to_numpy().tolist()]) for x in ids], pa.binary())


def _reassemble(left: pa.Table, right: pa.Table, id_type: pa.DataType, known: list[bytes] | None) -> pa.Table:
    pa.default_memory_pool().release_unused()
    numbers, lengths, flat = [], [], []
    for blob in right.column("encoded").to_pylist():
        a, b, c = _unpack(blob, np.uint32, np.uint32, np.uint32)
        numbers.append(a)
        lengths.append(b)
        flat.append(c)
    number = np.concatenate(numbers).astype(np.int64) if numbers else np.zeros(0, np.int64)
    length = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
    ids = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
    size = np.full(int(number.max()) + 1 if len(number) else 0, -1, np.int64)
    begin = np.zeros(len(size), np.int64)
    size[number] = length
    begin[number] = np.cumsum(length) - length
    out_ids, out, decoded = [], [], []
    for own, blob in zip(left.column("ids").to_pylist(), left.column("positions").to_pylist(), strict=True):
        counts, *planes = _unpack(blob, np.int64, np.uint8, np.uint8, np.uint8, np.uint8)
        ends = np.cumsum(counts)
        at = done = 0
        while at < len(own):  # a few texts at a time: what a position needs is many times its packed size
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE_TOKENS, "right")))
            upto_token = int(ends[to - 1])
            codes = sum(p[done:upto_token].astype(np.int64) << (8 * k) for k, p in enumerate(planes))
            if len(codes) and (codes.max() >= len(size) or size[codes].min() < 0):
                raise RuntimeError("a block's words are missing: its input rows came in another order when they were read again")
            each = size[codes]
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
            gather = np.arange(upto[-1]) + np.repeat(begin[codes] - upto[:-1], each)
            cuts = upto[np.concatenate((np.zeros(1, np.int64), ends[at:to] - done))]
            out.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids[gather])))
            out_ids.append(pa.array(own[at:to], id_type))
            if known is not None:
                decoded.append(_decode(out[-1], known))
            at, done = to, upto_token
    kinds = pa.schema([("id", id_type), ("ids", pa.list_(pa.int32())), *([("decoded", pa.binary())] if known is not None else [])])
    if not out:
        return kinds.empty_table()
    return pa.table([pa.chunked_array(x) for x in (out_ids, out, decoded) if x], schema=kinds)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids array<int>) for each row: its text's tokens, without special tokens.

    With ``decoded`` the ids are decoded as decode() does, in the same task, into one more column.

    ``ranks`` holds the rank file. The scanner knows the usual pattern of contractions, words,
    numbers, other runs and white space; a caller with another pattern gets an error.
    """
    if "\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+" not in pattern:
        raise ValueError("unknown pre-token pattern")
    spark = docs.sparkSession
    source = stable(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    id_kind = source.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_kind)
    parts = tasks(source, TASK_BYTES)
    buckets = 8 * parts
    shared = spark.sparkContext.broadcast((ranks, pattern))
    words = source.mapInArrow(lambda b: _word_rows(b, buckets), "block string, bucket long, words binary")
    texts = source.mapInArrow(lambda b: _text_rows(b, arrow_id), f"block string, ids array<{id_kind.simpleString()}>, positions binary")
    words = words.repartition(parts, "bucket").sortWithinPartitions("bucket")
    encoded = words.mapInArrow(lambda b: _encode_words(b, *shared.value), "block string, encoded binary")
    put = lambda a, b: _reassemble(a, b, arrow_id, _token_bytes(shared.value[0]) if decoded else None)
    both = texts.repartition(parts, "block").groupBy("block").cogroup(encoded.repartition(parts, "block").groupBy("block"))
    out = both.applyInArrow(put, f"id {id_kind.simpleString()}, ids array<int>" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give null, unknown ids an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    place = encoded.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _token_bytes(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decode(batch.column(place), known)], [*batch.schema.names, out_col])

    from pyspark.sql.types import BinaryType, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add(out_col, BinaryType()))


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each encoded and decoded text: its number of tokens, and SHA-256 of the ids and of the decoded bytes."""
    hexed: Column = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), hexed.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
