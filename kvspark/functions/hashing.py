"""Hash families of the sketches.

md5 (the default) is made of built-in functions and gives the same values in other engines. murmur3 is
the canonical function, for parity with stored sketches, as an Arrow batch function.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32, MASK64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def md5_32(x: Column, part: int = 0) -> Column:
    """The part-th 32 bits of a string's MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 8 * part + 1, 8), 16, 10).cast("long")


def salted_32(x: Column, salt: Column) -> Column:
    return md5_32(F.concat(salt.cast("string"), F.lit(":"), x))


def _rotl(x: int, r: int, bits: int) -> int:
    return ((x << r) | (x >> (bits - r))) & ((1 << bits) - 1)


def murmur3_x86_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, 32 bits, of bytes."""
    c1, c2, h = 0xCC9E2D51, 0x1B873593, seed
    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (_rotl(h ^ (_rotl(k * c1 & MASK32, 15, 32) * c2 & MASK32), 13, 32) * 5 + 0xE6546B64) & MASK32
    if tail := data[whole:]:
        h ^= _rotl(int.from_bytes(tail, "little") * c1 & MASK32, 15, 32) * c2 & MASK32
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * factor & MASK32
    return h


def murmur3_x64_64(data: bytes, seed: int = 0) -> int:
    """The low 64 bits of MurmurHash3, 128 bits for 64-bit machines, of bytes."""
    c1, c2, h1, h2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, seed, seed
    whole = len(data) // 16 * 16
    for k1, k2 in struct.iter_unpack("<QQ", data[:whole]):
        h1 ^= _rotl(k1 * c1 & MASK64, 31, 64) * c2 & MASK64
        h1 = ((_rotl(h1, 27, 64) + h2) * 5 + 0x52DCE729) & MASK64
        h2 ^= _rotl(k2 * c2 & MASK64, 33, 64) * c1 & MASK64
        h2 = ((_rotl(h2, 31, 64) + h1) * 5 + 0x38495AB5) & MASK64
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= _rotl(int.from_bytes(tail[8:], "little") * c2 & MASK64, 33, 64) * c1 & MASK64
    if tail:
        h1 ^= _rotl(int.from_bytes(tail[:8], "little") * c1 & MASK64, 31, 64) * c2 & MASK64
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & MASK64
    h2 = (h2 + h1) & MASK64
    mixed = []
    for h in (h1, h2):
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & MASK64
        h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & MASK64
        mixed.append(h ^ (h >> 33))
    return (mixed[0] + mixed[1]) & MASK64


def _by_length(values: pa.Array, hashed: Callable[[np.ndarray], np.ndarray], single: Callable[[bytes], int]) -> np.ndarray:
    """Hashes of strings, all those of one length at once; long or lonely ones one by one."""
    values = values.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros(len(values), np.uint64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        if len(at) < 4 or n > 4096:
            out[at] = [single(data[offsets[i] : offsets[i + 1]].tobytes()) for i in at.tolist()]
        else:
            out[at] = hashed(data[offsets[at][:, None] + np.arange(n)])
    return out


def _turn(x: np.ndarray, r: int, bits: int) -> np.ndarray:
    return (x << x.dtype.type(r)) | (x >> x.dtype.type(bits - r))


def _words(rows: np.ndarray, kind: str) -> np.ndarray:
    """Rows of bytes as words, low byte first, padded with zeros."""
    size = np.dtype(kind).itemsize
    padded = np.zeros((len(rows), -(-rows.shape[1] // size) * size), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(kind)


def _batch_32(rows: np.ndarray, seed: int) -> np.ndarray:
    n, u = rows.shape[1], np.uint32
    c1, c2 = u(0xCC9E2D51), u(0x1B873593)
    words, h = _words(rows, "<u4"), np.full(len(rows), seed, np.uint32)
    for i in range(words.shape[1]):
        h ^= _turn(words[:, i] * c1, 15, 32) * c2
        if 4 * (i + 1) <= n:  # the tail, shorter than a word, is not turned further
            h = _turn(h, 13, 32) * u(5) + u(0xE6546B64)
    h ^= u(n)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> u(shift))) * u(factor)
    return h.astype(np.uint64)


def _batch_64(rows: np.ndarray, seed: int) -> np.ndarray:
    n, u = rows.shape[1], np.uint64
    c1, c2 = u(0x87C37B91114253D5), u(0x4CF5AD432745937F)
    words = _words(rows, "<u8")
    h1, h2 = np.full(len(rows), seed, np.uint64), np.full(len(rows), seed, np.uint64)
    for i in range(0, words.shape[1], 2):
        whole = 8 * (i + 2) <= n
        if i + 1 < words.shape[1] and not whole:
            h2 ^= _turn(words[:, i + 1] * c2, 33, 64) * c1
        h1 ^= _turn(words[:, i] * c1, 31, 64) * c2
        if whole:
            h1 = (_turn(h1, 27, 64) + h2) * u(5) + u(0x52DCE729)
            h2 ^= _turn(words[:, i + 1] * c2, 33, 64) * c1
            h2 = (_turn(h2, 31, 64) + h1) * u(5) + u(0x38495AB5)
    h1, h2 = h1 ^ u(n), h2 ^ u(n)
    h1 = h1 + h2
    h2 = h2 + h1
    mixed = []
    for h in (h1, h2):
        h = (h ^ (h >> u(33))) * u(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> u(33))) * u(0xC4CEB9FE1A85EC53)
        mixed.append(h ^ (h >> u(33)))
    return mixed[0] + mixed[1]


def murmur3_32(x: Column, seed: int = 0) -> Column:
    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        hashes = _by_length(values, lambda rows: _batch_32(rows, seed), lambda raw: murmur3_x86_32(raw, seed))
        return pa.array(hashes.astype(np.int64), mask=np.asarray(values.is_null()))

    return run(x.cast("string"))


def murmur3_64(x: Column, seed: int = 0) -> Column:
    """As a signed long."""

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        hashes = _by_length(values, lambda rows: _batch_64(rows, seed), lambda raw: murmur3_x64_64(raw, seed))
        return pa.array(hashes.view(np.int64), mask=np.asarray(values.is_null()))

    return run(x.cast("string"))


def murmur3_64_hex(x: Column, seed: int = 0) -> Column:
    return F.lower(F.lpad(F.hex(murmur3_64(x, seed)), 16, "0"))
