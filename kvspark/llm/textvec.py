"""Vectorised tokenising: many texts at once as one array of code points.

Words and pre-tokens come out as spans over that array, with a 64-bit hash of each span, so that no
Python object is made for an occurrence, only for each distinct word.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

from kvspark.llm.common import mix64

SPACE, LETTER, NUMBER, OTHER, EDGE = 0, 1, 2, 3, 4

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# ASCII white space, [\x20\x09-\x0D].
ASCII_SPACE = [*range(0x09, 0x0E), 0x20]

#: Code points that are hashed at once.
_STEP = 1 << 15


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_SPACE] = SPACE
    return out


@functools.cache
def _lower() -> np.ndarray:
    """Lower case where that is one code point, for the Basic Multilingual Plane; others stay."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
            out[c] = ord(x)
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, str]:
    """The joined texts as code points, where each text's separator stands (one after each), and the joined string."""
    joined = "\n".join(texts) + "\n" if texts else ""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1 if texts else np.zeros(0, np.int64)
    return cp, ends, joined


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's code points: the sum of a mixed number for each pair of place and code point.

    The pairs are told apart exactly before they are mixed, so no structure of a text carries over into the
    sum. Hashes of different families are independent; two of them make 128 bits.
    """
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    upto = np.cumsum(lengths)
    salt = np.uint64((family * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    room = np.empty(_STEP, np.uint64)
    lo = 0
    while lo < len(starts):
        before = int(upto[lo - 1]) if lo else 0
        hi = int(np.searchsorted(upto, before + _STEP, "right"))
        if hi <= lo:  # one span longer than a step: its pieces add up
            a, b = int(starts[lo]), int(ends[lo])
            pieces = (_mixed(np.arange(at - a, min(at + _STEP, b) - a), cp[at : min(at + _STEP, b)], salt, room) for at in range(a, b, _STEP))
            out[lo] = sum(int(np.sum(x, dtype=np.uint64)) for x in pieces) & (2**64 - 1)
            lo += 1
            continue
        some = lo + np.flatnonzero(lengths[lo:hi])
        if len(some):
            first = upto[some] - lengths[some] - before
            step = np.ones(int(upto[hi - 1]) - before, np.int64)  # running sums of steps, in place of a repetition for each span
            step[first[1:]] = starts[some][1:] - ends[some][:-1] + 1
            step[0] = starts[some[0]]
            letters = cp[np.cumsum(step, out=step)]
            step[:] = 1
            step[first[1:]] = 1 - lengths[some][:-1]
            step[0] = 0
            out[some] = np.add.reduceat(_mixed(np.cumsum(step, out=step), letters, salt, room), first)
        lo = hi
    return mix64(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ salt)


def _mixed(place: np.ndarray, cp: np.ndarray, salt: np.uint64, room: np.ndarray) -> np.ndarray:
    """One number for each place and code point (of 21 bits); the place may have 43. Overwrites ``place`` and ``room``."""
    x, t = place.view(np.uint64), room[: len(place)]
    x <<= np.uint64(21)
    x |= cp
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
        np.right_shift(x, np.uint64(shift), out=t)
        x ^= t
        if factor:
            x *= np.uint64(factor)
    return x


def _runs(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    padded = np.zeros(len(wanted) + 2, np.int8)
    padded[1:-1] = wanted
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def ascii_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: code points, starts, ends and each word's text number."""
    cp, seps, _ = code_points(texts)
    upper = (cp >= 65) & (cp <= 90)
    cp = cp + upper.astype(np.uint32) * np.uint32(32)
    starts, ends = _runs(~(((cp >= 9) & (cp <= 13)) | (cp == 32)))
    return cp, starts, ends, np.searchsorted(seps, starts)


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, lower-cased: code points, starts, ends and each word's text number."""
    cp, seps, _ = code_points(texts)
    letters = _classes()[cp] == LETTER
    cp = _lower()[cp]
    starts, ends = _runs(letters)
    return cp, starts, ends, np.searchsorted(seps, starts)


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """The matches of the byte-level BPE pattern (contractions, words, numbers, other runs, white space).

    Returns code points, starts, ends, each match's text number and the joined string.
    Greedy white space gives its last character to what follows if that is a plain space,
    else leaves it as a match of its own; white space at a text's end stays whole.
    """
    cp, seps, joined = code_points(texts)
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return cp, z, z, z, joined
    cls = _classes()[cp]
    cls[seps] = EDGE
    start = np.ones(n, bool)
    start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == EDGE)
    last = np.zeros(n, bool)  # the last white space of a run before something
    last[:-1] = (cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != EDGE)
    start |= last
    joins = np.flatnonzero(last & (cp == 32)) + 1
    start[joins] = False
    quote = np.flatnonzero(start & (cp == 39))
    if len(quote):
        follow = np.concatenate((cp, np.zeros(3, np.uint32)))
        c1, c2 = follow[quote + 1], follow[quote + 2]
        c1, c2 = np.where(follow[quote + 1] > 127, 0, c1), np.where(c2 > 127, 0, c2)
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for at, k in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            start[at + k] = True  # the separator at the latest
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    real = cls[starts] != EDGE
    starts, ends = starts[real], ends[real]
    return cp, starts, ends, np.searchsorted(seps, starts), joined
