"""SimHash fingerprints of texts, Hamming distances and banded search for near fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words, English then Serbian.
STOP_WORDS = """
I ME MY MYSELF WE OUR OURS OURSELVES YOU YOUR YOURS YOURSELF YOURSELVES HE HIM
HIS HIMSELF SHE HER HERS HERSELF IT ITS ITSELF THEY THEM THEIR THEIRS THEMSELVES WHAT
WHICH WHO WHOM THIS THAT THESE THOSE AM IS ARE WAS WERE BE BEEN BEING
HAVE HAS HAD HAVING DO DOES DID DOING A AN THE AND BUT IF OR
BECAUSE AS UNTIL WHILE OF AT BY FOR WITH ABOUT AGAINST BETWEEN INTO THROUGH DURING
BEFORE AFTER ABOVE BELOW TO FROM UP DOWN IN OUT ON OFF OVER UNDER AGAIN
FURTHER THEN ONCE HERE THERE WHEN WHERE WHY HOW ALL ANY BOTH EACH FEW MORE
MOST OTHER SOME SUCH NO NOR NOT ONLY OWN SAME SO THAN TOO VERY S
T CAN WILL JUST DON SHOULD NOW
I U JE SE DA SU NA SA ZA OD DO KAO STO STA
ALI ILI PAK CAK SVE BIO BIH BITI NEGO KADA KOJI
KOJA KOJE ONI BUDE BUDU JEDAN JEDNA JEDNO NEKI NEKA
NEKO NJIH CIJI CIJA CIJE MOJ MOJA MOJE TVOJ TVOJA
TVOJE NAS NASA NASE VAM VAMA NAMA ONO ONI ONA
NISAM NISI NIJE NISMO NISTE NISU JESAM JESI JESMO
JESTE JESU
""".split()


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in upper case, without stop words. The runs are matched themselves: Java looks up a plain class in a table, a negated one by calls for each character."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)")), F.upper)
    return F.filter(words, lambda w: ~w.isin(sorted(set(STOP_WORDS))))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_tokens, n_distinct) for each row whose text has tokens. They are made once: a generator drops the other rows, as the optimizer would copy the expression into a filter. No shuffle."""
    counted = F.transform(F.array(tokens(F.col(text_col))), lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")))
    return docs.select(id_col, F.inline(F.filter(counted, lambda x: x["n_tokens"] > 0)))


#: Bytes of a text taken at once; a token that stands at the cut is taken whole, so these are up to half as many tokens.
PIECE = 1 << 17
#: Words whose bits a task keeps.
KEPT = PIECE
_TOKEN, _BREAK = re.compile(b"[A-Za-z0-9]+"), re.compile(b"[^A-Za-z0-9]")


def _pieces(text: pa.Scalar) -> Iterator[bytes]:
    """A text's bytes in pieces, a-z in upper case, cut where no token is. Bytes of other letters are no part of a token."""
    raw = memoryview(text.as_buffer() or b"")
    at = 0
    while at < len(raw):
        found = _BREAK.search(raw, at + PIECE)
        end = found.start() if found else len(raw)
        yield bytes(raw[at:end]).upper()
        at = end


def _prints(batches: Iterable[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """A text's word bits are summed where the text is, piece by piece; beside the batch, memory holds one piece and the bits of KEPT words, each hashed once while it is kept."""
    stop = frozenset(w.encode() for w in STOP_WORDS)
    number: dict[bytes, int] = {}
    bits = np.zeros((KEPT, 64), np.uint8)
    for batch in batches:
        texts = batch.column("_text")
        halves = np.zeros((len(texts), 64), bool)
        for i, text in enumerate(texts):
            on, n = np.zeros(64, np.int64), 0
            for piece in _pieces(text):
                words = [w for w in _TOKEN.findall(piece) if w not in stop]
                new = set(words).difference(number)
                if len(number) + len(new) > KEPT:
                    number.clear()
                    new = set(words)
                if new:
                    first = len(number)
                    number.update(zip(new, range(first, first + len(new)), strict=True))
                    digests = np.frombuffer(b"".join([hashlib.md5(w).digest()[:8] for w in new]), np.uint8).reshape(-1, 8)
                    bits[first : first + len(new)] = np.unpackbits(digests, axis=1)
                on += bits[[number[w] for w in words]].sum(axis=0, dtype=np.int64) if words else 0
                n += len(words)
            halves[i] = 2 * on > n
        packed = np.packbits(halves, axis=1).view(">u4").astype(np.int64).reshape(-1, 2)
        out = pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(packed[:, 0]), pa.array(packed[:, 1])], [id_col, "hi", "lo"])
        batch = texts = text = None  # not held while the next one is read
        yield out


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, hi, lo) for each row: both halves of a 64-bit fingerprint. A bit is on if more of the words' bits are on than off. No shuffle."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(lambda b: _prints(b, id_col), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, hi long, lo long")


def hexed(hi: str = "hi", lo: str = "lo") -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 8, "0"), F.lpad(F.hex(lo), 8, "0")))


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def near(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, distance, n_a, n_b): pairs of different fingerprints at most ``most`` (up to 3) bits apart, and how many texts have each.

    Texts with one fingerprint are one row, so copies make no pairs. Of five blocks of 13 bits (the last of
    12) two such fingerprints share two at least; each pair of blocks is a key of 25 or 26 bits, and a pair of
    fingerprints comes from the first key it shares only.
    """
    if not 0 <= most <= 3:
        raise ValueError("bands find up to 3 differing bits")
    distinct = prints.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    both = F.call_function("shiftleft", F.col("hi"), F.lit(32)).bitwiseOR(F.col("lo"))
    block = [F.shiftrightunsigned("_x", 13 * i).bitwiseAND(F.lit(0x1FFF)) for i in range(5)]
    keys = [(block[i] * 8192 + block[j]) * 16 + k for k, (i, j) in enumerate(combinations(range(5), 2))]
    banded = distinct.withColumn("_x", both).withColumn("keys", F.array(*keys)).select("hi", "lo", "n", "_x", "keys", F.explode("keys").alias("key"))
    a, b = banded.alias("a"), banded.alias("b")
    before = (F.col("a.hi") < F.col("b.hi")) | ((F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") < F.col("b.lo")))
    apart = F.bit_count(F.col("a._x").bitwiseXOR(F.col("b._x")))
    first = F.get(F.array_intersect("a.keys", "b.keys"), F.lit(0)) == F.col("a.key")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & before & (apart <= most)).where(first)
    return pairs.select(hexed("a.hi", "a.lo").alias("a"), hexed("b.hi", "b.lo").alias("b"), apart.cast("int").alias("distance"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
