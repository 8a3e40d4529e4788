"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Fit. Words and their first 4, 5 and 6 letters are counted, once a text, in a bounded sample of labelled
texts (at most ``sample`` of either label, the first by a hash of the id). Of near copies in the sample,
found by two minimum hashes of their shingles, one is used, or a copied text's ordinary words would look
like a label's. A unit's score is its
log-odds ratio between the labels under a Dirichlet prior that follows the pooled counts; units whose
ratio is large and either LEAST_Z standard errors from 0 (in units that are not rare) or, by Fisher's exact test, as far beyond chance are
listed; the exact test holds for words that no clean text has and for labels of unequal size. A word takes the score of its longest
listed unit, so inflected forms that were never seen still count; other words score slightly below 0.

Scan. One pass over a text's words finds all maximal scoring segments (Ruzzo and Tompa), in time linear
in the words. A segment of score S in m words has the E-value K m exp(-lambda S): lambda solves
sum p exp(lambda s) = 1 over the scores of clean words, K comes from the segments of clean sample texts.

Aggregate. Evidence is the sum, over segments with an E-value below 1, of -log(E); a logistic curve
(Platt, with smoothed labels and the true shares of the labels) turns it into a score from 0 to 1.

Cases: null and empty texts have no evidence and the lowest score, which is below one half; whole texts are
scanned, however long; null ids and repeated rows each get their row; units with one chance are listed by
their hash; without labels of both kinds all scores are 0; rows whose
label is null or whose text is missing teach nothing; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.types import _parse_datatype_string as kind

from kvspark.llm import textvec
from kvspark.llm.common import cut, mix64
from kvspark.llm.jaccard import shingle_sets

#: Labelled texts of either label that the fit reads at most; units that it lists at most.
SAMPLE, LISTED = 10_000, 65_536
PREFIXES = (6, 5, 4)
#: Weight of the prior, least log-odds of a listed unit and standard errors with the chance it may have, share of listed words in a toxic passage.
PRIOR, LEAST_ODDS, LEAST_Z, PASSAGE = 20.0, math.log(5), 4.0, 0.2
#: Texts of the rarer label that a unit must be expected in for its standard error to count (Cochran's rule).
LEAST_EXPECTED = 5
CHUNK_CHARS = 50_000
PASSAGES = "array<struct<start:int,end:int,score:double,evalue:double>>"


@dataclass(frozen=True)
class Model:
    units: np.ndarray  # sorted hashes
    scores: np.ndarray
    other: float  # score of a word that is not listed
    lam: float
    k: float
    slope: float
    intercept: float


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends and text of each word, and its units from the longest to the shortest (0: none)."""
    cp, starts, ends, of = textvec.letter_words(texts)
    found = [textvec.span_hashes(cp, starts, ends) | np.uint64(1)]
    for n in PREFIXES:
        long = ends - starts > n
        h = np.zeros(len(starts), np.uint64)
        h[long] = (textvec.span_hashes(cp, starts[long], starts[long] + n) ^ np.uint64(0xA5A5 * n)) | np.uint64(1)
        found.append(h)
    return starts, ends, of, found


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to] or "") <= CHUNK_CHARS):
            n += len(texts[to] or "")
            to += 1
        yield at, [t or "" for t in texts[at:to]]
        at = to


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score), in order; each score takes part once on average."""
    stack: list[tuple[int, int, float, float]] = []  # first, end, total before, total after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, left, right = i, before, total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            # Segments above k end below every later one that could reach them: they are final for this search.
            if k < 0 or stack[k][3] >= right:
                stack.append((first, i + 1, left, right))
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, r - x) for a, b, x, r in stack]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = np.array(batch.column("_label").to_pylist(), np.int64)
        texts = batch.column("_text").to_pylist()
        hashes, toxic = [], []
        words = [0, 0]
        for at, part in _chunks(texts):
            starts, _, of, units = _units(part)
            for label in (0, 1):
                words[label] += int((labels[at + of] == label).sum())
            for h in units:
                ok = h != 0
                pair = pd.DataFrame({"h": h[ok], "of": of[ok]}).drop_duplicates()
                hashes.append(pair["h"].to_numpy())
                toxic.append(labels[at + pair["of"].to_numpy()])
        h, t = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*toxic, np.zeros(0, np.int64)])
        codes, unique = pd.factorize(h)
        n1 = np.bincount(codes, weights=t, minlength=len(unique)).astype(np.int64)
        n = np.bincount(codes, minlength=len(unique)).astype(np.int64)
        unique = np.append(unique, np.uint64(0)).astype(np.uint64)  # the row of unit 0 counts words
        yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(np.append(n - n1, words[0])), pa.array(np.append(n1, words[1]))], ["unit", "clean", "toxic"])


def _families(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two minimum hashes of each text's shingles of five words."""
    for batch in batches:
        out = [np.zeros(batch.num_rows, np.uint64) for _ in range(2)]
        for at, part in _chunks(batch.column("_text").to_pylist()):
            of, (h,), _ = shingle_sets(part, 5)
            own, first = np.unique(of, return_index=True)
            for k in range(2):
                if len(h):
                    out[k][at + own] = np.minimum.reduceat(mix64(h ^ np.uint64(0x9E37 + k)), first)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f.view(np.int64)) for f in out)], [*batch.schema.names, "_f0", "_f1"])


class Scanner:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(model.units >> np.uint64(42)).astype(np.int64)] = True

    def word_scores(self, units: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(units[0]), np.nan)
        for h in units:
            at = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)] & np.isnan(out))
            if len(at) and len(self.model.units):
                place = np.minimum(np.searchsorted(self.model.units, h[at]), len(self.model.units) - 1)
                hit = self.model.units[place] == h[at]
                out[at[hit]] = self.model.scores[place[hit]]
        return out

    def scan(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float, float]], int]]:
        """Evidence, passages (start and end in code points, score, E-value) and number of words of each text."""
        m = self.model
        for _, part in _chunks(texts):
            starts, ends, of, units = _units(part)
            scores = self.word_scores(units)
            bounds = np.searchsorted(of, np.arange(len(part) + 1))
            begins = np.cumsum([0, *(len(t) + 1 for t in part)])
            positive = np.flatnonzero(scores > 0)
            has = np.searchsorted(positive, bounds)
            for k in range(len(part)):
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                if has[k] == has[k + 1]:
                    yield 0.0, [], hi - lo
                    continue
                own = np.nan_to_num(scores[lo:hi], nan=m.other)
                evidence, passages = 0.0, []
                for a, b, s in maximal_segments(own.tolist()):
                    value = m.k * (hi - lo) * math.exp(-m.lam * s)
                    if value < 1:
                        evidence -= math.log(max(value, 1e-300))
                        passages.append((int(starts[lo + a] - begins[k]), int(ends[lo + b - 1] - begins[k]), s, value))
                yield evidence, passages, hi - lo


def log_tail(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Log of the chance that of a + b draws from n_a + n_b texts, a or more are of the first kind (Fisher's exact test)."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n_a + n_b + 1)))))
    choose = lambda n, k: logs[n] - logs[k] - logs[n - k]
    first = choose(n_a, a) + choose(n_b, b) - choose(n_a + n_b, a + b)
    total, term, at = np.ones(len(a)), np.ones(len(a)), np.arange(len(a))
    x, y = a.astype(float), b.astype(float)
    while len(at):
        term = term * (n_a - x) * y / ((x + 1) * (n_b - y + 1))
        total[at] += term
        more = term > total[at] * 1e-17
        at, term, x, y = at[more], term[more], x[more] + 1, y[more] - 1
    return np.minimum(first + np.log(total), 0.0)


def _lambda(scores: np.ndarray, shares: np.ndarray, other: float) -> float:
    def excess(x: float) -> float:
        return float(np.sum(shares * np.exp(np.minimum(x * scores, 700)))) + (1 - shares.sum()) * math.exp(x * other) - 1

    lo, hi = 1e-3, 1.0
    while excess(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return lo


def _platt(x: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> tuple[float, float]:
    """Slope and intercept of a logistic curve; y smoothed, classes weighted to their shares of all labels."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, shares[1] / n1, shares[0] / n0) * len(y)
    scale = max(1.0, float(x.max()))
    z = np.column_stack((x / scale, np.ones(len(x))))
    beta = np.array([1.0, -1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (target - p)) - 1e-3 * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]) / scale, 0.0), min(float(beta[1]), -1e-6)  # without evidence a text is never predicted to be toxic


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, train: Column | None = None) -> Model | None:
    """Learn from the labelled rows that ``train`` selects; None where a label has no rows."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    known = known.where(~held_out("_id") if train is None else train).groupBy("_id").agg(F.max("_label").alias("_label"))
    shares = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}  # two rows
    if len(shares) < 2:
        return None
    order = F.xxhash64(F.col("_id").cast("string")), F.col("_id")
    picked = known.where("_label = 1").orderBy(*order).limit(sample).unionByName(known.where("_label = 0").orderBy(*order).limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    texts = rows.join(F.broadcast(picked), "_id").select("_label", "_text")  # 2 * sample ids are broadcast at most
    texts = texts.mapInArrow(_families, "_label int, _text string, _f0 long, _f1 long")
    for family in ("_f0", "_f1"):
        one = F.min_by(F.struct("_label", "_text", "_f1"), F.struct(F.xxhash64("_text"), "_label"))
        texts = texts.groupBy(family).agg(one.alias("_one")).select("_one.*")
    texts = cut(texts.select("_label", "_text"))
    counts = texts.mapInArrow(_count, "unit long, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["_label"]: r["count"] for r in texts.groupBy("_label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return None
    prior = PRIOR * (F.col("clean") + F.col("toxic")) / (n0 + n1)
    odds = lambda y, n: F.log((y + prior) / (n + PRIOR - y - prior))
    delta = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    wide = counts.where("unit != 0").withColumn("delta", delta).withColumn("z", z).where(F.abs("delta") >= LEAST_ODDS).select("unit", "clean", "toxic", "delta", "z")
    level = math.log(math.erfc(LEAST_Z / math.sqrt(2)) / 2)

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, toxic, delta = (np.asarray(batch.column(c)) for c in ("clean", "toxic", "delta"))
            chance = np.where(delta > 0, log_tail(toxic, clean, n1, n0), log_tail(clean, toxic, n0, n1))
            expected = (clean + toxic) * min(n0, n1) / (n0 + n1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], [*batch.schema.names, "chance"]).filter(pa.array((chance <= level) | (expected >= LEAST_EXPECTED) & (np.abs(np.asarray(batch.column("z"))) >= LEAST_Z)))

    listed = wide.mapInArrow(test, "unit long, clean long, toxic long, delta double, z double, chance double")
    found = listed.orderBy("chance", "unit").limit(LISTED).select("unit", "clean", "delta").toPandas()
    words = counts.where("unit = 0").select("clean").first()["clean"]
    units = found["unit"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(units)
    units, scores = units[at], found["delta"].to_numpy(float)[at]
    shares_of = np.minimum((found["clean"].to_numpy(float)[at] + 0.5) / max(words, 1), 0.5 / max(len(units), 1))
    other = math.log(1 - PASSAGE)
    lam = _lambda(scores, shares_of, other)
    draft = Model(units, scores, other, lam, 1.0, 0.0, 0.0)
    scanned = evidence(texts, draft, "_text")
    weights = F.aggregate("_passages", F.lit(0), lambda a, p: a + F.when(p["score"] * lam >= 1, 1).otherwise(0))
    seen = scanned.where("_label = 0").agg(F.sum(weights).alias("n"), F.sum("_words").alias("m")).first()
    k = min(1.0, math.e * ((seen["n"] or 0) + 0.5) / max(seen["m"] or 0, 1))
    draft = Model(units, scores, other, lam, k, 0.0, 0.0)
    points = evidence(texts, draft, "_text").select("_label", "_evidence").toPandas()  # 2 * sample rows at most
    total = shares[0] + shares[1]
    slope, intercept = _platt(points["_evidence"].to_numpy(float), points["_label"].to_numpy(int), (shares[0] / total, shares[1] / total))
    return Model(units, scores, other, lam, k, slope, intercept)


def evidence(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """Adds _evidence, _passages and _words to each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LISTED units
    place = docs.columns.index(text_col)
    fields = [StructField("_evidence", DoubleType()), StructField("_passages", kind(PASSAGES)), StructField("_words", kind("long"))]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            out = list(scanner.scan(batch.column(place).to_pylist()))
            passages = [[{"start": a, "end": b, "score": s, "evalue": v} for a, b, s, v in x[1]] for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.float64()), pa.array(passages, arrow), pa.array([x[2] for x in out], pa.int64())], [*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(_row struct, score double, predicted int, passages array): each input row with its score and toxic passages."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("string").alias("_text"))
    if model is None:
        return rows.select("_row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(PASSAGES).alias("passages"))
    value = 1 / (1 + F.exp(-(F.col("_evidence") * model.slope + model.intercept)))
    return evidence(rows, model, "_text").select("_row", value.alias("score"), F.when(value >= 0.5, 1).otherwise(0).alias("predicted"), F.col("_passages").alias("passages"))
