import hashlib
import math
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvspark.functions.hashing import murmur3_32, murmur3_64_hex, murmur3_x64_64, murmur3_x86_32
from kvspark.operators.sketches import bloom, cms, hll, simhash
from kvspark.plans.catalogue import QUERIES

TOKENS = "apple dog rose car tree river stone cloud bird fish lamp door book pen cup shoe hat ring key coin ship wind".split()


def test_murmur3_golden(spark):
    assert murmur3_x86_32(b"hello") == 0x248BFA47
    assert f"{murmur3_x64_64(b'hello'):016x}" == "cbd8a7b341bd9b02"
    row = spark.createDataFrame([("hello",), (None,)], "x string").select(murmur3_32(F.col("x")).alias("a"), murmur3_64_hex(F.col("x")).alias("b")).collect()
    assert tuple(row[0]) == (0x248BFA47, "cbd8a7b341bd9b02") and tuple(row[1]) == (None, None)


def test_parameters():
    assert [bloom.parameters(n, p) for n, p in ((20, 0.05), (10, 0.1), (1000, 0.01), (2, 0.01))] == [(125, 4), (48, 3), (9586, 7), (20, 7)]
    assert cms.parameters(0.01, 0.01) == (272, 6) and cms.parameters(0.001, 0.01) == (2719, 6)
    for bad in ((0, 0.1), (5, 0), (5, 1)):
        with pytest.raises(ValueError):
            bloom.parameters(*bad)
    with pytest.raises(ValueError):
        cms.parameters(1, 0.5)


def test_bloom_has_no_false_negatives(spark):
    rows = spark.createDataFrame([(f"name{i}",) for i in range(50)] + [(None,)], "x string")
    m, k = bloom.parameters(50, 0.05)
    bits = bloom.build(rows, "x", m, k)
    assert all(r["maybe"] for r in bloom.probe(rows, "x", bits, m, k).collect())
    absent = spark.createDataFrame([(f"other{i}",) for i in range(400)], "x string")
    assert sum(r["maybe"] for r in bloom.probe(absent, "x", bits, m, k).collect()) < 60
    on = {r["bit"] for r in bits.collect()}
    packed = bloom.packed(bits, m)
    assert {i for i in range(m) if packed[i // 8] >> (i % 8) & 1} == on


def test_murmur3_of_many(spark):
    values = [None, "", "é" * 3000, *("abcdefghijklmnopqrstuvwxyz"[: n % 27] + str(n % 5) for n in range(300))]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", murmur3_32(F.col("x"), 3).alias("a"), murmur3_64_hex(F.col("x"), 3).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(None, None) if v is None else (murmur3_x86_32(v.encode(), 3), f"{murmur3_x64_64(v.encode(), 3):016x}") for v in values]


def test_bloom_semi_join(spark):
    left = spark.range(1000).withColumnRenamed("id", "a")
    right = spark.createDataFrame([(i,) for i in range(0, 2000, 37)], "b long")
    assert {r["a"] for r in bloom.semi_join(left, right, "a", "b").collect()} == set(range(0, 1000, 37))
    assert {r["a"] for r in bloom.semi_join(left, right, "a", "b", most_bits=1).collect()} == set(range(0, 1000, 37))
    m, k = bloom.parameters(55, 0.01)
    passed = left.where(bloom.all_on(F.col("a"), bloom.words(right, "b", m, k), m, k)).count()
    assert 28 <= passed < 28 + 60


def test_cms_never_underestimates(spark):
    true = {f"w{i}": i % 7 + 1 for i in range(60)}
    rows = spark.createDataFrame([(w,) for w, n in true.items() for _ in range(n)], "x string")
    m, k = cms.parameters(0.01, 0.01)
    sketch = cms.merge(cms.build(rows, "x", m, k), cms.build(rows, "x", m, k))
    found = {r["x"]: r["estimate"] for r in cms.query(rows, "x", sketch, m, k).collect()}
    assert all(found[w] >= 2 * n for w, n in true.items()) and sum(found.values()) <= 2 * sum(true.values()) * 1.1
    assert cms.query(spark.createDataFrame([("zz",)], "x string"), "x", spark.createDataFrame([], "row int, col long, cnt long"), m, k).first()["estimate"] == 0


@pytest.mark.parametrize("p", [4, 10, 14])
def test_hll_error(spark, p):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("x"))
    got = hll.estimate(hll.registers(rows, "x", p), p).first()["estimate"]
    assert abs(got - 3000) <= 3 * 1.04 / math.sqrt(1 << p) * 3000 + 1


def test_hll_golden_formula(spark):
    """The estimator on 22 tokens with the canonical hash."""
    rows = spark.createDataFrame([(t,) for t in TOKENS], "x string")
    for p in (10, 14):
        assert hll.estimate(hll.registers(rows, "x", p, hashed=murmur3_32(F.col("x"))), p).first()["estimate"] in range(20, 25)
    with pytest.raises(ValueError):
        hll.registers(rows, "x", 3)


def _reference(words: list[str]) -> int:
    bits = [0] * 64
    for w in words:
        h = murmur3_x64_64(w.encode())
        for b in range(64):
            bits[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if bits[b] > 0)


def test_simhash_golden_formula():
    stop = set(simhash.STOP_WORDS)
    assert len(stop) == 190
    for text, expected in (("Hello World from Mars", 0x92B7DD2A1E8FA9DE), ("The quick brown fox jumps over the lazy dog", 0x2074CC9F3D6442C0)):
        assert _reference([w for w in text.upper().split() if w not in stop]) == expected


def test_simhash_texts(spark):
    rows = spark.createDataFrame([(1, "Hello world hello"), (2, "hello WORLD, hello!"), (3, ""), (4, None), (5, "the and of"), (6, "Hello there mars")], "id long, t string")
    found = {r["id"]: (r["hi"], r["lo"]) for r in simhash.fingerprints(rows, "id", "t").collect()}
    assert found[1] == found[2] and found[3] == found[4] == found[5] == (0, 0) and len(found) == 6 and found[6] != found[1]
    assert {r["n_a"] for r in simhash.near(simhash.fingerprints(rows, "id", "t"), 3).collect()} == set()
    with pytest.raises(ValueError):
        simhash.near(rows, 4)


def test_token_counts(spark):
    texts = ["Hello, hello WORLD x1", "the and of", "", None, "ı ſtop İz čaj-naše \ud7ff\U0001f600b", "a" * 5000 + " " + "A" * 5000, "...", "the THE mars\x00moon\nmars"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    upper = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    words = {i: [w for x in re.findall("[A-Za-z0-9]+", t or "") if (w := x.translate(upper)) not in simhash.STOP_WORDS] for i, t in enumerate(texts)}
    found = simhash.token_counts(rows, "id", "t")
    assert {r["id"]: (r["n_tokens"], r["n_distinct"]) for r in found.collect()} == {i: (len(w), len(set(w))) for i, w in words.items() if w}


def test_tokens_are_made_once_from_a_plain_class(spark, tmp_path):
    """The optimizer copied the expression into a filter, and a negated class is matched several times slower."""
    spark.createDataFrame([(1, "Hello world")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["simhash_tokens"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("A-Za-z0-9") == 1 and "[^" not in plan


def _printed(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "_text"])
    return [(r["hi"], r["lo"]) for out in simhash._prints([batch, batch.slice(0, 0), batch], "id") for r in out.to_pylist()]


@pytest.mark.parametrize("piece", [8, 64, 1 << 17])
def test_prints_in_pieces(monkeypatch, piece):
    """Tokens at cuts, tokens longer than a piece, more words than are kept, letters outside ASCII."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "KEPT", piece)
    rng = random.Random(3)
    texts = ["", None, "the", "Hello, hello", "ı ſtop İz čaj-naše \U0001f600b", "x" * 300, "-" * 300, *(" ".join("".join(rng.choices("abcXYZ09č-", k=rng.randint(1, 30))) for _ in range(n)) for n in (1, 5, 40, 900))]
    expected = []
    for t in texts:
        words = [w for x in re.findall("[A-Za-z0-9]+", t or "") if (w := x.upper()) not in simhash.STOP_WORDS]
        sums = [2 * sum(int(hashlib.md5(w.encode()).hexdigest()[:16], 16) >> b & 1 for w in words) > len(words) for b in range(64)]
        both = sum(1 << b for b in range(64) if sums[b])
        expected.append((both >> 32, both & 0xFFFFFFFF))
    assert _printed(texts) == expected * 2


@pytest.mark.parametrize("long", [False, True])
def test_prints_memory_does_not_follow_the_batch(long):
    """Lists of all texts, of all their words and a table of their bits stood in each worker's memory, several times the batch."""

    def peak(n):
        texts = [" ".join(f"{rng.getrandbits(32):x}" for _ in range(500)) for _ in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(texts)])] if long else [pa.array(range(n)), pa.array(texts)], ["id", "_text"])
        del texts
        tracemalloc.start()
        try:
            assert sum(out.num_rows for out in simhash._prints([batch], "id")) == (1 if long else n)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    rng = random.Random(4)
    assert peak(800) < 1.2 * peak(400)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=20), st.integers(0, 31))
def test_near_finds_all_pairs(spark, prints, flip):
    prints = prints + [(h ^ (1 << flip), lo ^ 3) for h, lo in prints[:5]]
    distinct = set(prints)
    expected = sorted((a.bit_count() * 0, x, y) for x in distinct for y in distinct for a in [0] if x < y and (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count() <= 3)
    got = simhash.near(spark.createDataFrame(prints, "hi long, lo long"), 3).collect()
    as_pair = lambda h: (int(h[:8], 16), int(h[8:], 16))
    assert sorted((as_pair(r["a"]), as_pair(r["b"])) for r in got) == [(x, y) for _, x, y in expected]
