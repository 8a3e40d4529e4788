"""Operators on texts against brute force on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvspark.llm import bpe, jaccard, license_scan, line_dedup, mixing, sharding, suffix_dedup, textvec, toxicity
from kvspark.llm.queries import rank_file

WHITE = " \t\n\v\f\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(seed=1, n=60):
    random.seed(seed)
    words = ["alpha", "beta", "Gamma", "delta's", "naïve", "ünder", "don't", "x1", "12", "漢字", "😀", "we'll", "...", "　", "\x85", "\x1c"]
    texts = [None, "", " ", "\n", "one", "one two", "Same line here\nSame line here", "a" * 300 + "\n" + "a" * 300]
    for _ in range(n):
        lines = [" ".join(random.choices(words, k=random.randint(0, 25))) for _ in range(random.randint(1, 6))]
        lines += random.choices(["A shared line of text ", "a SHARED line of text", "short", "\tTabbed shared line\r"], k=random.randint(0, 3))
        random.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [texts[10], texts[11], texts[11] + " tail"]
    rows = [(i, t, random.choice(["en", "de", None]), random.choice(["a", "b", "c", "c", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[12], (None, "A shared line of text", None, None, 3)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"_id": F.lit(1), "_row": F.lit("x"), "_text": F.lit("y"), "size": F.lit(2), "kept": F.lit("z"), "h": F.lit(0)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- tokens ---


def plain_pattern():
    import regex

    w = "".join(f"\\u{c:04x}" for c in textvec.WHITE_SPACE)
    _, pattern = rank_file()
    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{w}\\p{{L}}\\p{{N}}]").replace(r"\s+(?!\S)", f"[{w}]+(?![^{w}])").replace(r"\s+", f"[{w}]+"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t'sremdlvaBé1²!　\x1c漢😀\x85_")), max_size=40), max_size=6))
def test_pretokens(texts):
    _, starts, ends, of, joined = textvec.pretokens(texts)
    got = [[] for _ in texts]
    for a, b, k in zip(starts, ends, of, strict=True):
        got[k].append(joined[a:b])
    assert got == [plain_pattern().findall(t) for t in texts]


def mirrored(n=10):
    """Two words of 2**n letters that collide in polynomial hashes modulo powers of two."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_span_hashes():
    a, b = mirrored()
    long = "q" * 100_000
    for family in (0, 1, 2):
        cp, starts, ends, _ = textvec.ascii_words([f"{a} {b} {a}", "", f"{long} {long}r {long}"])
        h = textvec.span_hashes(cp, starts, ends, family)
        assert h[0] == h[2] != h[1] and h[3] == h[5] != h[4]
    spans = np.array([0, 3, 3]), np.array([5, 3, 9])  # overlapping and empty ones
    h = textvec.span_hashes(cp, *spans)
    assert h[0] == textvec.span_hashes(cp, np.array([0]), np.array([5]))[0] and h[1] != h[2]


def test_words_that_share_a_hash():
    """Words are told apart by the second hash where the first is the same."""
    codes, words, first = bpe._distinct(np.array([7, 8, 7, 7, 8, 7], np.uint64), np.array([1, 1, 2, 1, 1, 2], np.uint64))
    assert codes.tolist() == [0, 1, 2, 0, 1, 2] and words.tolist() == [7, 8, 7] and first.tolist() == [0, 1, 2]


def test_mirrored_words(spark):
    import base64

    import tiktoken

    a, b = mirrored()
    docs = spark.createDataFrame([(0, a), (1, b), (2, f"{a} {b}")], "doc_id long, text string")
    ranks, pattern = rank_file()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(x): int(y) for x, y in map(bytes.split, ranks.splitlines())}, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, ranks, pattern).collect()}
    assert got == {i: plain.encode_ordinary(t) for i, t in enumerate((a, b, f"{a} {b}"))}
    assert {r["_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 3, 90).collect()} == {0: 0, 1: 1, 2: 2}


def test_bpe_like_tiktoken(spark, docs, rows):
    import base64

    import tiktoken

    ranks, pattern = rank_file()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    out = bpe.decode(bpe.encode(docs, ranks, pattern), ranks).collect()
    expected = Counter((i, tuple(plain.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == expected
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in out) == Counter((i, (t or "").encode()) for i, t, *_ in rows)
    fused = bpe.digests(bpe.encode(docs, ranks, pattern, decoded=True)).collect()
    assert Counter((r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in fused) == Counter((sha(",".join(map(str, e := plain.encode_ordinary(t or "")))), sha(t or ""), len(e)) for _, t, *_ in rows)
    assert bpe.encode(empty(spark), ranks, pattern).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(docs, ranks, r"\w+")


def test_bpe_blocks(spark, docs, rows, monkeypatch):
    """Many small blocks give the same ids."""
    ranks, pattern = rank_file()
    one = {(r["doc_id"], tuple(r["ids"])) for r in bpe.encode(docs, ranks, pattern).collect()}
    raw = [tuple(b.close()[0:1]) for b in bpe._blocks(docs.select("doc_id", "text").toArrow().to_batches(max_chunksize=3))]
    assert raw
    many = {(r["doc_id"], tuple(r["ids"])) for r in bpe.encode(docs.repartition(7), ranks, pattern).collect()}
    assert one == many


# --- lines ---


def plain_lines(rows, least=10):
    key = lambda line: line.strip(WHITE).encode().lower().decode()
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i if i is not None else 2**63 - 1)
    out = []
    for i, t, *_ in rows:
        own = (t or "").split("\n")
        me = i if i is not None else 2**63 - 1
        kept = [x for x in own if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == me]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("bits", [20, 25])
def test_line_dedup(spark, docs, rows, bits):
    done = line_dedup.line_dedup(docs, filter_bits=bits).select("_row.doc_id", "n_lines", "n_dropped", "kept", "_row._row").collect()
    assert Counter(tuple(r)[:4] for r in done) == plain_lines(rows) and {r["_row"] for r in done} == {"x"}
    assert line_dedup.line_dedup(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        line_dedup.line_dedup(docs, filter_bits=4).collect()


def test_heavy_lines_and_last_ids(spark):
    """A line of every document, ids at the end of their range, null ids that hold a line alone or with others."""
    rows = [(i, "A line that all documents hold\n" + f"own line {i} of its document\n" + "x" * 20_000, None, None, 0) for i in range(3000)]
    rows += [(2**63 - 1, "only two hold this line", None, None, 0), (None, "only two hold this line", None, None, 0), (None, "a line of null ids", None, None, 0), (None, "a line of null ids", None, None, 0)]

    def plain(own):
        return [r if r[0] is not None else (2**64, *r[1:]) for r in own]

    expected = Counter((None if i == 2**64 else i, *x) for i, *x in plain_lines(plain(rows)).elements())
    done = line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).select("_row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert Counter(map(tuple, done)) == expected
    assert line_dedup.bits_for(0) == 20 and line_dedup.bits_for(10**6) == 23 and line_dedup.bits_for(10**12) == 30


def test_full_filter_is_still_exact(spark, rows, monkeypatch):
    """More lines than the filter has room for: suspects only."""
    many = [(i, "\n".join(f"line number {random.randint(0, 30000)} of many" for _ in range(400)), None, None, 0) for i in range(60)]
    done = line_dedup.line_dedup(spark.createDataFrame(many, SCHEMA), filter_bits=20).select("_row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert Counter(map(tuple, done)) == plain_lines(many)


# --- Jaccard ---


def plain_components(rows, k, percent):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        own = frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(own)
    ids = sorted(x for x in sets if x is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(x), find(i) if i is not None else None) for i in sets for x in sets[i])


def near_copies(seed, n=40, length=60, families=4):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[random.choice(vocabulary) for _ in range(length)] for _ in range(families)]
    out = []
    for i in range(n):
        words = list(random.choice(bases))
        for _ in range(random.randint(0, 4)):
            at, what = random.randrange(len(words)), random.random()
            words[at : at + 1] = [random.choice(vocabulary)] if what < 0.4 else [] if what < 0.7 else [words[at], f"n{random.randint(0, 9)}"]
        out.append((i, " ".join(words), None, None, 0))
    return out


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 70, 3), (1, 80, 4)])
def test_jaccard(spark, rows, k, percent, seed):
    own = rows + [(1000 + i, *x) for i, *x in near_copies(seed)]
    got = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(own, SCHEMA), k, percent).collect())
    assert got == plain_components(own, k, percent)


def test_jaccard_long_lists(spark, monkeypatch):
    """Lists that are cut into small parts, and texts of very different sizes that share their rarest words."""
    monkeypatch.setattr(jaccard, "LIST_CELL", 2)
    random.seed(12)
    own = []
    for i in range(40):  # three families with a common rare beginning; inside a family some are near, some are not
        words = [f"rare{j}" for j in range(12)] + [f"f{i % 3}w{random.randint(0, 4 + i)}" for _ in range(20 + 5 * (i % 4))]
        own.append((i, " ".join(words), None, None, 0))
    own += [(100 + i, *x) for i, *x in near_copies(5, n=30, length=200)]
    got = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(own, SCHEMA), 1, 60).collect())
    assert got == plain_components(own, 1, 60)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).collect() == []


# --- suffixes ---


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80))
def test_suffix_array(data):
    assert suffix_dedup.suffix_array(data, 200).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def plain_repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if seen[b[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        spans = sum(1 for at in range(len(b)) if gone[at] and (not at or not gone[at - 1]))
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), spans))
    return Counter(out)


def test_segments_know_their_content():
    """Equal hashes for equal bytes only, wherever they stand."""
    random.seed(8)
    base = bytes(random.choice(b"ab") for _ in range(400))
    data = np.frombuffer(base + b"\xff" + b"x" * 37 + base + b"\xff" + base[:200] + b"c" + base[201:] + b"\xff", np.uint8)
    _, s, first, windows, _ = suffix_dedup.anchors(data, 100)
    seen = {}
    for h, a, n in zip(s.tolist(), first.tolist(), windows.tolist(), strict=True):
        assert seen.setdefault(h, data[a : a + n + 99].tobytes()) == data[a : a + n + 99].tobytes()
    assert len(seen) < len(s)


@pytest.mark.parametrize("group", [2048, 3])
def test_suffix_dedup(spark, rows, group):
    random.seed(9)
    passage = "".join(random.choice("abcdefgh éü") for _ in range(200))
    more = [(2000 + i, "".join(random.choice("abc ") for _ in range(random.randint(0, 300))) + passage[random.randint(0, 30) : random.randint(120, 200)] + random.choice("xyz") * random.randint(0, 130), None, None, 0) for i in range(30)]
    own = rows + more
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(own, SCHEMA).withColumn("kept", F.lit(1)), length=60, group=group)
    assert Counter((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()) == plain_repeats(own, 60)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.suffix_dedup(empty(spark)).collect() == []


# --- mixing ---


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    keys = sorted(sizes, key=lambda s: (s is None, s))
    weight = {k: weights[i % 3] for i, k in enumerate(keys)}
    total, target, free = sum(sizes.values()), {}, set(keys)
    left = total
    while free:
        level = left / sum(weight[k] for k in free)
        full = [k for k in free if weight[k] * level >= most * sizes[k]]
        if not full:
            target |= {k: weight[k] * level for k in free}
            break
        for k in full:
            target[k] = most * sizes[k]
            left -= target[k]
            free.remove(k)
    return target


def test_mixing(spark, docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    targets = plain_targets(sizes)
    first = sorted(tuple(r) for r in mixing.mix(docs).na.fill({"source": "~", "doc_id": -1}).collect())
    again = sorted(tuple(r) for r in mixing.mix(docs.repartition(5)).na.fill({"source": "~", "doc_id": -1}).collect())
    assert first == again and len(first) == len(rows)
    taken = Counter()
    for i, source, n, whole, target, got in first:
        source = None if source == "~" else source
        assert whole == sizes[source] and math.isclose(target, targets[source], rel_tol=1e-9) and 0 <= got <= 3 * n
        taken[source] += got
    assert all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] + 5 for s in sizes)
    assert mixing.mix(empty(spark)).collect() == []


def test_mixing_small_sources_beside_large(spark):
    """Sources below a slot's size, or little above it, reach their targets; the large ones make slots of 152 words."""
    sizes = {"a": 5_000_000, "b": 5_000_000, "c": 40, "d": 100, "e": 160, "f": 1}
    texts = spark.createDataFrame([(k, n // max(1, n // 5000) if n > 5000 else 1, max(1, n // 5000) if n > 5000 else n) for k, n in sizes.items()], "source string, words int, copies int")
    docs = texts.withColumn("i", F.explode(F.sequence(F.lit(1), "copies"))).select(F.concat("source", F.col("i").cast("string")).alias("doc_id"), F.expr("trim(repeat('w ', words))").alias("text"), "source")
    got = {r["source"]: (r["n"], r["target"], r["taken"]) for r in mixing.mix(docs).groupBy("source").agg(F.sum("size").alias("n"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    targets = plain_targets(sizes)
    assert {k: x[0] for k, x in got.items()} == sizes
    assert all(math.isclose(got[k][1], t, rel_tol=1e-9) and abs(got[k][2] - t) <= 0.5 for k, t in targets.items()), (got, targets)


def test_mixing_sizes(spark):
    """Sources from 1 word up beside a large one: all within half a word of their targets, whatever the others' size."""
    sizes = {"a": 3_000_000, "b": 40, "c": 300, "d": 1000, "e": 1, None: 7}
    texts = spark.createDataFrame([(k, 3000 if n > 3000 else 1, max(1, n // 3000) if n > 3000 else n) for k, n in sizes.items()], "source string, words int, copies int")
    docs = texts.withColumn("i", F.explode(F.sequence(F.lit(1), "copies"))).select(F.concat(F.coalesce("source", F.lit("~")), F.col("i").cast("string")).alias("doc_id"), F.expr("trim(repeat('w ', words))").alias("text"), "source")
    mixed = mixing.mix(docs, places=True)
    got = {r["source"]: (r["n"], r["taken"], r["places"]) for r in mixed.groupBy("source").agg(F.sum("size").alias("n"), F.sum("taken").alias("taken"), F.count("first_slot").alias("places")).collect()}
    targets = plain_targets(sizes)
    assert all(got[k][0] == n and abs(got[k][1] - targets[k]) <= 0.5 and got[k][2] for k, n in sizes.items()), (got, targets)
    # The mix takes up every source evenly: of the large one's documents a share by the middle of the slots that is near one half.
    slots = [r["first_slot"] for r in mixed.where("source = 'a' and taken > 0").collect()]
    assert abs(sum(s < max(slots) / 2 for s in slots) / len(slots) - 0.5) < 0.02


def test_mixing_schedule(spark):
    """Slots follow one another in each source and reach its target, also where no point falls into the source."""
    aims = {"0a": 700.0, "0b": 299.6, "0c": 0.8, "1": 0.0}
    rows = mixing.schedule(spark.createDataFrame([(k, 1000, t) for k, t in aims.items()], "_key string, source_size long, target double"), 50).collect()
    for k, t in aims.items():
        own = sorted((r["slot"], r["first"], r["end"]) for r in rows if r["_key"] == k)
        assert [x[1] for x in own[1:]] == [x[2] for x in own[:-1]] and (not own or own[0][1] == 0)
        assert (own[-1][2] if own else 0) == round(t) and all(0 <= s < 50 for s, *_ in own)


def test_targets_cap_and_share(spark):
    for sizes in ({"a": 1000, "b": 1, "c": 2}, {"a": 5, "b": 0, None: 100}, {"x": 7}):
        key = lambda s: "1" if s is None else "0" + s
        frame = spark.createDataFrame([(key(s), n) for s, n in sizes.items()], "_key string, source_size long")
        got = {r["_key"]: r["target"] for r in mixing.targets(frame).collect()}
        assert all(math.isclose(got[key(s)], t, rel_tol=1e-9, abs_tol=1e-9) for s, t in plain_targets(sizes).items())


# --- toxicity ---


def plain_segments(s, lo=0, hi=None):
    hi = len(s) if hi is None else hi
    best, place = 0, None
    for i in range(lo, hi):
        total = 0
        for j in range(i, hi):
            total += s[j]
            if total > best + 1e-12:
                best, place = total, (i, j + 1)
    return plain_segments(s, lo, place[0]) + [place] + plain_segments(s, place[1], hi) if place else []


def test_maximal_segments():
    random.seed(3)
    for _ in range(300):
        s = [random.choice([-3.1, -1.7, -0.9, 0.45, 1.13, 2.57]) + random.random() * 1e-3 for _ in range(random.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == plain_segments(s)


def test_toxicity_counts_and_evidence():
    """Counting, scores of words, E-values and their sum against plain loops."""
    import pyarrow as pa

    texts, labels = ["Alphabet alphabet beta", "betting Gammas", "", "alphabets éclair x"], [1, 0, 1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(texts)], ["_label", "_text"])
    (out,) = toxicity._count([batch])
    words = [re.findall(r"[^\W\d_]+", t.lower()) for t in texts]
    plain = {0: defaultdict(int), 1: defaultdict(int)}
    for own, y in zip(words, labels, strict=True):
        for unit in {(len(w), w) for w in own} | {(n, w[:n] + "*") for w in own for n in toxicity.PREFIXES if len(w) > n}:
            plain[y][unit] += 1
    got = sorted(zip(out.column("clean").to_pylist()[:-1], out.column("toxic").to_pylist()[:-1], strict=True))
    assert got == sorted((plain[0][u], plain[1][u]) for u in set(plain[0]) | set(plain[1]))
    assert (out.column("clean")[-1].as_py(), out.column("toxic")[-1].as_py()) == (2, 6)

    def hashed(word, n=None):
        cp = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        h = textvec.span_hashes(cp, np.array([0]), np.array([n or len(word)]))[0]
        return int(h ^ np.uint64(0xA5A5 * n) if n else h) | 1

    listed = {hashed("vile"): 3.0, hashed("nastyish", 5): 2.0, hashed("calm"): -1.5}
    units = np.array(sorted(listed), np.uint64)
    model = toxicity.Model(units, np.array([listed[int(u)] for u in units]), -0.2, 0.9, 0.05, 1.0, 0.0)
    random.seed(6)
    texts = [" ".join(random.choices(["vile", "nastyness", "nasty", "calm", "word", "other"], k=random.randint(0, 30))) for _ in range(40)]
    for text, (evidence, passages, n) in zip(texts, toxicity.Scanner(model).scan(texts), strict=True):
        scores = [{"vile": 3.0, "nastyness": 2.0, "calm": -1.5}.get(w, -0.2) for w in text.split()]
        expected = 0.0
        for a, b in plain_segments(scores):
            value = 0.05 * len(scores) * math.exp(-0.9 * sum(scores[a:b]))
            expected += -math.log(value) if value < 1 else 0
        assert n == len(scores) and math.isclose(evidence, expected, rel_tol=1e-9, abs_tol=1e-9)
        assert all(p[3] < 1 for p in passages)


def test_toxicity(spark):
    random.seed(7)
    common = ["".join(random.choices("abcdefgh", k=5)) for _ in range(200)]
    bad = ["vile" + x for x in ("a", "en", "ish", "or", "us", "ing", "ed")] + ["nasty"]
    texts = []
    for i in range(600):
        words = random.choices(common, k=random.randint(5, 80))
        if i % 5 == 0:
            for _ in range(max(2, len(words) // 12)):
                words.insert(random.randrange(len(words)), random.choice(bad))
        texts.append((i, " ".join(words), int(i % 5 == 0)))
    texts += [(1000, None, 1), (1001, "", 0), (1002, "夜" * 50, 0)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").withColumn("_text", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).select("_row.doc_id", "score", "predicted", "passages").collect()}
    held = [(i, y) for i, t, y in texts if zlib.crc32(str(i).encode()) % 5 == 0 and t]
    assert sum(found[i]["predicted"] == y for i, y in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values()) and len(found) == len(texts)
    assert found[1000]["predicted"] == found[1001]["predicted"] == 0
    text = dict((i, t) for i, t, _ in texts)
    p = next(r for r in found.values() if r["passages"])
    assert all(any(b in text[p["doc_id"]][q["start"] : q["end"]] for b in ("vile", "nasty")) for q in p["passages"])
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items())
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and {r["predicted"] for r in toxicity.score(docs, None).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_log_tail():
    for n_a, n_b in ((10, 58), (40, 7)):
        for a in range(0, 6):
            for b in range(0, 6):
                chance = sum(math.comb(n_a, k) * math.comb(n_b, a + b - k) for k in range(a, a + b + 1)) / math.comb(n_a + n_b, a + b)
                assert math.isclose(toxicity.log_tail(np.array([a]), np.array([b]), n_a, n_b)[0], math.log(chance), rel_tol=1e-9, abs_tol=1e-9)


def test_toxicity_odd_rows(spark):
    """Null ids, very long texts, repeated rows and clashing names."""
    docs = spark.createDataFrame([(None, "some words"), (1, "vile " * 30_000), (1, "vile " * 30_000), (2, None)], "doc_id long, text string").withColumns({"_row": F.lit(1), "score": F.lit(2), "_evidence": F.lit(3), "_words": F.lit(4)})
    model = toxicity.Model(np.array([5], np.uint64), np.array([3.0]), -0.2, 1.0, 0.1, 1.0, -1.0)
    got = toxicity.score(docs, model).select("_row.doc_id", "_row._evidence", "score", "predicted").collect()
    assert len(got) == 4 and {r["_evidence"] for r in got} == {3} and {r["predicted"] for r in got} == {0}


def test_toxicity_rare_label(spark):
    """Words that no clean text has, each in about a third of few toxic texts."""
    random.seed(11)
    common = ["".join(random.choices("abcdefgh", k=5)) for _ in range(200)]
    bad = ["".join(random.choices("mnopqrst", k=7)) for _ in range(10)]
    texts = []
    for i in range(2000):
        words = random.choices(common, k=random.randint(10, 40))
        for x in random.sample(bad, 3) if i % 33 == 0 else ():
            words.insert(random.randrange(len(words)), x)
        texts.append((i, " ".join(words), int(i % 33 == 0)))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).select("_row.doc_id", "predicted").collect()}
    assert sum(found[i] for i, _, y in texts if y) >= 0.95 * sum(y for *_, y in texts)
    assert sum(found[i] for i, _, y in texts if not y) <= 2


# --- licences ---

MIT = "\n".join(s for name, s in license_scan.SENTENCES if name in ("MIT-grant", "MIT-notice", "AS-IS", "MIT-liability"))
BSD = [s for name, s in license_scan.SENTENCES if name in ("BSD-grant", "BSD-source", "BSD-binary")]


def wrap(text, width, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text.replace("\n", " "), width))


def test_licenses(spark):
    cases = {
        0: (None, []), 1: ("", []), 2: ("Nothing to see. Permission denied.", []), 3: ("Text.\nReleased under the MIT License.\nMore text", ["MIT"]),
        4: ("Copyright (c) 2020 Someone\n\n" + MIT, ["MIT"]), 5: ("A header\n" + wrap(MIT, 50), ["MIT"]),
        6: ("Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
        7: ("released UNDER the mit license!", ["MIT"]), 8: ("Unreleased under the MIT License.", []), 9: ("x " * 50000 + ".\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        10: ("\n".join(BSD), ["BSD-2-Clause"]), 11: ("// SPDX-License-Identifier: Apache-2.0 OR MIT\ncode", ["Apache-2.0 OR MIT"]),
        12: ("\n".join([*BSD, "3. Neither the name of Some Holder, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]), ["BSD-3-Clause"]),
        13: ("This is free and unencumbered software released into the public\n  domain.", ["Unlicense"]), 14: (wrap(MIT, 60, " * "), ["MIT"]), 15: ("MIT License and more words that follow", []),
    }
    rows = [(i, t) for i, (t, _) in cases.items()] + [(None, cases[3][0]), (3, cases[3][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit("x"))
    got = license_scan.scan(docs).collect()
    assert len(got) == len(rows) and all(r["licenses"] == (cases[r["doc_id"]][1] if r["doc_id"] is not None else ["MIT"]) for r in got)
    assert license_scan.scan(docs.limit(0)).collect() == []
    assert all(any(t in s.lower().encode() for t in license_scan.TRIGGERS) for _, s in license_scan.SENTENCES)


@pytest.mark.parametrize("width", [20, 30, 36, 38, 40, 52, 64, 80])
def test_licenses_wrapped(width):
    assert license_scan.licenses(license_scan.identifiers("Title\n" + wrap(MIT, width))) == ["MIT"]
    for name, rule in [*license_scan.BODIES, *license_scan.RULES]:
        own = [next(s for n, s in license_scan.SENTENCES if n == x).replace("<name>", "the holder") for x in rule]
        assert license_scan.licenses(license_scan.identifiers("\n\n".join(wrap(s, width) for s in own))) == [name]


@pytest.mark.parametrize(("file", "name"), [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")])
def test_license_bodies(file, name):
    """The texts that many systems ship, where this one has them."""
    from pathlib import Path

    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no licence texts here")
    found = license_scan.licenses(license_scan.identifiers(path.read_text()))
    assert found and found[0] == name


def plain_identifiers(text):
    """Every known sentence tried at every place where a piece starts."""
    low = text.lower()
    words = [(m.start(), m.group()) for m in re.finditer("[a-z0-9]+", low)]
    ends = [0] + [m.end() for m in re.finditer(r"\n|[.!?:;)][\"'\u201d]*\s", low)]
    first = {next((k for k, (a, _) in enumerate(words) if a >= e), len(words)) for e in ends} | {len(words)}
    out, i = [], 0
    while i < len(words):
        best = None
        for name, sentence in license_scan.SENTENCES if i in first else ():
            pattern = "(?: [a-z0-9]+){1,64} ".join(map(license_scan.normalise, sentence.split("<name>")))
            m = re.match(pattern + "(?= |$)", " ".join(w for _, w in words[i : i + 400]))
            if m and i + len(m.group().split()) in first and (best is None or len(m.group().split()) > best[0]):
                best = len(m.group().split()), name
        if best:
            out.append(best[1])
        i += best[0] if best else 1
    return out


def test_licenses_like_brute_force(spark):
    random.seed(4)
    pieces = [s.replace("<name>", "Some Body") for _, s in license_scan.SENTENCES]
    texts = [None, ""]
    for _ in range(60):
        own = [random.choice([random.choice(pieces), "Some other text", "a b c.", random.choice(pieces)[: random.randint(5, 60)], "Copyright (c) 2001 X"]) for _ in range(random.randint(1, 6))]
        texts.append(wrap(random.choice([" ", "\n"]).join(own), random.randint(15, 90)) if random.random() < 0.5 else random.choice([" ", "\n", ") "]).join(own))
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts + [t for t in real if t and re.search("(?i)licens|permi", t)][:40]:
        assert [x for _, _, x in license_scan.identifiers(t or "") if x != "Copyright" and not x.startswith("SPDX:")] == plain_identifiers(t or ""), t


# --- shards ---


def plain_hilbert(axes, bits):
    """Skilling's transform with plain integers."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (2, 1)])
def test_hilbert_curve(spark, n, bits):
    side = 1 << bits
    cells = [tuple(k // side**i % side for i in range(n)) for k in range(side**n)]
    frame = spark.createDataFrame(cells, ", ".join(f"x{i} int" for i in range(n)))
    got = {tuple(r[:n]): r[n] for r in frame.select("*", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("h")).collect()}
    assert got == {c: plain_hilbert(c, bits) for c in cells}
    run = sorted(got, key=got.get)
    assert sorted(got.values()) == list(range(side**n)) and all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(run, run[1:], strict=False))


def test_shards(spark, docs, rows, tmp_path):
    got = sharding.hilbert_shards(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.get(s, 0) for s in range(16)) - min(counts.get(s, 0) for s in range(16)) <= 1
    assert got[0].__fields__ == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"]
    # Many distinct values: codes by a range sort and a join give the same shards.
    assert Counter(map(tuple, sharding.hilbert_shards(docs, few=0).collect())) == Counter(map(tuple, got))
    for s in range(16):
        own = sorted((r["slot"], r["curve"]) for r in got if r["shard"] == s)
        assert [x for x, _ in own] == list(range(len(own))) and [c for _, c in own] == sorted(c for _, c in own)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.hilbert_shards(empty(spark)).collect() == []
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source")
    sharding.write_shards(unique, sharding.hilbert_shards(unique), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == unique.count()
