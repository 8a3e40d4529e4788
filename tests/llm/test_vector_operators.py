"""Operators on vectors against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvspark.llm import ann, nn_descent
from kvspark.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.standard_normal(d) * (1 + 5 * (i % 17 == 0))
        out.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 4))))
    for i in range(n, n + 120):  # clusters of near copies, among them exact ones
        base = out[(i * 7) % 3]
        noise = rng.standard_normal(d) * (0.0 if i % 5 == 0 else 0.04)
        out.append((i, (np.array(base[1]) + noise).astype(np.float32).tolist(), base[2] if i % 11 else None))
    out += [(900, None, 1), (901, [0.0] * d, 1), (902, [math.nan] * d, 1), (903, [math.inf] + [0.0] * (d - 1), 1), (904, [None] * d, 1), (905, [1.0] * (d + 1), 1), (906, [], 1)]
    return out


def good(rows, d=16):
    return {i: (np.array(v, float), y) for i, v, y in rows if v and len(v) == d and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}


def test_near_duplicates(spark):
    rows = vectors()
    ok = {i: (v / np.linalg.norm(v), y) for i, (v, y) in good(rows).items() if y is not None}
    links = {i: {j for j in ok if j != i and ok[j][1] == ok[i][1] and ok[i][0] @ ok[j][0] >= 0.98} for i in ok}
    root = {}
    for i in sorted(r[0] for r in rows):
        todo = [i] if i not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links.get(x, ())
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"_id": F.lit(3), "node": F.lit(4), "component": F.lit(1)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.near_duplicates(frame, block=32).collect()}
    assert got == {i: (len(links.get(i, ())), root[i], root[i] == i) for i, *_ in rows}
    assert max(len(x) for x in links.values()) > 2 * nn_descent.LIST  # some lists were saturated


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def exact(x, threshold=0.98):
    """(n_links, component) of each row of unit vectors under one label."""
    s = (x @ x.T >= threshold) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    while True:
        after = np.minimum(root, np.where(s, root[None, :], len(x)).min(axis=1))
        if (after == root).all():
            return s.sum(axis=1).tolist(), root.tolist()
        root = after


def linked(spark, x, **options):
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(frame, **options).collect()}
    return [got[i][0] for i in range(len(x))], [got[i][1] for i in range(len(x))]


def test_near_duplicates_dense_groups(spark):
    """Two groups whose members all have more than ENLARGED nearer copies in their own group than in the other."""
    rng = np.random.default_rng(1)
    far = np.zeros(64)
    far[0] = 0.197
    base = unit_rows(rng.standard_normal((1, 64)))
    base[0, 0] = 0
    x = np.concatenate([unit_rows(unit_rows(base) + 0.004 * rng.standard_normal((400, 64)) + k * far) for k in range(2)]).astype(np.float32)
    u = unit_rows(x.astype(float))
    counts, roots = exact(u)
    across = u[:400] @ u[400:].T
    assert (across >= 0.98).any() and np.sort(u[:400] @ u[:400].T, axis=1)[:, -65].min() > across.max() and set(roots) == {0}
    assert linked(spark, x) == (counts, roots)


def crowd(n, pairs, group):
    """n vectors with a mean cosine of 0.8, near copies of the first ones and of the last one."""
    rng = np.random.default_rng(2)
    x = unit_rows(unit_rows(rng.standard_normal((n, 64))) + 2 * unit_rows(rng.standard_normal((1, 64))))
    copies = [x[:pairs] + 0.018 * rng.standard_normal((pairs, 64)), x[-1:] + 0.008 * rng.standard_normal((group, 64))]
    return unit_rows(np.concatenate([x, *copies])).astype(np.float32)


def test_near_duplicates_pairs_beside_large_group(spark):
    x = crowd(1500, 150, 700)
    assert linked(spark, x, block=32) == exact(unit_rows(x.astype(float)))


def test_near_duplicates_pairs_in_crowded_cells(spark):
    x = crowd(2000, 400, 0)
    assert linked(spark, x, block=16) == exact(unit_rows(x.astype(float)))


def test_near_duplicates_in_double_precision(spark):
    """Vectors of doubles that are the same as floats, on both sides of the threshold."""
    tilt = [math.sqrt(1 / 0.98**2 - 1) * f for f in (1 - 1e-8, 1 + 1e-8)]
    rows = [(0, [1.0, 0.0, 0.0], 0), (1, [1.0, tilt[0], 0.0], 0), (2, [1.0, 0.0, tilt[1]], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2)}


def test_near_duplicates_edge_cases(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = nn_descent.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1e30, 1e29], 1), (4, [1e30, 1e28], 1)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in got) == [(-1, 0, None, True), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (4, 2, 2, False)]


def plain_search(rows, step, k):
    ok = {i: v for i, (v, _) in good(rows).items()}
    return {q: sorted(((-(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k] for q in ok if q % step == 0}


def test_search_recall(spark):
    rows = vectors(n=3000)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1))
    got = ann.search(frame, F.col("vec_id") % 20 == 0, sample=256, cell=64).collect()
    expected, hits = plain_search(rows, 20, 20), 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: v for i, (v, _) in good(rows).items()}
    assert set(by) == set(expected)
    for q, found in by.items():
        found.sort()
        assert [x for x, *_ in found] == list(range(1, 21))
        assert all(math.isclose(s, float((ok[q] * ok[i]).sum()), rel_tol=1e-12, abs_tol=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in expected[q]})
    assert hits / (20 * len(expected)) >= 0.9


def test_search_share_falls(spark):
    """Recall of 0.9 and more without an exact pass, at 10,000 rows and at 50,000, with a smaller share of rows compared."""
    rng, share = np.random.default_rng(3), []
    for n in (10_000, 50_000):
        x = unit_rows(rng.standard_normal((n, 24))).astype(np.float32)
        frame = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 24).cast(pa.list_(pa.float32()))}))
        got = ann.search(frame, F.col("vec_id") % 500 == 0).select("query_id", "vec_id", "n_scored").toArrow()
        u = x.astype(float)
        found, expected = set(zip(got["query_id"].to_pylist(), got["vec_id"].to_pylist(), strict=True)), set()
        for q in range(0, n, 500):
            s = u @ u[q]
            s[q] = -9
            expected |= {(q, int(i)) for i in np.lexsort((np.arange(n), -s))[:20]}
        assert len(found & expected) >= 0.9 * len(expected)
        share.append(np.mean(got["n_scored"].to_numpy()) / n)
    assert share[1] < 0.8 * share[0], share


def test_perturbed_order():
    """The buckets come in the order of their chances, as if all were listed."""
    rng = np.random.default_rng(5)
    place, steps = rng.uniform(-2, 2, 3), np.arange(-ann.REACH, ann.REACH + 1)
    gap = (np.floor(place)[:, None] + steps - place[:, None]) * 2.5
    chance = ann.normal_cdf(gap + 2.5) - ann.normal_cdf(gap)
    every = sorted(((chance[0, a] * chance[1, b] * chance[2, c], (a, b, c)) for a in range(7) for b in range(7) for c in range(7)), reverse=True)
    for need in (0.3, 0.9, 0.999):
        got = ann.perturbed(place, 2.5, 1.0, need)
        m = len(got)
        assert sum(x for x, _ in every[:m]) >= need > sum(x for x, _ in every[: m - 1])
        assert {tuple(r) for r in got.tolist()} == {tuple((np.floor(place) + steps[list(at)]).astype(int).tolist()) for _, at in every[:m]}


def test_search_bands_and_ties(spark):
    """Norms over many powers of two, one vector a third of all rows, clashing columns, double vectors."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 8)) * np.exp2(rng.integers(-6, 7, 900))[:, None]
    x[::3] = x[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({"_id": F.lit(1), "_cell": F.lit(2), "rank": F.lit(3)})
    got, hits = ann.search(frame, F.col("vec_id") % 20 == 0, cell=64, fill=20).collect(), 0
    expected = {q: np.lexsort((np.arange(900), -np.where(np.arange(900) == q, -np.inf, x @ x[q])))[:20].tolist() for q in range(0, 900, 20)}
    by = {q: [] for q in expected}
    for r in got:
        by[r["query_id"]].append(r["vec_id"])
    hits = sum(len(set(by[q]) & set(expected[q])) for q in expected)
    assert hits >= 0.9 * 20 * len(expected) and all(len(v) == 20 for v in by.values())


def test_search_small(spark):
    rows = [(0, [1.0, 0.0], 0), (20, [0.5, 0.5], 0), (3, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 2, 0.5), (20, 3, 3, 0.5)]
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize(("seed", "small"), [(0, 20_000), (1, 0)])
def test_components(spark, seed, small):
    random.seed(seed)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
