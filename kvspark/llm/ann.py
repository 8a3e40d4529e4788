"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Inner products become Euclidean distances of unit vectors: rows are split into bands of norms by powers of
two, scaled by the largest norm of the band, and get one more coordinate that makes them unit vectors;
queries are normalised. A table cuts Gaussian projections into slots of ``width``; a bucket is a vector of
slots. For two points at distance R a projection differs by a normal amount of deviation R, which gives the
chance of each perturbed bucket to hold a neighbour. The number of projections follows the number of rows
(one more for each doubling), so that buckets keep about their size, and there is a table for each two of them.

A query visits a table's perturbed buckets in the order of their chances until those add up to what
``success`` over all tables asks; the order is built projection by projection, so no list of buckets is
needed. R is the distance of the k-th neighbour: seen in a bounded sample (``sample`` rows, the first by a
hash of their id), and where there are more rows, extended by the normal tail of the query's scores. The
sample only gives R and a proven lower bound of the k-th best score; its rows are found like all others. A
band that cannot reach the bound is skipped, exactly. All rows are indexed.

Buckets with common first slots travel together as a cell, cells of more than ``cell`` rows or queries in
parts. In a cell each bucket is one matrix product with the queries that visit it, in double precision, and
each query keeps its best k above its bound. Scores are computed again on the original vectors in a fixed
order of additions. ``n_scored`` says how many rows a query was compared with, over all tables.

Vectors whose neighbours are hardly nearer than the rest (such as random ones of many dimensions) make any
such index visit a large share of the rows; the share falls as the number of rows grows.

Cases: vectors that are null, zero, or hold null or non-finite components, such of another dimension than
most, and null ids take no part; rows with the query's id are no candidates; rows repeated with an id count
once, with the larger score; ties go to the smaller id; an empty table gives an empty table; only id and
vector are read, so other columns may have any names. A query whose buckets hold fewer than k rows gets those.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log2
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.common import cut, join_back, mix64, partitions
from kvspark.llm.vectors import dimension, element, inner, matrix, normal_cdf, valid

WIDTH, SUCCESS, SAMPLE, CELL = 2.5, 0.92, 8192, 2048
#: Rows of a bucket, about, before a projection more is used; projections inside a cell; slots that a perturbation goes up or down.
FILL, INNER, REACH = 100, 4, 3
#: Bands end between powers of two, as vectors of unit length are common.
BAND_SHIFT = 0.37


class Hasher:
    """Projections and bucket numbers of all tables."""

    def __init__(self, d: int, tables: int, functions: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((d + 1, tables * functions))
        self.shift = rng.uniform(0, 1, tables * functions)
        self.tables, self.functions, self.width = tables, functions, width
        self.outer = max(functions - INNER, 0)

    def places(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Projections in slot widths: rows by tables by functions."""
        y = (x @ self.a[:-1] + last[:, None] * self.a[-1]) / self.width + self.shift
        return y.reshape(len(x), self.tables, self.functions)

    def keys(self, slots: np.ndarray, band: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of cells and of buckets: band, table and slots, mixed."""
        at = [mix64((band.astype(np.int64) + 4096 * table).view(np.uint64))]
        for k in range(self.functions):
            at.append(mix64(at[-1] * np.uint64(0x9E3779B97F4A7C15) + slots[:, k].astype(np.int64).view(np.uint64)))
        return at[self.outer].view(np.int64), at[-1].view(np.int64)


def perturbed(place: np.ndarray, width: float, radius: float, need: float) -> np.ndarray:
    """The slots of a table's most likely buckets for a neighbour at distance ``radius``, in order, until their chances add up to ``need``."""
    steps = np.arange(-REACH, REACH + 1)
    gap = (np.floor(place)[:, None] + steps - place[:, None]) * (width / radius)
    chances = np.log(np.maximum(normal_cdf(gap + width / radius) - normal_cdf(gap), 1e-300))
    room = 64
    while True:
        total, chosen = np.zeros(1), np.zeros((1, 0), np.int64)
        for own in chances:  # the best of all sums are among the best of the sums so far
            sums = (total[:, None] + own).ravel()
            at = np.argpartition(-sums, room - 1)[:room] if len(sums) > room else np.arange(len(sums))
            total, chosen = sums[at], np.concatenate((chosen[at // len(steps)], steps[at % len(steps)][:, None]), axis=1)
        order = np.argsort(-total, kind="stable")
        upto = np.cumsum(np.exp(total[order]))
        if upto[-1] >= need or len(order) < room:
            n = int(np.searchsorted(upto, min(need, upto[-1]))) + 1
            return np.floor(place).astype(np.int64) + chosen[order[:n]]
        room *= 4


def _norms(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int | None = None, width: float = WIDTH, success: float = SUCCESS, sample: int = SAMPLE, cell: int = CELL, fill: int = FILL, seed: int = 11) -> DataFrame:
    """(query_id, rank, id, score, n_scored): the k best candidates found for each row that ``is_query`` selects."""
    spark = vectors.sparkSession
    kind = element(vectors, vec_col)
    named = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast(f"array<{kind}>").alias("_v"), is_query.alias("_q")).where(F.col("_id").isNotNull())
    rows = named.where(valid(F.col("_v")))
    d = dimension(rows, "_v")
    out_columns = [F.col("_q_id").alias("query_id"), "rank", F.col("_id").alias(id_col), F.col("_score").alias("score"), "n_scored"]
    if not d:
        return rows.select(F.col("_id").alias("_q_id"), F.lit(1).alias("rank"), "_id", F.lit(0.0).alias("_score"), F.lit(0).cast("long").alias("n_scored")).limit(0).select(*out_columns)
    rows = rows.where(F.size("_v") == d).withColumn("_norm", _norms(F.col("_v"))).withColumn("_band", F.floor(F.log2("_norm") + BAND_SHIFT).cast("int"))
    stats = rows.groupBy("_band").agg(F.max("_norm").alias("_most"), F.count(F.lit(1)).alias("_rows")).collect()  # one row for each power of two that a double has
    scale = {r["_band"]: r["_most"] for r in stats}
    n = sum(r["_rows"] for r in stats)
    functions = max(0, round(log2(n / fill)))
    tables = tables or max(1, functions // 2)
    hasher = Hasher(d, tables, functions, width, seed)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = np.asarray(batch.column("_band"))
            unit = matrix(batch.column("_v"), d) / np.array([scale[b] for b in band.tolist()])[:, None]
            slots = np.floor(hasher.places(unit, np.sqrt(np.maximum(0, 1 - inner(unit, unit)))))
            for t in range(tables):
                cells, keys = hasher.keys(slots[:, t], band, t)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(keys), batch.column("_id"), batch.column("_v")], ["_cell", "_key", "_id", "_v"])

    indexed = rows.select("_band", "_id", "_v").mapInArrow(index, f"_cell long, _key long, _id long, _v array<{kind}>")
    counts = indexed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))
    picked = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_id", "_v").toArrow()
    shared = spark.sparkContext.broadcast((np.asarray(picked.column("_id")), matrix(picked.column("_v"), d)))  # ``sample`` rows at most
    need = 1 - (1 - success) ** (1 / tables)
    # Where the k-th neighbour of all rows would stand in the sample; beyond its best row, by so many deviations.
    share = k * min(sample, n) / n
    seat = max(1, ceil(share + share**0.5)) if share >= 1 else 1  # a deviation further, so that chance does not place it too near
    tail = max(0.0, NormalDist().inv_cdf(1 - k / n) - NormalDist().inv_cdf(1 - 1 / sample)) if share < 1 else 0.0

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample_ids, sample_x = shared.value
        low = max(k, ceil(8 * k * len(sample_ids) / n))
        for batch in batches:
            ids, x = np.asarray(batch.column("_id")), matrix(batch.column("_v"), d)
            norms = np.sqrt(inner(x, x))
            places = hasher.places(x / norms[:, None], np.zeros(len(x)))
            scores = sample_x @ x.T
            for i, own in enumerate(ids.tolist()):
                s = np.sort(scores[sample_ids != own, i])
                bound = float(s[-low]) - 1e-9 * abs(float(s[-low])) if len(s) >= low else -np.inf
                aim = float(s[-seat]) + (float(s.std()) * tail if tail else 0.0) if len(s) >= max(k, seat) else -np.inf
                cells, keys = [], []
                for band, most in scale.items():
                    reach = bound / (norms[i] * most)
                    if reach > 1 + 1e-9:
                        continue
                    radius = max(2 - 2 * min(max(aim / (norms[i] * most), -1), 1), 1e-6) ** 0.5
                    for t in range(tables):
                        slots = perturbed(places[i, t], width, radius, need) if hasher.functions else np.zeros((1, 0))
                        c, b = hasher.keys(slots, np.full(len(slots), band), t)
                        cells.append(c)
                        keys.append(b)
                if not cells:
                    continue
                cells, keys = np.concatenate(cells), np.concatenate(keys)
                order = np.argsort(cells, kind="stable")
                own_cells, at = np.unique(cells[order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(keys)).astype(np.int32)), pa.array(keys[order]))
                m = len(own_cells)
                yield pa.RecordBatch.from_arrays([pa.array(own_cells), pa.array(np.full(m, own)), pa.array(np.full(m, bound)), lists], ["_cell", "_q_id", "_bound", "_keys"])

    queries = rows.where("_q").select("_id", "_v")
    probes = cut(queries.mapInArrow(lambda b: _merged(probe(b)), "_cell long, _q_id long, _bound double, _keys array<long>"))
    sizes = counts.join(probes.groupBy("_cell").agg(F.count(F.lit(1)).alias("_queries")), "_cell")
    parts = lambda c: F.expr(f"cast(({c} + {cell - 1}) div {cell} as int)")
    sizes = cut(sizes.select("_cell", "_rows", "_queries", parts("_rows").alias("_nd"), parts("_queries").alias("_nq")))
    part = lambda col, m: F.pmod(F.xxhash64(col), F.col(m)).cast("int")
    whole = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = join_back(indexed, sizes, "_cell", n * tables, "_rows").withColumn("_d", part("_id", "_nd")).withColumn("_p", whole("_nq"))
    right = join_back(probes, sizes, "_cell", probes.count(), "_queries").withColumn("_p", part("_q_id", "_nq")).withColumn("_d", whole("_nd"))
    right = right.join(queries.groupBy(F.col("_id").alias("_q_id")).agg(F.max("_v").alias("_v")), "_q_id")
    place = F.xxhash64("_cell", "_d", "_p").alias("_cell")
    both = left.select(place, F.lit(0).alias("_side"), "_id", F.lit(0.0).alias("_bound"), F.array("_key").alias("_keys"), "_v")
    both = both.unionByName(right.select(place, F.lit(1).alias("_side"), F.col("_q_id").alias("_id"), "_bound", "_keys", "_v"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            side = np.asarray(group.column("_side"))
            m = int(np.searchsorted(side, 1))
            if 0 < m < len(side):
                yield _best_of(group, m, k, d)

    kinds = "_q_id long, _id long, _score double, _seen long"
    found = both.repartition(partitions(spark), "_cell").sortWithinPartitions("_cell", "_side").mapInArrow(lambda b: _merged(compare(b)), kinds)
    once = found.groupBy("_q_id", "_id").agg(F.max("_score").alias("_score"), F.sum("_seen").alias("_seen"))
    own = Window.partitionBy("_q_id")
    ranked = once.withColumn("n_scored", F.max("_seen").over(own)).where("_id is not null")
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy(F.desc("_score"), "_id"))).where(F.col("rank") <= k)
    return ranked.select(*out_columns)


def _best_of(group: pa.Table, m: int, k: int, d: int) -> pa.RecordBatch:
    """Of a cell's rows (the first m) the best k above its bound for each query, and a row without id with the number of rows it was compared with."""
    ids, bound, v = np.asarray(group.column("_id")), np.asarray(group.column("_bound"))[m:], matrix(group.column("_v"), d)
    keys = group.column("_keys").combine_chunks() if isinstance(group.column("_keys"), pa.ChunkedArray) else group.column("_keys")
    values, ends = np.asarray(keys.flatten()), np.cumsum(np.asarray(keys.value_lengths()))
    order = np.argsort(values[:m], kind="stable")  # a row has one key
    kinds, starts = np.unique(values[:m][order], return_index=True)
    cuts = np.append(starts, m)
    asked, who = values[m:], np.repeat(np.arange(len(ids) - m), np.diff(ends[m - 1 :]))
    at = np.minimum(np.searchsorted(kinds, asked), len(kinds) - 1)
    hit = kinds[at] == asked
    at, who = at[hit], who[hit]
    by = np.argsort(at, kind="stable")
    at, who = at[by], who[by]
    q_ids, x, q = ids[m:], v[:m][order], v[m:]
    row_ids = ids[:m][order]
    scores = np.full((m, len(q_ids)), -np.inf)
    seen = np.zeros(len(q_ids), np.int64)
    for b in np.unique(at).tolist():
        own = who[np.searchsorted(at, b) : np.searchsorted(at, b, "right")]
        lo, hi = int(cuts[b]), int(cuts[b + 1])
        scores[lo:hi, own] = x[lo:hi] @ q[own].T
        seen[own] += hi - lo
    scores[scores < bound] = -np.inf
    place = np.searchsorted(np.sort(row_ids), q_ids)
    if len(row_ids):
        same = np.sort(row_ids)[np.minimum(place, m - 1)] == q_ids
        for c in np.flatnonzero(same).tolist():
            mine = row_ids == q_ids[c]
            seen[c] -= int(np.isfinite(scores[mine, c]).sum())
            scores[mine, c] = -np.inf
    edge = np.partition(scores, m - k, axis=0)[m - k] if m > k else np.full(len(q_ids), -np.inf)
    r, c = np.nonzero(np.isfinite(scores) & (scores >= edge - 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))))
    exact = np.concatenate([inner(x[r[a : a + 65536]], q[c[a : a + 65536]]) for a in range(0, len(r), 65536)] or [np.zeros(0)])
    sort = np.lexsort((row_ids[r], -exact, c))
    r, c, exact = r[sort], c[sort], exact[sort]
    rank = np.arange(len(c)) - np.searchsorted(c, c)
    keep = rank < k
    some = np.flatnonzero(seen)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((q_ids[c[keep]], q_ids[some]))), pa.array([*row_ids[r[keep]].tolist(), *[None] * len(some)], pa.int64()),
        pa.array([*exact[keep].tolist(), *[None] * len(some)], pa.float64()), pa.array([*[None] * int(keep.sum()), *seen[some].tolist()], pa.int64()),
    ], ["_q_id", "_id", "_score", "_seen"])


def _merged(batches: Iterable[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Small batches joined into larger ones."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sorted_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each _cell, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []

    def close(parts: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        cells = np.asarray(rows.column("_cell"))
        cuts = np.flatnonzero(np.diff(cells)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
            if b > a:
                yield rows.slice(a, b - a)

    for batch in batches:
        cells = np.asarray(batch.column("_cell"))
        if not len(cells):
            continue
        others = np.flatnonzero(cells != cells[-1])
        cut_at = int(others[-1]) + 1 if len(others) else 0
        if cut_at or (held and held[-1].column("_cell")[-1].as_py() != int(cells[0])):
            yield from close([*held, batch.slice(0, cut_at)])
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield from close(held)
