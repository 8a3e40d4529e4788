"""Near-duplicate embeddings by NN-descent: a neighbour graph refined through neighbours of neighbours.

1. Copies collapse: equal vectors with an equal label are one node with a multiplicity.
2. First lists: sign-random-projection cells (several tables, cut into blocks of at most ``block`` nodes
   by a hash) are compared inside; each node keeps its best neighbours.
3. Rounds: each node's neighbours and reverse neighbours meet in a local join, which offers every member
   those that beat the worst of its list. A list whose entries all reach the threshold is saturated and
   enlarged. Rounds end when at most 1 % of the entries are new.
4. Edges at or above the threshold give components.
5. Every node is compared with all nodes of its label, block against block, without storing pairs. Links are
   counted there, and links between components that the lists left apart join them; so neither counts
   nor components depend on the length of a list. The comparisons grow with the square of a label's nodes.

Cases: vectors that are null, zero, or hold null or non-finite components, those of another dimension
than most and those with a null label link with nothing and are their own component; rows repeated with
an id count as one vector; a null id has no links and is kept; neighbours that are equally near are taken
by the smaller id; an empty table gives an empty table; only id, vector and label are read, so other columns
may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.ann import _merged, sorted_groups
from kvspark.llm.common import cut, drop_cut, partitions
from kvspark.llm.components import components
from kvspark.llm.vectors import dimension, element, inner, matrix, valid

TABLES, LIST, ENLARGED, BLOCK = 8, 8, 64, 256
#: Rounds end when at most this share of the lists' usual entries is new.
FEW = 0.01
#: Blocks of the whole comparison hold so many times more nodes; rows compared at once.
WIDE, SLICE = 8, 512
EDGE = "a long, b long, s double"


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, without overflow for large components."""
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
    return x / np.sqrt(inner(x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of unit vectors; those next to the threshold in a fixed order of additions."""
    s = a @ b.T
    close = np.nonzero(np.abs(s - threshold) < 1e-9)
    if len(close[0]):
        s[close] = inner(a[close[0]], b[close[1]])
    return s


def _edges(a: list, b: list, s: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(s))], ["a", "b", "s"])


def _first_lists(nodes: DataFrame, d: int, threshold: float, n: int, seed: int, block: int) -> DataFrame:
    """Best neighbours inside the cells of each table."""
    bits = max(1, min(40, round(math.log2(max(n, 2) / 64)))) if n > 64 else 0

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((d, TABLES * max(bits, 1)))
        weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
        for batch in batches:
            signs = (matrix(batch.column("_v"), d) @ planes > 0).reshape(batch.num_rows, TABLES, -1)
            for t in range(TABLES if bits else 1):
                key = (signs[:, t, :bits] * weights).sum(axis=1).astype(np.int64) if bits else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(key), batch.column("_label"), batch.column("_id"), batch.column("_v")], ["_table", "_key", "_label", "_id", "_v"])

    placed = nodes.select("_label", "_id", "_v").mapInArrow(place, f"_table int, _key long, _label string, _id long, _v array<{element(nodes, '_v')}>")
    sizes = placed.groupBy("_label", "_table", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    salted = placed.join(sizes, ["_label", "_table", "_key"]).withColumn("_salt", F.pmod(F.xxhash64("_id", "_table"), F.expr(f"(_n + {block - 1}) div {block}")))
    cells = salted.select(F.xxhash64("_label", "_table", "_key", "_salt").alias("_cell"), "_id", "_v")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _groups(batches, d):
            u = unit(x)
            s = cosines(u, u, threshold)
            np.fill_diagonal(s, -2)
            keep = min(LIST // 2, len(ids) - 1)
            if keep < 1:
                continue
            at = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            rows = np.repeat(np.arange(len(ids)), keep)
            yield _edges([ids[rows]], [ids[at.ravel()]], [s[rows, at.ravel()]])

    return cells.repartition(partitions(nodes.sparkSession), "_cell").sortWithinPartitions("_cell", "_id").mapInArrow(lambda b: _merged(compare(b)), EDGE)


def _groups(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each cell, from batches that are sorted by cell."""
    for group in sorted_groups(batches):
        yield np.asarray(group.column("_id")), matrix(group.column("_v"), d)


def _best(edges: DataFrame, threshold: float) -> DataFrame:
    """The lists: each node's LIST best neighbours, or up to ENLARGED while all of them reach the threshold; ``turn`` is the round an entry came in."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("turn").alias("turn"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return once.withColumn("_place", place).where(F.col("_place") <= ENLARGED).where((F.col("_place") <= LIST) | (F.col("s") >= threshold)).drop("_place")


def _round(nodes: DataFrame, lists: DataFrame, d: int, threshold: float) -> DataFrame:
    """Pairs that local joins offer: for every list, its owner, its members and reverse members meet."""
    worst = lists.groupBy("a").agg(F.min("s").alias("_s"), F.count(F.lit(1)).alias("_n"))
    worst = worst.select("a", F.when(F.col("_n") < LIST, -2.0).otherwise(F.col("_s")).alias("_bound"))
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("s"), "a"))
    back = lists.withColumn("_place", place).where(F.col("_place") <= LIST).select(F.col("b").alias("_cell"), F.col("a").alias("_id"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    there = lists.withColumn("_place", place).where(F.col("_place") <= 2 * LIST).select(F.col("a").alias("_cell"), F.col("b").alias("_id"))
    own = worst.select(F.col("a").alias("_cell"), F.col("a").alias("_id"))
    members = there.unionByName(back).unionByName(own).distinct()
    known = nodes.join(worst, nodes["_id"] == worst["a"]).select("_id", "_bound", "_v")
    cells = members.join(known, "_id")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            ids, bound, x = np.asarray(group.column("_id")), np.asarray(group.column("_bound")), unit(matrix(group.column("_v"), d))
            s = cosines(x, x, threshold)
            np.fill_diagonal(s, -2)
            s[s <= bound[:, None]] = -2
            keep = min(LIST // 2, len(ids) - 1)
            if keep < 1:
                continue
            at = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            rows = np.repeat(np.arange(len(ids)), keep)
            value = s[rows, at.ravel()]
            ok = value > -2
            if ok.any():
                yield _edges([ids[rows[ok]]], [ids[at.ravel()[ok]]], [value[ok]])

    return cells.repartition(partitions(nodes.sparkSession), "_cell").sortWithinPartitions("_cell", "_id").mapInArrow(lambda b: _merged(compare(b)), EDGE)


def _links(nodes: DataFrame, joined: DataFrame, d: int, threshold: float, block: int) -> DataFrame:
    """(_id, _n, _to): every node is compared with all nodes of its label, block against block, and no pair is stored.

    Rows with _n count vectors that a node's links reach. Rows with _to are links between components that
    are still apart; of those a cell gives as many as it takes to join them, fewer than it has components.
    """
    known = nodes.join(joined, nodes["_id"] == joined["node"], "left").withColumn("_component", F.coalesce("component", "_id"))
    sizes = nodes.groupBy("_label").agg(F.expr(f"(count(1) + {block - 1}) div {block}").cast("int").alias("_blocks"))
    members = known.join(sizes, "_label").withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks").cast("int"))
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cell = F.xxhash64("_label", F.least("_block", "_other"), F.greatest("_block", "_other")).alias("_cell")
    cells = members.select(cell, "_block", (F.col("_block") == F.col("_other")).alias("_inside"), "_id", "_component", F.col("_copies").cast("double").alias("_copies"), "_v")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            side, ids, copies = (np.asarray(group.column(c)) for c in ("_block", "_id", "_copies"))
            inside = group.column("_inside")[0].as_py()
            m = 0 if inside else int(np.searchsorted(side, side[-1]))
            if not inside and not m:
                continue
            x, to = unit(matrix(group.column("_v"), d)), len(ids) if inside else m
            names, root = np.unique(np.asarray(group.column("_component")), return_inverse=True)
            n, ends = np.zeros(len(ids)), []
            for lo in range(0, to, SLICE):
                hi = min(lo + SLICE, to)
                s = cosines(x[lo:hi], x[m:], threshold) >= threshold
                if inside:
                    s[np.arange(hi - lo), np.arange(lo, hi)] = False
                else:  # two blocks: both sides count
                    n[m:] += copies[lo:hi] @ s
                n[lo:hi] += s @ copies[m:]
                i, j = np.nonzero(s & (root[lo:hi, None] != root[None, m:]))
                if len(i):
                    root, found = _merge(root, np.unique(np.column_stack((root[lo + i], root[m + j])), axis=0))
                    ends += found
            some = np.flatnonzero(n)
            a, b = np.array(ends, np.int64).reshape(-1, 2).T
            count = pa.array([*np.round(n[some]).astype(np.int64).tolist(), *[None] * len(a)], pa.int64())
            other = pa.array([*[None] * len(some), *names[b].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[some], names[a]))), count, other], ["_id", "_n", "_to"])

    cells = cells.repartition(partitions(nodes.sparkSession), "_cell").sortWithinPartitions("_cell", "_block", "_id")
    return cells.mapInArrow(lambda b: _merged(compare(b)), "_id long, _n long, _to long")


def _merge(root: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The roots after the pairs are joined, and those of the pairs that joined two of them."""
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while (to := up.get(r, r)) != r:
            up[r] = up.get(to, to)
            r = to
        return r

    found = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            found.append((a, b))
    kinds, at = np.unique(root, return_inverse=True)
    return np.array([top(r) for r in kinds.tolist()])[at], found


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    every = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vec_col).cast(f"array<{element(vectors, vec_col)}>").alias("_v"))
    good = every.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & valid(F.col("_v")))
    d = dimension(good, "_v")
    single = good.where(F.size("_v") == d).groupBy("_id").agg(F.max(F.struct("_label", "_v")).alias("_x")).select("_id", "_x.*")
    single = cut(single)
    classes = single.groupBy("_label", "_v").agg(F.min("_id").alias("_node"), F.count(F.lit(1)).alias("_copies"))
    nodes = cut(classes.select(F.col("_node").alias("_id"), "_label", "_v", "_copies"))
    n = nodes.count()
    lists = cut(_best(_first_lists(nodes, d, threshold, n, 17, block).withColumn("turn", F.lit(0)), threshold))
    turn, changed = 0, n * LIST
    while changed > FEW * n * LIST:
        turn, before = turn + 1, lists
        lists = cut(_best(before.unionByName(_round(nodes, before, d, threshold).withColumn("turn", F.lit(turn))), threshold))
        changed = lists.where(F.col("turn") == turn).count()
        drop_cut(before)
    joined = cut(components(lists.where(F.col("s") >= threshold).select("a", "b")))
    reached = cut(_links(nodes, joined, d, threshold, WIDE * block))
    missed = reached.where("_to is not null").select(F.col("_id").alias("a"), F.col("_to").alias("b"))
    if not missed.isEmpty():
        joined = cut(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(missed)))
    counts = reached.where("_n is not null").groupBy("_id").agg(F.sum("_n").alias("_links"))
    found = nodes.join(joined, nodes["_id"] == joined["node"], "left").join(counts, "_id", "left")
    found = found.select("_label", "_v", F.coalesce("component", "_id").alias("_component"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_n"))
    per_id = single.join(found, ["_label", "_v"]).select("_id", "_component", "_n")
    out = every.select("_id").join(per_id, "_id", "left")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
