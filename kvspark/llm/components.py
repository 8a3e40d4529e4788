"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.common import cut, drop_cut, join_back

#: Edges that one task takes at most: a smaller graph needs no rounds.
SMALL = 20_000


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of a small graph in one task: roots hook to smaller roots, then paths are halved."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes, ends = np.unique(np.concatenate([np.asarray(table.column(c)) for c in ("u", "v")]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for each node of the edges (a, b), which are of type long; the component is its smallest node.

    Each round joins neighbours with the smallest neighbour, found by a partial aggregation. Nodes with very
    many edges (fewer than 1,024 of them) meet their smallest neighbour by broadcast, so a hub's edges stay
    where they are. Rounds end when the edges are stars and stay the same. Lineage is cut after each round. A graph
    of at most ``small`` edges is finished in one task.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = _state(now)
    if state[0] <= small:
        return now.repartition(1).mapInArrow(_finish, "node long, component long")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n")))
        large = join_back(both, least, "u", 2 * state[0])
        large = cut(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        drop_cut(least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")))
        small = join_back(large, least, "u", large.count()).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for done in (now, large, least):
            drop_cut(done)
        old, state, now = state, _state(after), after
        if state == old:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
