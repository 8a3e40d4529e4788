"""Merkle trees over segments: leaves, root, proofs and differences. Hashes are SHA-256 in hex.

A node without a sibling is paired with itself, also in proofs. A segment's leaves meet in one array,
which the segment size bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaves(segments: DataFrame, leaf: str = "value") -> DataFrame:
    """(segment_id, leaf_idx, leaf): a hash of each record's value, or of key and value."""
    content = F.coalesce("value", F.lit(""))
    if leaf == "key_value":
        content = F.concat("key", F.lit("|"), content)
    elif leaf != "value":
        raise ValueError("leaf is value or key_value")
    place = F.row_number().over(Window.partitionBy("segment_id").orderBy("key", "seq")) - 1
    return segments.select("segment_id", place.alias("leaf_idx"), F.sha2(content, 256).alias("leaf"))


def _up(level: Column) -> Column:
    half = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    left = lambda i: F.element_at(level, i * 2 + 1)
    right = lambda i: F.element_at(level, F.least(i * 2 + 2, F.size(level)))
    return F.transform(half, lambda i: F.sha2(F.concat(left(i), right(i)), 256))


def roots(leaf_rows: DataFrame) -> DataFrame:
    """(segment_id, n_leaves, merkle_root)."""
    gathered = leaf_rows.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf_idx", "leaf"))), lambda x: x["leaf"]).alias("_l"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("_l"))).cast("int"))
    root = F.when(F.size("_l") == 1, F.col("_l")).otherwise(F.aggregate(steps, F.col("_l"), lambda a, _: _up(a)))
    return gathered.select("segment_id", F.size("_l").alias("n_leaves"), F.element_at(root, 1).alias("merkle_root"))


def proofs(leaf_rows: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(segment_id, leaf_idx, leaf, verified): each leaf's path of siblings folded again and compared with the root.

    ``given`` (segment_id, leaf_idx, leaf) holds the leaves to prove, else those of the tree itself. Paths are
    folded inside the segment's row, so the tree is not copied to the leaves.
    """
    gathered = leaf_rows.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf_idx", "leaf"))), lambda x: x["leaf"]).alias("_l"))
    if given is not None:
        shown = given.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("leaf_idx", "leaf"))).alias("_given"))
        gathered = gathered.join(shown, "segment_id")
    else:
        gathered = gathered.withColumn("_given", F.transform("_l", lambda x, i: F.struct(i.alias("leaf_idx"), x.alias("leaf"))))
    steps = F.when(F.size("_l") > 1, F.sequence(F.lit(1), F.ceil(F.log2(F.size("_l"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    tree = F.aggregate(steps, F.array(F.col("_l")), lambda a, _: F.concat(a, F.array(_up(F.element_at(a, -1)))))
    rows = gathered.withColumn("_tree", tree).withColumn("_below", F.slice("_tree", F.lit(1), F.size("_tree") - 1))

    def climb(a: Column, level: Column) -> Column:
        own = a["i"] % 2 == 0
        sibling = F.element_at(level, F.least(F.when(own, a["i"] + 2).otherwise(a["i"]), F.size(level)))
        return F.struct(F.sha2(F.when(own, F.concat(a["h"], sibling)).otherwise(F.concat(sibling, a["h"])), 256).alias("h"), F.floor(a["i"] / 2).cast("int").alias("i"))

    def proved(x: Column) -> Column:
        top = F.aggregate("_below", F.struct(x["leaf"].alias("h"), x["leaf_idx"].alias("i")), climb)
        return F.struct(x["leaf_idx"].alias("leaf_idx"), x["leaf"].alias("leaf"), (top["h"] == F.element_at(F.element_at("_tree", -1), 1)).alias("verified"))

    return rows.select("segment_id", F.explode(F.transform("_given", proved)).alias("_x")).select("segment_id", "_x.*")


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """(segment_id, leaf_idx, change): MODIFIED, DELETED and ADDED leaves."""
    a, b = before.withColumnRenamed("leaf", "_a"), now.withColumnRenamed("leaf", "_b")
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "DELETED").when(F.col("_a") != F.col("_b"), "MODIFIED")
    return a.join(b, ["segment_id", "leaf_idx"], "full_outer").select("segment_id", "leaf_idx", change.alias("change")).where("change is not null")


def validate(stored_roots: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, ok): segments whose root is what was stored."""
    now = roots(leaves(segments)).select("segment_id", F.col("merkle_root").alias("_now"))
    return stored_roots.join(now, "segment_id", "left").select("segment_id", F.coalesce(F.col("merkle_root") == F.col("_now"), F.lit(False)).alias("ok"))
