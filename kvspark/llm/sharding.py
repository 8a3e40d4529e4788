"""Sharding along a Hilbert curve, with DataFrame functions alone.

Each row's metadata (source, language, size) is quantised to a few bits a dimension, the cell's place
on a Hilbert curve is computed, rows are sorted by it and the sorted run is cut into shards of equal
row counts (law ``rows``: counts differ by one at most). Rows that are near in all dimensions share a
shard, so a filter on any of them prunes files by their minima and maxima.

Text never shuffles: only ids, sizes, checksums and the curve index do. Codes of the categories are
broadcast where they are few (BROADCAST_BYTES at most; else they are joined, heavy values apart), so the
index is computed before anything shuffles. Positions come from a range sort and one count for each of its
partitions.

The order is that of the curve, then id, size and checksum, so a hot source is cut like any other run. Under
the law ``rows`` equal texts are rows like others: they have one size, and where they agree in the other
dimensions they lie in one cell of the curve, in one shard or, at a cut, in neighbouring ones.

Cases: null text has size 1 and the checksum of no bytes; texts of any length are read whole; null metadata
sorts last in its dimension; rows that tie in all of the order are alike in what is returned; null ids come
first; repeated rows each get a slot; an empty table gives an empty table; only named columns are read, so
other columns and their names do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.common import cut, join_back, partitions


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of integer coordinates of ``bits`` bits each (Skilling's transform)."""
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        here, first, low = F.element_at(x, s["i"] + 1), x[0], s["q"] - 1
        hit = here.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(hit & (j == 0), v.bitwiseXOR(low)).when(~hit & ((j == 0) | (j == s["i"])) & (s["i"] != 0), v.bitwiseXOR(swap)).otherwise(v))

    def finish(x: Column) -> Column:
        gray = F.transform(x, lambda _, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
        return F.transform(F.array(gray), _spread)[0]

    def _spread(g: Column) -> Column:
        masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
        flip = F.aggregate(masks, F.lit(0), lambda t, q: F.when(F.element_at(g, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(F.array(flip), lambda t: _interleave(g, t))[0]

    def _interleave(g: Column, t: Column) -> Column:
        places = [(b, i) for b in range(bits - 1, -1, -1) for i in range(n)]
        terms = [F.shiftleft(F.shiftright(F.element_at(g, i + 1).bitwiseXOR(t), b).bitwiseAND(F.lit(1)).cast("long"), len(places) - 1 - k) for k, (b, i) in enumerate(places)]
        return reduce(lambda a, b: a.bitwiseOR(b), terms)

    if bits == 1:
        return finish(F.array(*[a.cast("int") for a in axes]))
    return finish(F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), undo))


#: Distinct values whose codes one task computes, and bytes of them that are broadcast, at most; more are sorted by range and joined.
FEW, BROADCAST_BYTES = 65_536, 16 << 20


def _placed(rows: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """Adds _before, the number (or the sum of ``weight``) of the rows that come before in the order, and _total: a range sort and one sum for each of its partitions."""
    run = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    run = cut(run.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    sums = run.groupBy("_part").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_part", before.alias("_offset"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))  # one row a partition
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    if weight:
        inside = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return run.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn("_before", F.col("_offset") + F.col("_inside"))


def equal_depth_codes(counts: DataFrame, col: str, bits: int, few: int = FEW) -> DataFrame:
    """A table (col, _n) of distinct values and their rows with ``_code``: a value's place among all rows in the order of values, in 2**bits steps."""
    if counts.count() <= few:
        order = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    else:
        placed = _placed(counts, [col], "_n")
    return placed.select(col, "_n", F.expr(f"cast(least((2 * _before + _n) * {1 << bits} div (2 * _total), {(1 << bits) - 1}) as int)").alias("_code"))


def hilbert_shards(docs: DataFrame, n_shards: int = 16, bits: int = 5, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("source", "lang"), few: int = FEW) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve) for each row. Categories are compared as strings."""
    text = F.col(text_col).cast("string")
    names = [f"_c{k}" for k in range(len(categories))]
    value = lambda c: F.coalesce(F.concat(F.lit("0"), F.col(c).cast("string")), F.lit("1"))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("_crc"),
        *[value(c).alias(n) for c, n in zip(categories, names, strict=True)],
    )
    axes = [F.least(F.length(F.bin("_size")) - 1, F.lit((1 << bits) - 1))]
    for k, name in enumerate(names):
        counts = cut(docs.select(value(categories[k]).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("_n")))
        size, total = counts.agg(F.sum(F.octet_length(name) + 16), F.sum("_n")).first()
        codes = equal_depth_codes(counts, name, bits, few).withColumnRenamed("_code", f"_a{k}")
        small = (size or 0) <= BROADCAST_BYTES and few == FEW
        rows = rows.join(F.broadcast(codes), name).drop("_n", name) if small else join_back(cut(rows), cut(codes), name, total or 0).drop("_n", name)
        axes.append(F.col(f"_a{k}"))
    placed = rows.select("_id", "_size", "_crc", hilbert_index(axes, bits).alias("_curve"))
    ranked = _placed(cut(placed), ["_curve", "_id", "_size", "_crc"]).withColumn("_shard", F.expr(f"_before * {n_shards} div _total"))
    return ranked.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"), F.expr(f"_before - (_shard * _total + {n_shards - 1}) div {n_shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("_curve").alias("curve"),
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Store the rows as one folder a shard, in slot order, so that readers prune by folder and by file statistics."""
    placed = docs.join(shards.select(id_col, "shard", "slot"), id_col)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
