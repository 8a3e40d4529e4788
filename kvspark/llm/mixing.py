"""Mixing sources to target weights with a low-discrepancy schedule, with DataFrame functions alone.

Sources share the total size by weight; no source gives more than ``max_epochs`` times its own size,
and what it cannot give goes to the others by weight. The mix is a row of slots. Slot i stands at the
golden-ratio point frac(i * 0.618...) of the line of cumulative targets and so belongs to one source; a
source that no point falls into takes part in the slot that has its place on the line. Each source's
documents are shuffled by a hash and laid end to end, again from the start after the last. A source's
target, rounded to a word, is cut into equal blocks, one for each of its slots, and the slot of rank r takes
block r: the join of blocks with the documents they cover gives what each document yields. So a source
reaches its target to a word, however small it is, and every prefix of the schedule is close to the targets.

Running totals inside a source go over 4,096 hash buckets first, so a source with a third of all rows
is never in one task; slot ranks go over chunks of slots likewise.

Cases: null text has size 0, as have empty ones, and nothing of them is taken; texts of any length are
taken whole; a null source is a source of its own and comes last; a null id is an id; documents with one
hash are laid by id, then size; repeated rows are taken separately, one after the other; an empty table
gives an empty table; only the id, text and source are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.common import cut, join_back

GOLDEN = 0.6180339887498949
CELLS, CHUNK = 4096, 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to a table (_key, source_size): shares by weight, each capped, the excess reshared."""
    everything = Window.partitionBy()
    total, cap = F.sum("source_size").over(everything), F.col("source_size") * max_epochs
    number = F.row_number().over(Window.orderBy("_key")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int"))
    t = sizes.select("_key", "source_size", total.alias("_total"), cap.alias("_cap"), weight.alias("_w"))
    # In the order of cap by weight, those that reach their caps come first; the first that does not sets the level.
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", "_key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    t = t.withColumn("_level", left.cast("double") / rest.cast("double")).withColumn("_place", F.row_number().over(Window.orderBy("_ratio", "_key")))
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_place", "_level"))).over(everything)["_level"]
    t = t.withColumn("_final", level)
    return t.withColumn("target", F.when(F.col("_final").isNull() | (F.col("_ratio") <= F.col("_final")), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_final"))).select("_key", "source_size", "target")


def _drawn(spark_targets: DataFrame, slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The line of targets, (slot, _key, _rank) of each slot, and the number of slots that each source has."""
    spark = spark_targets.sparkSession
    run = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("target").over(Window.partitionBy())
    line = spark_targets.where("target > 0").withColumn("_to", F.sum("target").over(run)).withColumn("_whole", whole)
    line = line.withColumn("_to", F.when(F.row_number().over(Window.orderBy(F.desc("_key"))) == 1, F.lit(2.0)).otherwise(F.col("_to") / F.col("_whole")))
    line = line.withColumn("_from", F.lag("_to", 1, 0.0).over(Window.orderBy("_key")))
    places = line
    cell = F.explode(F.sequence(F.floor(F.col("_from") * CELLS).cast("int"), F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1)).cast("int")))
    line = line.withColumn("_cell", cell).select("_cell", "_key", "_from", "_to")
    point = F.col("slot") * F.lit(GOLDEN)
    at = spark.range(slots).withColumnRenamed("id", "slot").withColumn("_point", point - F.floor(point)).withColumn("_cell", F.floor(F.col("_point") * CELLS).cast("int"))
    drawn = at.join(line, "_cell").where("_point >= _from and _point < _to").select("slot", "_key", F.expr(f"slot div {CHUNK}").alias("_chunk"))
    counts = drawn.groupBy("_key", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_key", "_chunk", offset.alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_key", "_chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("_inside", inside).join(offsets, ["_key", "_chunk"]).withColumn("_rank", F.col("_offset") + F.col("_inside"))
    return places, ranked.select("slot", "_key", "_rank"), counts.groupBy("_key").agg(F.sum("_n").alias("_slots"))


def schedule(spark_targets: DataFrame, slots: int) -> DataFrame:
    """(slot, _key, rank, first, end): the block of words that each slot of the mix takes from the repeated row of its source."""
    line, ranked, numbers = _drawn(spark_targets, slots)
    own = line.select("_key", F.round("target").cast("long").alias("_target"), F.least(F.floor((F.col("_from") + F.least("_to", F.lit(1.0))) / 2 * slots), F.lit(slots - 1)).cast("long").alias("_place"))
    shared = own.join(numbers, "_key", "left").withColumn("_slots", F.coalesce("_slots", F.lit(0)))
    every = ranked.join(shared, "_key").unionByName(shared.where("_slots = 0").withColumns({"slot": F.col("_place"), "_rank": F.lit(0), "_slots": F.lit(1)}), allowMissingColumns=True)
    upto = lambda rank: F.expr(f"cast(cast(_target as decimal(19, 0)) * cast({rank} as decimal(19, 0)) div _slots as bigint)")
    return every.select("slot", "_key", F.col("_rank").alias("rank"), upto("_rank").alias("first"), upto("_rank + 1").alias("end"), "_slots", "_target")


def block_size(total: int) -> int:
    """Words a slot, about: 65,536 slots in a small mix, 4,096 words at most."""
    return min(4096, max(1, total // 65536))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, places: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row; with ``places`` also first_slot, where the mix first takes words of the row."""
    key: Column = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    rows = cut(docs.select(
        F.col(id_col).alias("_id"), key.alias("_key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("")).alias("_hash"),
    ))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    aims = cut(targets(rows.groupBy("_key").agg(F.sum("_size").alias("source_size")), weights, max_epochs))

    bucket = F.substring("_hash", 1, 3).alias("_bucket")
    sums = rows.groupBy("_key", bucket).agg(F.sum("_size").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_key", "_bucket").orderBy("_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = rows.withColumn("_bucket", bucket).withColumn("_inside", inside).join(sums.select("_key", "_bucket", base.alias("_base")), ["_key", "_bucket"])
    laid = laid.select("_id", "_key", "_size", (F.col("_base") + F.col("_inside")).alias("_start"))

    blocks = cut(schedule(aims, -(-total // block_size(total))))
    lengths = blocks.groupBy("_key").agg(F.max("_slots").alias("_slots"), F.max("_target").alias("_target"))
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    per_source = cut(aims.join(lengths, "_key", "left").join(counts, "_key"))
    laid = cut(join_back(cut(laid), per_source, "_key", rows.count()))
    # A document stands once in each round of its source's repeated row; the blocks it reaches there follow from their equal lengths.
    rounds = laid.where("_size > 0 and _target > 0").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    rounds = rounds.withColumn("_lo", F.col("_round") * F.col("source_size") + F.col("_start")).withColumn("_hi", F.least(F.col("_lo") + F.col("_size"), "_target")).where("_lo < _hi")
    rank = lambda place: f"cast((cast({place} + 1 as decimal(19, 0)) * cast(_slots as decimal(19, 0)) - 1) div _target as bigint)"
    spans = rounds.select("_id", "_key", "_size", "_start", "_lo", "_hi", F.explode(F.expr(f"sequence({rank('_lo')}, {rank('_hi - 1')})")).alias("rank"))
    overlap = F.least("_hi", "end") - F.greatest("_lo", "first")
    taken = spans.join(blocks.select("_key", "rank", "first", "end", "slot"), ["_key", "rank"]).groupBy("_key", "_start", "_id", "_size")
    taken = taken.agg(F.sum(overlap).alias("taken"), F.min("slot").alias("first_slot")).select("_key", "_start", "_size", "taken", "first_slot")
    every = laid.join(taken, ["_key", "_start", "_size"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    source = F.when(F.col("_key") == "1", None).otherwise(F.expr("substring(_key, 2)"))
    return every.select(F.col("_id").alias(id_col), source.alias(source_col), F.col("_size").alias("size"), "source_size", "target", "taken", *(["first_slot"] if places else []))
