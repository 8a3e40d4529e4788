"""Exact Jaccard self-join of documents on word shingles, as a grouped prefix join.

1. Documents with the same shingle set collapse to one class (a 128-bit digest of the set's hashes).
2. A set's shingles are put in one global order, rarest first; its prefix is what any partner at or above
   the threshold must share one shingle of. Rarity is the smallest count among a shingle and its words,
   taken from two fixed-size count sketches over all texts: an upper bound, so frequent passages never
   lead a set with rarer shingles. Any order is right; this one keeps lists short.
3. Classes with identical prefixes and size form one group. Only groups enter the lists of their prefix
   shingles. Group pairs that share a list are filtered by size and by position (what is left of both sets
   must still hold the overlap that the threshold asks for).
4. Stars first: every list pairs its largest group with the others, and every group its first class with
   the others. Verified pairs give components. Then all pairs of one list that lie in different components
   pass the same filters, are expanded to their classes and verified. So no link between components is
   lost, and no group of copies is ever expanded into all pairs. Long lists are cut into blocks by size
   and into parts; heavy tokens and classes are joined by broadcast, fewer than 1,024 of them.
5. A verification cell holds one class and about ``cell`` partners with their whole texts.

Cases: null and empty texts, and texts without words, have an empty set and link with nothing; fewer
words than ``k`` make one shingle of the whole sequence; texts of any length are taken whole; of documents
that are equally rare or equally large the smaller id or hash comes first; rows repeated with an id are
one document; null ids link with nothing; an empty table gives an empty table; only id and text are read,
so other columns may have any names. Shingles are told apart by 64-bit hashes, classes by two independent
ones, and pairs are verified by a third. A text that comes out of a shuffle is written first, as it is read more than once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm import textvec
from kvspark.llm.ann import sorted_groups
from kvspark.llm.common import cut, drop_cut, join_back, mix64, stable, tasks, tree_merge
from kvspark.llm.components import components

SKETCH_BITS, SEGMENT_BITS, CHUNK_CHARS, CELL = 21, 16, 50_000, 64
FILTER_BITS, FILTER_SEGMENT = 24, 19
#: Bytes that a task of a scan reads, about; bytes for each task of the shuffles; members of a list that one task pairs.
SPLIT_BYTES, TASK_BYTES, LIST_CELL = 128 << 20, 32 << 20, 2048


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to] or "") <= limit):
            n += len(texts[to] or "")
            to += 1
        yield at, [t or "" for t in texts[at:to]]
        at = to


def _cell_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _shingles(texts: list[str], k: int, sketch: np.ndarray | None = None, families: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Text number, hashes (one of each family) and rarity of each shingle, in the order of the texts, and the words' first hashes."""
    cp, starts, ends, of = textvec.ascii_words(texts)
    per_family = [textvec.span_hashes(cp, starts, ends, f) for f in families]
    words = per_family[0]
    n = len(words)
    if not n:
        return of, [np.zeros(0, np.uint64) for _ in families], np.zeros(0, np.uint32), words
    counts = np.bincount(of, minlength=len(texts))
    rare = sketch[0][_cell_of(words)] if sketch is not None else np.zeros(n, np.uint32)
    first = np.cumsum(counts) - counts
    left = np.repeat(first + counts, counts) - np.arange(n)  # words from here to the text's end
    hashes, r = [np.full(n, 0x51ED270B0F3C2A11, np.uint64) for _ in families], rare.copy()
    use = (left >= k) | ((np.arange(n) == first[of]) & (counts[of] < k))
    for j in range(k):
        inside = left > j
        at = np.minimum(np.arange(n) + j, n - 1)
        for f, own in enumerate(per_family):
            step = mix64((hashes[f] * np.uint64(0x9E3779B97F4A7C15)) ^ (own[at] + np.uint64(j + 1)))
            hashes[f] = np.where(inside, step, hashes[f])
        r = np.where(inside, np.minimum(r, rare[at]), r)
    of, hashes, r = of[use], [h[use] for h in hashes], r[use]
    return of, hashes, r if sketch is None else np.minimum(r, sketch[1][_cell_of(hashes[0])]), words


def shingle_sets(texts: list[str], k: int, sketch: np.ndarray | None = None, families: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Text number, hashes and rarity of each text's distinct shingles, sorted by text and first hash."""
    of, hashes, r, _ = _shingles(texts, k, sketch, families)
    order = np.lexsort((*reversed(hashes), of))
    of, hashes, r = of[order], [h[order] for h in hashes], r[order]
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    for h in hashes:
        new[1:] |= h[1:] != h[:-1]
    return of[new], [h[new] for h in hashes], r[new]


def counts_of(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of words (row 0) and of shingles (row 1) by cell of a sketch, over all texts."""
    segments = 1 << (SKETCH_BITS - SEGMENT_BITS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << SKETCH_BITS), np.uint32)
        for batch in batches:
            for _, part in chunks(batch.column(0).to_pylist()):
                _, (h,), _, words = _shingles(part, k)
                for row, hashes in enumerate((words, h)):
                    cells, n = np.unique(_cell_of(hashes), return_counts=True)
                    total[row, cells] += n.astype(np.uint32)
        if total.any():
            squeeze = zstandard.ZstdCompressor(level=3).compress
            for s, own in enumerate(total.reshape(2 * segments, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([squeeze(own.tobytes())], pa.binary())], ["segment", "counts"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).astype(np.int64)
                found[s] = found[s] + own if s in found else own
        for s, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zstandard.ZstdCompressor().compress(np.minimum(own, 2**32 - 1).astype(np.uint32).tobytes())], pa.binary())], ["segment", "counts"])

    kinds = "segment int, counts binary"
    out = np.zeros((2 * segments, 1 << SEGMENT_BITS), np.uint32)
    for row in tree_merge(docs.mapInArrow(count, kinds), merge, 2 * segments, tasks(docs, SPLIT_BYTES)).collect():  # of fixed size
        out[row["segment"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["counts"])), np.uint32)
    return out.reshape(2, -1)


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set with any partner at the threshold."""
    return (size * percent + 99) // 100


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(_id, n, d1, d2, prefix) for each row: set size, digest and the prefix, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(counts_of(docs.select("_text"), k))  # of fixed size

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id")
            for at, part in chunks(batch.column("_text").to_pylist()):
                of, both, rare = shingle_sets(part, k, shared.value, (0, 1))
                h = both[0]
                n = np.bincount(of, minlength=len(part)).astype(np.int64)
                digests = []
                for own in both:
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(own ^ np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)))
                    ends = np.cumsum(n)
                    digests.append((sums[ends] - sums[ends - n]).view(np.int64))
                order = np.lexsort((h, rare, of))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(n > 0, n - _need(n, percent) + 1, 0)
                prefix = h[order][place < length[of]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(prefix))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(n), *map(pa.array, digests), lists], ["_id", "n", "d1", "d2", "prefix"])

    return docs.select("_id", "_text").mapInArrow(sign, "_id long, n long, d1 long, d2 long, prefix array<long>")


def _passes(na: Column, i: Column, nb: Column, j: Column, percent: int) -> Column:
    """Size and position filter; it holds for the first common shingle of every pair at the threshold."""
    overlap = ((na + nb) * percent + (99 + percent)) / (100 + percent)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - i, nb - j) >= F.floor(overlap))


def _wanted(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(_id, _packed): texts, compressed, whose id a filter of fixed size over the members holds; others never shuffle."""

    def place(ids: np.ndarray) -> np.ndarray:
        return (mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[place(np.asarray(batch.column(0)))] = True
        for s, own in enumerate(bits.reshape(-1, 1 << FILTER_SEGMENT)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zstandard.ZstdCompressor().compress(np.packbits(own).tobytes())], pa.binary())], ["segment", "bits"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
                found[s] = found[s] | own if s in found else own
        for s, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zstandard.ZstdCompressor().compress(own.tobytes())], pa.binary())], ["segment", "bits"])

    kinds = "segment int, bits binary"
    on = np.zeros((1 << (FILTER_BITS - FILTER_SEGMENT), 1 << (FILTER_SEGMENT - 3)), np.uint8)
    for row in tree_merge(members.select("_id").mapInArrow(mark, kinds), merge, len(on), tasks(members, SPLIT_BYTES)).collect():  # of fixed size
        on[row["segment"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["bits"])), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(on.reshape(-1))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = place(np.asarray(batch.column("_id")))
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([squeeze((x or "").encode()) for x in batch.column("_text").to_pylist()], pa.binary())], ["_id", "_packed"])

    return docs.where("_id is not null").select("_id", "_text").mapInArrow(keep, "_id long, _packed binary")


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int, cell: int = CELL) -> DataFrame:
    """The pairs (a, b) whose texts' sets reach the threshold."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_m"), F.expr(f"(count(1) + {cell - 1}) div {cell}").alias("_n"))
    counts = cut(counts)
    placed = join_back(pairs, counts, "a", pairs.count(), "_m").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), "_n")).alias("_cell"))
    members = placed.select("_cell", F.lit(0).alias("_side"), F.col("a").alias("_id")).distinct().unionByName(placed.select("_cell", F.lit(1).alias("_side"), F.col("b").alias("_id")))
    members = cut(members)
    cells = members.join(_wanted(docs, members), "_id").repartition(tasks(docs, TASK_BYTES), "_cell").sortWithinPartitions("_cell", "_side", "_id")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            side, ids = np.asarray(group.column("_side")), np.asarray(group.column("_id"))
            texts = [zstandard.ZstdDecompressor().decompress(x).decode() for x in group.column("_packed").to_pylist()]
            hubs: list[np.ndarray] = []
            out = []
            for at, part in chunks(texts):
                of, (h,), _ = shingle_sets(part, k, families=(2,))  # other hashes than those that made the pair
                ends = np.searchsorted(of, np.arange(len(part) + 1))
                for i in range(len(part)):
                    own = h[ends[i] : ends[i + 1]]
                    if side[at + i] == 0:
                        hubs.append(own)
                        continue
                    for hub in hubs:
                        if not len(hub):
                            continue
                        place = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                        both = int((hub[place] == own).sum())
                        if 100 * both >= percent * (len(hub) + len(own) - both) and both:
                            out.append(ids[at + i])
                            break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), ids[0])), pa.array(out, pa.int64())], ["a", "b"])

    return cells.mapInArrow(compare, "a long, b long")


def _crossed(rest: DataFrame, percent: int) -> DataFrame:
    """(ga, gb): the pairs of groups of one list, in different components, that pass the filters.

    A list is cut into blocks by size, so that partners are in one block or in neighbouring ones, and
    blocks into parts of about LIST_CELL groups, each of which meets all parts of its blocks in a task of its own.
    """
    step = math.log(100 / percent * 1.001)
    blocks = rest.withColumn("_block", F.floor(F.log(F.col("n").cast("double")) / step))
    counts = cut(blocks.groupBy("token", "_block").agg(F.expr(f"cast((count(1) + {LIST_CELL - 1}) div {LIST_CELL} as int)").alias("_parts")))
    # One row for each part of a block in counts: both sides of a list's block are dealt by it.
    dealt = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    few = counts.where("_parts > 1").select("token", "_block", "_parts")
    part = F.pmod(F.xxhash64("gid"), F.coalesce("_parts", F.lit(1))).cast("int")
    left = blocks.join(few, ["token", "_block"], "left").withColumn("_part", part).drop("_parts").alias("x")
    near = blocks.withColumn("_of", F.explode(F.array(F.col("_block"), F.col("_block") - 1)))
    right = near.join(dealt.select("token", F.col("_block").alias("_of"), "_part"), ["token", "_of"]).alias("y")
    apart = (F.col("x.lo") != F.col("y.lo")) | (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi"))
    once = (F.col("y._block") != F.col("x._block")) | (F.col("x.gid") < F.col("y.gid"))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x._block") == F.col("y._of")) & (F.col("x._part") == F.col("y._part"))
    pairs = left.join(right, same & once & apart & _passes(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent))
    return pairs.select(F.least("x.gid", "y.gid").alias("ga"), F.greatest("x.gid", "y.gid").alias("gb")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_shingles, component_id) for each row; components of documents linked at ``percent`` of Jaccard similarity."""
    rows = stable(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")))
    signed = cut(signatures(rows, k, percent))
    key = ["n", "d1", "d2"]
    classes = signed.where("n > 0 and _id is not null").groupBy(*key).agg(F.min("_id").alias("cid"), F.count(F.lit(1)).alias("copies"), F.first("prefix").alias("prefix"))
    classes = cut(classes.withColumn("_p1", F.xxhash64("prefix")).withColumn("_p2", F.hash("prefix")))
    group = ["n", "_p1", "_p2"]
    groups = classes.groupBy(*group).agg(F.min("cid").alias("gid"), F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("_classes"), F.first("prefix").alias("prefix"))
    groups = cut(groups)
    crowded = groups.where("_classes > 1").select(*group, "gid")
    others = cut(classes.select(*group, "cid").join(crowded, group).select("gid", "cid").where("gid != cid"))  # classes that do not lead their group
    posted = groups.select("gid", "n", "weight", F.posexplode("prefix").alias("pos", "token"))
    lead = F.max_by(F.struct("gid", "n", "pos"), F.struct(F.col("weight"), -F.col("gid")))
    shared = cut(posted.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))  # most tokens stand in one list only and end here
    total = groups.agg(F.sum(F.size("prefix"))).first()[0] or 0
    listed = cut(join_back(posted, shared, "token", total))
    leads = cut(listed.groupBy("token").agg(F.first("_n").alias("_n"), lead.alias("lead")))
    live = cut(join_back(listed.drop("_n"), leads, "token", listed.count()))

    stars = live.where(F.col("gid") != F.col("lead.gid")).where(_passes(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"), percent))
    stars = cut(stars.select(F.col("lead.gid").alias("a"), F.col("gid").alias("b")).unionByName(others.select(F.col("gid").alias("a"), F.col("cid").alias("b"))).distinct())
    links = cut(verify(rows, stars, k, percent))
    joined = cut(components(links))

    # What the stars left apart: groups of one list, and classes of one group, in different components.
    of = lambda frame, name, out: frame.join(joined.select(F.col("node").alias(name), F.col("component").alias("_c")), name, "left").withColumn(out, F.coalesce("_c", name)).drop("_c")
    member = cut(of(others.unionByName(live.select("gid").distinct().select("gid", F.col("gid").alias("cid"))).distinct(), "cid", "comp"))
    state = member.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    labelled = cut(live.select("token", "gid", "n", "pos").join(state, "gid"))
    open_lists = cut(labelled.groupBy("token").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo < _hi").select("token", "_n"))
    mixed = state.where("lo < hi").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    final, second = joined, []
    if not (open_lists.isEmpty() and mixed.isEmpty()):
        rest = cut(join_back(labelled, open_lists, "token", labelled.count()).drop("_n"))
        members = member.select("gid", "cid", "comp")
        expanded = _crossed(rest, percent).unionByName(mixed).join(members.toDF("ga", "a", "_ca"), "ga").join(members.toDF("gb", "b", "_cb"), "gb").where("_ca != _cb and (ga != gb or a < b)")
        open_pairs = expanded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = cut(open_pairs.join(tried, ["a", "b"], "left_anti"))
        more = cut(verify(rows, fresh, k, percent))
        final = cut(components(links.unionByName(more)))
        second = [rest, fresh, more, joined]
    for done in (groups, others, shared, listed, live, leads, stars, links, member, labelled, open_lists, *second):
        drop_cut(done)

    ids = classes.select(*key, "cid").join(final, F.col("cid") == F.col("node"), "left").select(*key, F.coalesce("component", "cid").alias("_component"))
    out = signed.select("_id", *key).join(ids, key, "left")
    found = out.select("_id", F.col("n").alias("n_shingles"), F.when(F.col("_id").isNull(), None).otherwise(F.coalesce("_component", "_id")).alias("component_id"))
    return found
