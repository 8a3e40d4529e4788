"""A training corpus in five stages; each takes (spark, docs, sf_dir) and works on all that its predecessor kept.

All stages but the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet
to the shared folder and reads them again as the next one's documents, so a lost executor costs the
current stage at most. Once a stage is written, the tables behind it are deleted.

Cases: null and empty texts pass all stages (a stage that changes no line leaves a null text null) until
the mix, which takes no words of them, so they go there; texts of any length are taken whole; rows repeated
with an id are judged alike: near-duplicate stages take them as one document, and the mix adds up what it
takes of them and gives each as many copies; rows with a null id are one such group; an empty table gives an
empty table; extra columns pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.llm import bpe, jaccard, line_dedup, mixing, toxicity
from kvspark.llm.common import cut, drop_cut, release, staged, table
from kvspark.llm.queries import rank_file

#: Near-duplicates: words in a shingle and least Jaccard similarity in percent.
SHINGLE, PERCENT = 5, 80


def _retexted(docs: DataFrame, done: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``done._row``, with another text and its number of characters."""
    was = F.col("_row").getField("text").isNotNull()
    changed = {"text": F.when(was, F.col(text)), "n_chars": F.when(was, F.length(text).cast("long")).otherwise(F.lit(0))}
    return done.select(*[changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that loses all its lines stays, empty."""
    return _retexted(docs, line_dedup.line_dedup(docs), "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, as do documents without words or id."""
    found = jaccard.jaccard_components(docs, SHINGLE, PERCENT)
    gone = found.where("_id != component_id").select(F.col("_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"))
    return rows.join(gone, F.col("_own") == F.col("_gone"), "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes their words, rounded, and once at least; those it does not reach go."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("_mixed")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_words")).where("_taken > 0")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"))
    joined = rows.join(taken, F.col("_own").eqNullSafe(F.col("_mixed")))
    times = F.greatest(F.lit(1), F.round(F.col("_taken") / F.col("_words")).cast("int"))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select("_row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the tokens of each row, and what they decode to."""
    ranks, pattern = rank_file()
    encoded = bpe.encode(docs, ranks, pattern, decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: A learned classifier decides in the first stage, which SQL cannot express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = staged()
        after = cut(stage(spark, docs, sf_dir))
        release(before, after)
        drop_cut(docs)
        docs = after
    return docs
