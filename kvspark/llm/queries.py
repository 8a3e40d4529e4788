"""The queries of the training-data operators: one for each, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.llm import ann, bpe, jaccard, license_scan, line_dedup, mixing, nn_descent, sharding, suffix_dedup, toxicity
from kvspark.llm.common import table


@cache
def rank_file() -> tuple[bytes, str]:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).select("_row.doc_id", "score", "predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = rank_file()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, decoded=True))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("identifiers").cast("long").alias("n_known_sentences"), F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("licenses")), ",").alias("licenses"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": op1_nn_descent,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_ann": op8_ann,
    "op9_license_scan": op9_license_scan,
    "op10_hilbert_shards": op10_hilbert_shards,
}

OP3_SQL = """
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (
  SELECT k, source_size, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS w FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, k) AS place,
         (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE ratio > level) AS final FROM l),
t AS (SELECT k, source_size, CASE WHEN final IS NULL OR ratio <= final THEN cap::DOUBLE ELSE w * final END AS target FROM f),
laid AS (
  SELECT doc_id, k, size, CAST(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM d)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (CAST(round(target) AS BIGINT) // source_size) + least(size, greatest(0, CAST(round(target) AS BIGINT) % source_size - start)) END AS taken
FROM laid JOIN t USING (k)
"""

# A table of CRC-32 and the checksum of a blob by it.
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(0, 256)) AS n))"


def crc(blob: str) -> str:
    values = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"


def _hilbert_sql(bits: int = 5, shards: int = 16) -> str:
    """Codes of equal depth, then the curve step by step, then shards of equal rows."""
    code = lambda c, col: f"""{c}n AS (SELECT coalesce('0' || {col}, '1') AS v, count(*) AS n FROM documents GROUP BY 1),
{c}c AS (SELECT v, CAST(least((2 * coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n) * {1 << bits} // (2 * sum(n) OVER ()), {(1 << bits) - 1}) AS INTEGER) AS code FROM {c}n)"""  # noqa: E731
    steps, last = [], "p0"
    for b in range(bits - 1, 0, -1):
        for i in range(3):
            q, low, t = 1 << b, (1 << b) - 1, f"(xor(x0, x{i}) & {(1 << b) - 1})"
            x = {j: f"x{j}" for j in range(3)}
            x[0] = f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {t}) END"
            if i:
                x[i] = f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {t}) END"
            name = f"p{len(steps) + 1}"
            steps.append(f"{name} AS (SELECT doc_id, size, c, {', '.join(f'{x[j]} AS x{j}' for j in range(3))} FROM {last})")
            last = name
    flips = " ".join(f"xor(CASE WHEN g2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END," for b in range(bits - 1, 1, -1)) + " CASE WHEN g2 & 2 <> 0 THEN 1 ELSE 0 END" + ")" * (bits - 2)
    curve = " + ".join(f"((xor(g{i}, f) >> {b}) & 1)::BIGINT * {1 << (3 * b + 2 - i)}" for b in range(bits) for i in range(3))
    return f"""WITH {CRC_TABLE}, {code('s', 'source')}, {code('l', 'lang')},
p0 AS (SELECT doc_id, size, c, CAST(least(length(bin(size)) - 1, {(1 << bits) - 1}) AS INTEGER) AS x0, sc.code AS x1, lc.code AS x2
       FROM (SELECT doc_id, coalesce('0' || source, '1') AS s, coalesce('0' || lang, '1') AS l, coalesce(strlen(text), 0) + 1 AS size, {crc("encode(coalesce(text, ''))")} AS c FROM documents, crc_table)
       JOIN sc ON sc.v = s JOIN lc ON lc.v = l),
{', '.join(steps)},
g AS (SELECT doc_id, size, c, x0 AS g0, xor(x0, x1) AS g1, xor(xor(x0, x1), x2) AS g2 FROM {last}),
f AS (SELECT *, {flips} AS f FROM g),
h AS (SELECT doc_id, size, c, {curve} AS curve FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, c) - 1 AS r, count(*) OVER () AS n FROM h)
SELECT doc_id, size, c AS text_crc32, 'rows' AS law, CAST(r * {shards} // n AS INTEGER) AS shard,
       r - (r * {shards} // n * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM r"""


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
m AS (SELECT key, min(id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(id) < max(id)),
j AS (SELECT k.*, coalesce(k.id > m.first, false) AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.x WHERE r.root < l.b),
c AS (SELECT x, min(root) AS component_id FROM r GROUP BY x),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON x = vec_id LEFT JOIN k ON a = vec_id
"""

OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.x WHERE r.root < e.b),
c AS (SELECT x, min(root) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN c ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

# Every window of 200 bytes, in hex, by its digest; runs of the windows that start elsewhere too.
OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
m AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
x AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM x),
s AS (SELECT r, g, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY r, g),
p AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS was FROM s),
k AS (SELECT r, string_agg(substr(h, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) AS front, max(hi) AS last, CAST(sum(hi - lo) AS BIGINT) AS gone, count(*) AS spans FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1, 2 * n))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_nn_descent": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op3_mixing": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op10_hilbert_shards": _hilbert_sql()}
