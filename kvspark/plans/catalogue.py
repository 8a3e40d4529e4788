"""The query catalogue: each query with the SQL that gives the same rows in another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.model import OPLOG as OPLOG_SCHEMA
from kvspark.model import RESERVED, Config
from kvspark.operators import compaction, integrity, scan, segments, traces, versions
from kvspark.operators.sketches import bloom, cms, hll, simhash
from kvspark.sources import oplog as logs
from kvspark.sources.tables import events_oplog, events_oplog2, padded, table
from kvspark.staging import shared_dir, staged_folder
from kvspark.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SEGMENT, THRESHOLD, LEVELS, EVERY = 512, 3, 4, 5
LOW, HIGH, KEY, DELETED, PREFIX = "user000010", "user000060", "user000042", "user000007", "user00001"

PAD = "lpad(CAST({0} AS VARCHAR), CAST(greatest(length(CAST({0} AS VARCHAR)), {1}) AS INTEGER), '0')"
OPLOG = "o AS (SELECT 'user' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(length(CAST(user_id AS VARCHAR)), 6) AS INTEGER), '0') AS key, event_type || '|' || props AS value, event_type = 'error' AS tombstone, ts, event_id AS seq FROM events)"
OPLOG2 = "o AS (SELECT 'user' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(length(CAST(user_id AS VARCHAR)), 6) AS INTEGER), '0') || ':' || event_type AS key, props AS value, event_id % 5 = 0 AS tombstone, ts, event_id AS seq FROM events)"
LWW = "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS r FROM o) WHERE r = 1)"
STATE = f"WITH {OPLOG}, {LWW}"
STATE2 = f"WITH {OPLOG2}, {LWW}"
FLUSHED = f"""g AS (SELECT seq // {SEGMENT} AS segment_id, * FROM o),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, key ORDER BY ts DESC, seq DESC) AS r FROM g) WHERE r = 1)"""
MANIFEST = "m AS (SELECT segment_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_records, count(*) FILTER (tombstone) AS n_tombstones FROM f GROUP BY segment_id)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- versions ---


@query("lww_state", f"{STATE} SELECT key, value, tombstone, seq FROM w")
def lww_state(spark, d):
    return versions.lww(events_oplog(spark, d)).select("key", "value", "tombstone", "seq")


@query("visible_state", f"{STATE} SELECT key, value, seq FROM w WHERE NOT tombstone")
def visible_state(spark, d):
    return versions.visible(events_oplog(spark, d)).select("key", "value", "seq")


@query("tombstone_state", f"{STATE} SELECT key, seq FROM w WHERE tombstone")
def tombstone_state(spark, d):
    return versions.lww(events_oplog(spark, d)).where("tombstone").select("key", "seq")


@query("version_count", f"WITH {OPLOG} SELECT key, count(*) AS n_versions, count(*) FILTER (tombstone) AS n_deletes FROM o GROUP BY key")
def version_count(spark, d):
    return events_oplog(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if("tombstone").alias("n_deletes"))


@query("version_rank", f"WITH {OPLOG} SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS version_rank FROM o")
def version_rank(spark, d):
    return versions.ranked(events_oplog(spark, d)).select("key", "seq", "version_rank")


@query("distinct_keys", f"WITH {OPLOG} SELECT count(DISTINCT key) AS n_keys, count(*) AS n_ops FROM o")
def distinct_keys(spark, d):
    return events_oplog(spark, d).agg(F.countDistinct("key").alias("n_keys"), F.count(F.lit(1)).alias("n_ops"))


@query("point_get", f"{STATE} SELECT key, value, seq FROM w WHERE NOT tombstone AND key = '{KEY}'")
def point_get(spark, d):
    return versions.get(events_oplog(spark, d), KEY).select("key", "value", "seq")


@query("point_get_deleted", f"{STATE} SELECT min(key) AS key, false AS present FROM w WHERE tombstone HAVING min(key) IS NOT NULL")
def point_get_deleted(spark, d):
    log = events_oplog(spark, d)
    first = versions.lww(log).where("tombstone").agg(F.min("key").alias("key"))
    return versions.exists(log, first.where("key is not null"))


KEYS = "k AS (SELECT DISTINCT 'user' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 6) AS INTEGER), '0') AS key FROM customer)"


def _keys(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("user"), padded(F.col("c_custkey"), 6)).alias("key"))


@query("multi_get", f"{STATE}, {KEYS} SELECT key, value, seq FROM w JOIN k USING (key) WHERE NOT tombstone")
def multi_get(spark, d):
    return versions.multi_get(events_oplog(spark, d), _keys(spark, d)).select("key", "value", "seq")


@query("missing_keys", f"{STATE}, {KEYS} SELECT key FROM k WHERE key NOT IN (SELECT key FROM w WHERE NOT tombstone)")
def missing_keys(spark, d):
    return versions.missing(events_oplog(spark, d), _keys(spark, d))


@query("exists_check", f"{STATE}, {KEYS} SELECT key, key IN (SELECT key FROM w WHERE NOT tombstone) AS present FROM k")
def exists_check(spark, d):
    return versions.exists(events_oplog(spark, d), _keys(spark, d))


@query("as_of_state", f"WITH h AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS t FROM events), {OPLOG.replace('FROM events', 'FROM events, h WHERE ts <= date_trunc(' + chr(39) + 'day' + chr(39) + ', t)')}, {LWW} SELECT key, value, seq FROM w WHERE NOT tombstone")
def as_of_state(spark, d):
    log = events_oplog(spark, d)
    bounds = table(spark, d, "events").agg(F.expr("date_trunc('day', cast(min(ts) AS timestamp) + (max(ts) - min(ts)) / 2)").alias("t")).first()["t"]
    return versions.as_of(log, F.lit(bounds).cast("timestamp_ntz")).select("key", "value", "seq")


# --- scans ---


@query("prefix_scan", f"{STATE} SELECT key, value FROM w WHERE NOT tombstone AND starts_with(key, '{PREFIX}')")
def prefix_scan(spark, d):
    return scan.prefix(events_oplog(spark, d), PREFIX).select("key", "value")


@query("prefix_scan_empty_prefix", f"{STATE2} SELECT key, value FROM w WHERE NOT tombstone")
def prefix_scan_empty_prefix(spark, d):
    return scan.prefix(events_oplog2(spark, d), "").select("key", "value")


@query("range_scan", f"{STATE2} SELECT key, value FROM w WHERE NOT tombstone AND key BETWEEN '{LOW}' AND '{HIGH}'")
def range_scan(spark, d):
    return scan.between(events_oplog2(spark, d), LOW, HIGH).select("key", "value")


@query("scan_page_1", f"{STATE2} SELECT key, value FROM w WHERE NOT tombstone AND key BETWEEN '{LOW}' AND '{HIGH}' ORDER BY key LIMIT 10")
def scan_page_1(spark, d):
    return scan.page(scan.between(events_oplog2(spark, d), LOW, HIGH), 10).select("key", "value")


@query("keyset_next_page", f"{STATE2} SELECT key, value FROM w WHERE NOT tombstone AND key BETWEEN '{LOW}' AND '{HIGH}' AND key > 'user000012:error' ORDER BY key LIMIT 10")
def keyset_next_page(spark, d):
    return scan.page(scan.between(events_oplog2(spark, d), LOW, HIGH), 10, "user000012:error").select("key", "value")


@query("scan_page_numbers", f"{STATE2} SELECT key, (row_number() OVER (ORDER BY key) - 1) // 10 AS page FROM w WHERE NOT tombstone AND key BETWEEN '{LOW}' AND '{HIGH}'")
def scan_page_numbers(spark, d):
    return scan.numbered(scan.between(events_oplog2(spark, d), LOW, HIGH), 10).select("key", "page")


@query("reserved_namespace_hidden", f"WITH {OPLOG.replace(' FROM events', f' FROM events UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN {chr(39)}{RESERVED}bf_{chr(39)} ELSE {chr(39)}u_{chr(39)} END || event_type, props, false, ts, event_id FROM events')}, {LWW} SELECT key, value FROM w WHERE NOT tombstone AND NOT starts_with(key, '{RESERVED}')")
def reserved_namespace_hidden(spark, d):
    own = table(spark, d, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, F.lit(f"{RESERVED}bf_")).otherwise(F.lit("u_")), "event_type").alias("key"), F.col("props").alias("value"), F.lit(False).alias("tombstone"), "ts", F.col("event_id").alias("seq"))
    return scan.prefix(events_oplog(spark, d).unionByName(own), "").select("key", "value")


@query("customer_prefix_scan", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def customer_prefix_scan(spark, d):
    log = table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(False).alias("tombstone"), F.col("c_custkey").alias("ts"), F.col("c_custkey").alias("seq"))
    return scan.prefix(log, "Customer#00000001").select("key", "value")


@query("pages_range_scan", "SELECT url AS key, max_by(html, page_id) AS value FROM pages WHERE url BETWEEN 'https://a' AND 'https://t' GROUP BY url")
def pages_range_scan(spark, d):
    log = table(spark, d, "pages").select(F.col("url").alias("key"), F.col("html").alias("value"), F.lit(False).alias("tombstone"), F.col("page_id").alias("ts"), F.col("page_id").alias("seq"))
    return scan.between(log, "https://a", "https://t").select("key", "value")


# --- the log ---


@query("log_dump", f"WITH {OPLOG} SELECT key, value, tombstone, seq FROM o")
def log_dump(spark, d):
    return events_oplog(spark, d).select("key", "value", "tombstone", "seq")


# The checksums' bytes in hex: flag, time, tombstone, both sizes, key and value.
PAYLOAD = "'00' || format('{:016X}', seq) || CASE WHEN tombstone THEN '01' ELSE '00' END || format('{:016X}', strlen(key)) || format('{:016X}', strlen(value)) || hex(encode(key)) || hex(encode(value))"
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(0, 256)) AS n))"


def _crc(hexed: str) -> str:
    """CRC-32 of bytes in hex, by the table."""
    values = f"list_transform(regexp_extract_all({hexed}, '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"


@query("wal_crc", f"WITH {OPLOG}, {CRC_TABLE} SELECT seq, {_crc(PAYLOAD)} AS crc FROM o, crc_table")
def wal_crc(spark, d):
    return logs.with_crc(events_oplog(spark, d).withColumn("ts", F.col("seq"))).select("seq", "crc")


@query("wal_replay_valid", f"WITH {OPLOG} SELECT key, value, tombstone, seq FROM o WHERE seq % 97 <> 0")
def wal_replay_valid(spark, d):
    log = logs.with_crc(events_oplog(spark, d).withColumn("ts", F.col("seq")))
    damaged = log.withColumn("crc", F.when(F.col("seq") % 97 == 0, F.col("crc") + 1).otherwise(F.col("crc")))
    return logs.valid(damaged).select("key", "value", "tombstone", "seq")


@query("wal_truncate", f"WITH {OPLOG} SELECT key, seq FROM o WHERE seq > 4095")
def wal_truncate(spark, d):
    return logs.after(events_oplog(spark, d), 4095).select("key", "seq")


# --- segments ---


def _flushed(spark, d):
    return segments.newest_in_segment(segments.assign(events_oplog(spark, d), SEGMENT))


@query("segment_assign", f"WITH {OPLOG} SELECT seq, seq // {SEGMENT} AS segment_id FROM o")
def segment_assign(spark, d):
    return segments.assign(events_oplog(spark, d), SEGMENT).select("seq", "segment_id")


@query("segment_flush", f"WITH {OPLOG}, {FLUSHED} SELECT segment_id, key, value, tombstone, seq FROM f")
def segment_flush(spark, d):
    return _flushed(spark, d).select("segment_id", "key", "value", "tombstone", "seq")


@query("manifest_stats", f"WITH {OPLOG}, {FLUSHED}, {MANIFEST} SELECT * FROM m")
def manifest_stats(spark, d):
    return segments.manifest(_flushed(spark, d))


@query("zone_prune_point", f"WITH {OPLOG}, {FLUSHED}, {MANIFEST} SELECT segment_id FROM m WHERE min_key <= '{KEY}' AND max_key >= '{KEY}'")
def zone_prune_point(spark, d):
    return segments.manifest(_flushed(spark, d)).where(segments.may_hold(KEY)).select("segment_id")


@query("zone_prune_range", f"WITH {OPLOG}, {FLUSHED}, {MANIFEST} SELECT segment_id FROM m WHERE min_key <= 'user000001' AND max_key >= 'user000000'")
def zone_prune_range(spark, d):
    return segments.manifest(_flushed(spark, d)).where(segments.may_hold("user000000", "user000001")).select("segment_id")


@query("zone_prune_prefix", f"WITH {OPLOG}, {FLUSHED}, {MANIFEST} SELECT segment_id FROM m WHERE max_key >= 'user0000' AND (min_key <= 'user0000' OR starts_with(min_key, 'user0000'))")
def zone_prune_prefix(spark, d):
    return segments.manifest(_flushed(spark, d)).where(segments.may_hold_prefix("user0000")).select("segment_id")


@query("level_get", f"WITH {OPLOG}, {FLUSHED} SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM f WHERE key = '{KEY}' AND segment_id < 8 GROUP BY key HAVING NOT arg_max(tombstone, seq)")
def level_get(spark, d):
    return versions.get(_flushed(spark, d).where("segment_id < 8"), KEY).select("key", "value", "seq")


@query("list_tables", f"WITH {OPLOG}, {FLUSHED}, {MANIFEST} SELECT 1 + segment_id % 2 AS level, segment_id, n_records FROM m WHERE segment_id % 2 = 0")
def list_tables(spark, d):
    found = segments.manifest(_flushed(spark, d)).withColumn("level", 1 + F.col("segment_id") % 2)
    return found.where("level = 1").select("level", "segment_id", "n_records")


@query("remove_tables", f"WITH {OPLOG}, {FLUSHED}, {MANIFEST} SELECT segment_id, n_records FROM m WHERE segment_id NOT IN (0, 3, 5)")
def remove_tables(spark, d):
    return segments.manifest(_flushed(spark, d)).where(~F.col("segment_id").isin(0, 3, 5)).select("segment_id", "n_records")


OFFSETS = f"b AS (SELECT *, CAST(coalesce(sum({segments.HEADER_BYTES} + strlen(key) + coalesce(strlen(value), 0)) OVER (PARTITION BY segment_id ORDER BY key, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM f)"
INDEX = f"i AS (SELECT segment_id, key, seq, byte_offset FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY key, seq) AS p, count(*) OVER (PARTITION BY segment_id) AS n FROM b) WHERE p % {EVERY} = 1 OR p = n)"


@query("byte_offsets", f"WITH {OPLOG}, {FLUSHED}, {OFFSETS} SELECT segment_id, key, seq, byte_offset FROM b")
def byte_offsets(spark, d):
    return segments.offsets(_flushed(spark, d)).select("segment_id", "key", "seq", "byte_offset")


def _index(spark, d):
    return segments.sparse(segments.offsets(_flushed(spark, d)), EVERY, ("key", "seq")).select("segment_id", "key", "seq", "byte_offset")


@query("sparse_index", f"WITH {OPLOG}, {FLUSHED}, {OFFSETS}, {INDEX} SELECT * FROM i")
def sparse_index(spark, d):
    return _index(spark, d)


@query("summary_index", f"WITH {OPLOG}, {FLUSHED}, {OFFSETS}, {INDEX} SELECT segment_id, key, seq, byte_offset FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY key, seq) AS p, count(*) OVER (PARTITION BY segment_id) AS n FROM i) WHERE p % {EVERY} = 1 OR p = n")
def summary_index(spark, d):
    return segments.sparse(_index(spark, d), EVERY, ("key", "seq"))


@query("lookup_offset", f"WITH {OPLOG}, {FLUSHED}, {OFFSETS}, {INDEX} SELECT segment_id, coalesce(arg_max(byte_offset, key) FILTER (key <= '{KEY}'), min(byte_offset)) AS start_offset FROM i GROUP BY segment_id")
def lookup_offset(spark, d):
    return segments.lookup_offset(_index(spark, d), KEY)


@query("varint_sizes", f"WITH {OPLOG} SELECT seq, CAST(greatest(1, ceil(length(bin(seq)) / 7.0)) AS INTEGER) AS seq_bytes FROM o")
def varint_sizes(spark, d):
    return events_oplog(spark, d).select("seq", segments.varint_bytes(F.col("seq")).alias("seq_bytes"))


@query("varint_coding", f"WITH {OPLOG}, n AS (SELECT seq, CAST(greatest(1, ceil(length(bin(seq)) / 7.0)) AS BIGINT) AS n FROM o) SELECT seq, array_to_string(list_transform(range(0, n), lambda i: format('{{:02X}}', (seq >> (7 * i)) % 128 + CASE WHEN i < n - 1 THEN 128 ELSE 0 END)), '') AS coded, seq AS decoded FROM n")
def varint_coding(spark, d):
    coded = events_oplog(spark, d).select("seq", segments.varint_encode(F.col("seq")).alias("coded"))
    return coded.withColumn("decoded", segments.varint_decode(F.col("coded")))


@query("next_segment_id", f"WITH {OPLOG} SELECT max(seq // {SEGMENT}) + 1 AS next_id FROM o")
def next_segment_id(spark, d):
    """From the digits in the names of the segments there are."""
    return segment_names(spark, d).agg((F.max(F.regexp_extract("name", r"(\d+)", 1).cast("long")) + 1).alias("next_id"))


@query("segment_names", f"WITH {OPLOG}, n AS (SELECT DISTINCT seq // {SEGMENT} AS id FROM o) SELECT 'wal_' || {PAD.format('id', 3)} || '.log' AS name, id + 1 AS next_id FROM n")
def segment_names(spark, d):
    ids = segments.assign(events_oplog(spark, d), SEGMENT).select("segment_id").distinct()
    name = F.concat(F.lit("wal_"), padded(F.col("segment_id"), 3), F.lit(".log"))
    return ids.select(name.alias("name"), (F.regexp_extract(name, r"(\d+)", 1).cast("long") + 1).alias("next_id"))


MEMTABLES, MEMTABLE_KEYS = 3, 2


@query("flush_generations", f"""WITH RECURSIVE {OPLOG}, {CRC_TABLE}, c AS (SELECT key, {_crc('hex(encode(key))')} % 64 AS shard FROM (SELECT DISTINCT key FROM o), crc_table),
t AS (SELECT shard, seq, key, row_number() OVER (PARTITION BY shard ORDER BY seq) AS r FROM o JOIN c USING (key)),
b AS (SELECT shard, seq, key, r, [key] AS keys, 0::BIGINT AS generation FROM t WHERE r = 1
UNION ALL SELECT t.shard, t.seq, t.key, t.r, CASE WHEN len(keys) >= {MEMTABLE_KEYS} THEN [t.key] WHEN list_contains(keys, t.key) THEN keys ELSE list_append(keys, t.key) END, generation + CASE WHEN len(keys) >= {MEMTABLE_KEYS} THEN 1 ELSE 0 END FROM b JOIN t ON t.shard = b.shard AND t.r = b.r + 1),
n AS (SELECT shard, count(*) FILTER (k >= {MEMTABLE_KEYS}) AS n FROM (SELECT shard, generation, count(DISTINCT key) AS k FROM b GROUP BY ALL) GROUP BY shard)
SELECT seq, key, generation, generation < n - {MEMTABLES - 1} AS flushed FROM b JOIN n USING (shard)""")
def flush_generations(spark, d):
    sharded = events_oplog(spark, d).withColumn("shard", F.crc32(F.col("key").cast("binary")) % 64)
    return segments.generations(sharded, "shard", MEMTABLE_KEYS, MEMTABLES)


# --- compaction ---


@query("merge_runs", f"{STATE} SELECT key, value, tombstone, seq FROM w")
def merge_runs(spark, d):
    return compaction.merge(_flushed(spark, d)).select("key", "value", "tombstone", "seq")


COUNTS = [(c, *x) for c in range(1, 41) for x in compaction.tiered_counts(c, THRESHOLD, LEVELS)]


@query("size_tiered_counts", f"WITH c AS (SELECT unnest(range(1, 41)) AS flushes) SELECT flushes, level, CASE WHEN level < {LEVELS - 1} THEN flushes // CAST(pow({THRESHOLD}, level - 1) AS BIGINT) % {THRESHOLD} ELSE flushes // CAST(pow({THRESHOLD}, level - 1) AS BIGINT) END AS tables FROM c, (SELECT unnest(range(1, {LEVELS})) AS level)")
def size_tiered_counts(spark, d):
    return spark.createDataFrame(COUNTS, "flushes long, level long, tables long")


def _tiered(spark, d):
    log = segments.assign(events_oplog(spark, d), SEGMENT)
    flushes = log.agg(F.max("segment_id")).first()[0] + 1
    level, number = compaction.tiered_level(F.col("segment_id"), flushes, THRESHOLD, LEVELS)
    return compaction.merge_tables(log.withColumn("level", level).withColumn("table_no", number))


TIERED = f"""{OPLOG}, g AS (SELECT seq // {SEGMENT} AS s, (SELECT max(seq) // {SEGMENT} + 1 FROM o) AS c, * FROM o),
h AS (SELECT *, c // 9 * 9 AS d3, c // 3 * 3 AS d2 FROM g),
t AS (SELECT CASE WHEN s < d3 THEN 3 WHEN s < d2 THEN 2 ELSE 1 END AS level, CASE WHEN s < d3 THEN s // 9 WHEN s < d2 THEN (s - d3) // 3 ELSE s - d2 END AS table_no, * FROM h),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, table_no, key ORDER BY ts DESC, seq DESC) AS r FROM t) WHERE r = 1)"""


@query("size_tiered_state", f"WITH {TIERED} SELECT level, CAST(table_no AS BIGINT) AS table_no, count(*) AS n_records, count(*) FILTER (tombstone) AS n_tombstones, min(key) AS min_key, max(key) AS max_key FROM n GROUP BY level, table_no")
def size_tiered_state(spark, d):
    merged = _tiered(spark, d)
    return merged.groupBy("level", F.col("table_no").cast("long").alias("table_no")).agg(F.count(F.lit(1)).alias("n_records"), F.count_if("tombstone").alias("n_tombstones"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query("compaction_preserves_visible", f"{STATE} SELECT key, value, seq FROM w WHERE NOT tombstone")
def compaction_preserves_visible(spark, d):
    """What the compacted tables show is what the log shows."""
    return versions.visible(_tiered(spark, d)).select("key", "value", "seq")


NARROW = f"""WITH o AS (SELECT 'p' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(length(CAST(l_partkey AS VARCHAR)), 8) AS INTEGER), '0') AS key, l_returnflag AS value, l_returnflag = 'R' AS tombstone, l_orderkey * 8 + l_linenumber AS ts, l_orderkey * 8 + l_linenumber AS seq FROM lineitem),
f AS (SELECT seq // 64 AS segment_id, * FROM o), {MANIFEST}, q AS (SELECT *, 1 + segment_id % 2 AS level FROM m),
x AS (SELECT * FROM q WHERE level = 1 ORDER BY segment_id LIMIT 1)"""


def _narrow(spark, d):
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    log = table(spark, d, "lineitem").select(F.concat(F.lit("p"), padded(F.col("l_partkey"), 8)).alias("key"), F.col("l_returnflag").alias("value"), (F.col("l_returnflag") == "R").alias("tombstone"), seq.alias("ts"), seq.alias("seq"))
    return segments.assign(log, 64)


@query("leveled_overlap", f"{NARROW} SELECT x.segment_id AS upper, q.segment_id AS lower FROM q, x WHERE q.level = 2 AND q.min_key <= x.max_key AND x.min_key <= q.max_key")
def leveled_overlap(spark, d):
    found = segments.manifest(_narrow(spark, d)).withColumn("level", 1 + F.col("segment_id") % 2)
    return compaction.overlapping(found, 1)


@query("leveled_state", f"""{NARROW}, z AS (SELECT x.segment_id FROM x UNION ALL SELECT q.segment_id FROM q, x WHERE q.level = 2 AND q.min_key <= x.max_key AND x.min_key <= q.max_key)
SELECT key, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone, max(seq) AS seq FROM f WHERE segment_id IN (SELECT segment_id FROM z) GROUP BY key""")
def leveled_state(spark, d):
    rows = _narrow(spark, d)
    pairs = compaction.overlapping(segments.manifest(rows).withColumn("level", 1 + F.col("segment_id") % 2), 1)
    chosen = pairs.select(F.col("lower").alias("segment_id")).unionByName(pairs.select(F.col("upper").alias("segment_id"))).distinct()
    return compaction.merge(rows.join(chosen, "segment_id", "left_semi")).select("key", "value", "tombstone", "seq")


@query("compaction_gc", f"{STATE} SELECT key, value, seq FROM w WHERE NOT tombstone")
def compaction_gc(spark, d):
    return compaction.merge(_flushed(spark, d), gc=True).select("key", "value", "seq")


@query("level_limits", "SELECT level, CAST(pow(10, level) AS BIGINT) AS tables FROM (SELECT unnest(range(1, 8)) AS level)")
def level_limits(spark, d):
    levels = spark.range(1, 8).select(F.col("id").alias("level"))
    return levels.select("level", compaction.level_limit(F.col("level"), 10).alias("tables"))


# --- the store: tables on levels and the live log ---

LIVE = 100  # operations that are not flushed
STORE = Config(segment_ops=2048, memtables=1000, memtable_keys=50, tables_per_level=2)


def _store(spark, d) -> Store:
    """A store with all operations in tables but the last ones, which are in its log."""
    log = events_oplog(spark, d).withColumn("ts", F.col("seq"))
    last = log.agg(F.max("seq")).first()[0]
    store = Store(spark, f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}", STORE)
    staged_folder(spark, store.path)
    store.load(log.where(F.col("seq") <= last - LIVE))
    logs.append(log.where(F.col("seq") > last - LIVE).select(*OPLOG_SCHEMA.names), store.log_path)
    store._count()
    return store


BYSEQ = f"WITH {OPLOG}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM o) WHERE r = 1)"


@query("flushed_and_live_scan", f"{BYSEQ} SELECT key, value FROM w WHERE NOT tombstone AND key BETWEEN '{LOW}' AND '{HIGH}'")
def flushed_and_live_scan(spark, d):
    return _store(spark, d).scan_range(LOW, HIGH)


@query("unflushed_dump", f"WITH {OPLOG}, l AS (SELECT * FROM o WHERE seq > (SELECT max(seq) FROM o) - {LIVE}), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM l) SELECT key, value, tombstone, seq FROM w WHERE r = 1")
def unflushed_dump(spark, d):
    return versions.lww(_store(spark, d).dump_memtables().select(*OPLOG_SCHEMA.names)).select("key", "value", "tombstone", "seq")


@query("store_wal_rewrite", f"WITH {OPLOG} SELECT key, seq FROM o WHERE seq > (SELECT max(seq) FROM o) - {LIVE}")
def store_wal_rewrite(spark, d):
    """What the log still holds once the rest is flushed."""
    return _store(spark, d).dump_log().select("key", "seq")


@query("store_compacted_scan", f"{BYSEQ} SELECT key, value FROM w WHERE NOT tombstone")
def store_compacted_scan(spark, d):
    store = _store(spark, d)
    store.flush()
    store.compact_size_tiered()
    return store.scan_prefix("")


@query("store_levels", f"WITH {OPLOG}, n AS (SELECT count(DISTINCT seq // {STORE.segment_ops}) AS n FROM o WHERE seq <= (SELECT max(seq) FROM o) - {LIVE}) SELECT CASE WHEN n >= 2 THEN 2 ELSE 1 END AS level, CASE WHEN n >= 2 THEN 1 ELSE n END AS tables FROM n")
def store_levels(spark, d):
    """A level that has enough tables becomes one table of the next."""
    store = _store(spark, d)
    store.compact_size_tiered()
    return store.tables().groupBy("level").agg(F.count(F.lit(1)).alias("tables"))


@query("store_validate", f"WITH {OPLOG} SELECT DISTINCT seq // {STORE.segment_ops} - (SELECT min(seq) // {STORE.segment_ops} FROM o) AS table_id, true AS ok FROM o WHERE seq <= (SELECT max(seq) FROM o) - {LIVE}")
def store_validate(spark, d):
    return _store(spark, d).validate()


# --- integrity ---

LEAVES = f"{OPLOG}, {FLUSHED}, v AS (SELECT segment_id, CAST(row_number() OVER (PARTITION BY segment_id ORDER BY key, seq) - 1 AS INTEGER) AS leaf_idx, sha256(coalesce(value, '')) AS leaf FROM f)"
CHANGED = f"u AS (SELECT segment_id, CAST(row_number() OVER (PARTITION BY segment_id ORDER BY key, seq) - 1 AS INTEGER) AS leaf_idx, sha256(CASE WHEN seq % 101 = 0 THEN 'changed' ELSE coalesce(value, '') END) AS leaf FROM f)"
TREE = """RECURSIVE_TREE AS (SELECT segment_id, 0 AS lvl, leaf_idx AS idx, leaf AS h, count(*) OVER (PARTITION BY segment_id) AS n FROM v
UNION ALL SELECT segment_id, lvl + 1, idx // 2, sha256(h || coalesce(nh, h)), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY segment_id ORDER BY idx) AS nh FROM RECURSIVE_TREE WHERE n > 1) WHERE idx % 2 = 0)"""


@query("merkle_leaves", f"WITH {LEAVES} SELECT * FROM v")
def merkle_leaves(spark, d):
    return integrity.leaves(_flushed(spark, d))


@query("merkle_root", f"WITH RECURSIVE {LEAVES}, {TREE} SELECT segment_id, CAST((SELECT count(*) FROM v WHERE v.segment_id = t.segment_id) AS INTEGER) AS n_leaves, h AS merkle_root FROM RECURSIVE_TREE t WHERE n = 1")
def merkle_root(spark, d):
    return integrity.roots(integrity.leaves(_flushed(spark, d)))


@query("merkle_diff", f"WITH {LEAVES}, {CHANGED}, a AS (SELECT * FROM v WHERE NOT (segment_id % 7 = 1 AND leaf_idx = 3)), b AS (SELECT * FROM u WHERE NOT (segment_id % 5 = 2 AND leaf_idx = 4)) SELECT segment_id, leaf_idx, CASE WHEN a.leaf IS NULL THEN 'ADDED' WHEN b.leaf IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM a FULL JOIN b USING (segment_id, leaf_idx) WHERE a.leaf IS DISTINCT FROM b.leaf")
def merkle_diff(spark, d):
    rows = _flushed(spark, d)
    before = integrity.leaves(rows).where("not (segment_id % 7 = 1 and leaf_idx = 3)")
    now = integrity.leaves(rows.withColumn("value", F.when(F.col("seq") % 101 == 0, F.lit("changed")).otherwise(F.col("value")))).where("not (segment_id % 5 = 2 and leaf_idx = 4)")
    return integrity.differences(before, now)


@query("merkle_proof_check", f"WITH {LEAVES}, {CHANGED} SELECT segment_id, leaf_idx, u.leaf = v.leaf AS verified FROM u JOIN v USING (segment_id, leaf_idx)")
def merkle_proof_check(spark, d):
    """Leaves of records of which some were changed, against the tree of the records as they were."""
    rows = _flushed(spark, d)
    changed = rows.withColumn("value", F.when(F.col("seq") % 101 == 0, F.lit("changed")).otherwise(F.col("value")))
    return integrity.proofs(integrity.leaves(rows), integrity.leaves(changed)).select("segment_id", "leaf_idx", "verified")


@query("validate_level", f"WITH {OPLOG}, {FLUSHED} SELECT segment_id, count(*) FILTER (seq % 1009 = 0 AND value IS DISTINCT FROM 'changed') = 0 AS ok FROM f GROUP BY segment_id")
def validate_level(spark, d):
    rows = _flushed(spark, d)
    stored = integrity.roots(integrity.leaves(rows)).select("segment_id", "merkle_root")
    return integrity.validate(stored, rows.withColumn("value", F.when(F.col("seq") % 1009 == 0, F.lit("changed")).otherwise(F.col("value"))))


# --- Bloom filters ---


def _h(x: str, part: int = 0) -> str:
    return f"CAST('0x' || substr(md5({x}), {8 * part + 1}, 8) AS BIGINT)"


PARAMETERS = [(20, 0.05), (10, 0.1), (1000, 0.01), (2, 0.01)]


@query("bloom_params", "WITH x AS (SELECT * FROM (VALUES (20, 0.05::DOUBLE), (10, 0.1::DOUBLE), (1000, 0.01::DOUBLE), (2, 0.01::DOUBLE)) AS t(n, p)), y AS (SELECT n, p, CAST(ceil(-n * ln(p) / (ln(2) * ln(2))) AS BIGINT) AS m FROM x) SELECT CAST(n AS BIGINT) AS n, p, m, CAST(greatest(1, round(m / n * ln(2))) AS BIGINT) AS k FROM y")
def bloom_params(spark, d):
    return spark.createDataFrame([(n, p, *bloom.parameters(n, p)) for n, p in PARAMETERS], "n long, p double, m long, k long")


BLOOM_M, BLOOM_K = bloom.parameters(2000, 0.01)
BITS = f"bits AS (SELECT DISTINCT ({_h('x')} + i * {_h('x', 1)}) % {BLOOM_M} AS bit FROM (SELECT CAST(p_partkey AS VARCHAR) AS x FROM part WHERE p_partkey % 2 = 0), (SELECT unnest(range(0, {BLOOM_K})) AS i))"
PROBE = f"pr AS (SELECT x, bool_and(({_h('x')} + i * {_h('x', 1)}) % {BLOOM_M} IN (SELECT bit FROM bits)) AS maybe FROM (SELECT CAST(p_partkey AS VARCHAR) AS x FROM part), (SELECT unnest(range(0, {BLOOM_K})) AS i) GROUP BY x)"


def _bits(spark, d):
    return bloom.build(table(spark, d, "part").where("p_partkey % 2 = 0"), "p_partkey", BLOOM_M, BLOOM_K)


@query("bloom_bits", f"WITH {BITS} SELECT bit FROM bits")
def bloom_bits(spark, d):
    return _bits(spark, d)


@query("bloom_probe", f"WITH {BITS}, {PROBE} SELECT x AS p_partkey, maybe FROM pr")
def bloom_probe(spark, d):
    return bloom.probe(table(spark, d, "part"), "p_partkey", _bits(spark, d), BLOOM_M, BLOOM_K)


@query("bloom_fpr", f"WITH {BITS}, {PROBE} SELECT count(*) AS n_absent, count(*) FILTER (maybe) AS n_false, count(*) FILTER (maybe) / count(*) AS rate FROM pr WHERE CAST(x AS BIGINT) % 2 = 1")
def bloom_fpr(spark, d):
    absent = bloom.probe(table(spark, d, "part"), "p_partkey", _bits(spark, d), BLOOM_M, BLOOM_K).where("cast(p_partkey AS bigint) % 2 = 1")
    return absent.agg(F.count(F.lit(1)).alias("n_absent"), F.count_if("maybe").alias("n_false"), (F.count_if("maybe") / F.count(F.lit(1))).alias("rate"))


SEGMENT_M, SEGMENT_K = bloom.parameters(SEGMENT, 0.01)
SEGMENT_BITS = f"sb AS (SELECT DISTINCT segment_id, ({{h0}} + i * {{h1}}) % {SEGMENT_M} AS bit FROM f, (SELECT unnest(range(0, {SEGMENT_K})) AS i))".format(h0=_h("key"), h1=_h("key", 1))
KEY_BITS = f"kb AS (SELECT DISTINCT ({{h0}} + i * {{h1}}) % {SEGMENT_M} AS bit FROM (SELECT '{KEY}' AS x), (SELECT unnest(range(0, {SEGMENT_K})) AS i))".format(h0=_h("x"), h1=_h("x", 1))


@query("bloom_prune_segments", f"WITH {OPLOG}, {FLUSHED}, {MANIFEST}, {SEGMENT_BITS}, {KEY_BITS} SELECT segment_id, min_key <= '{KEY}' AND max_key >= '{KEY}' AS in_range, (SELECT count(*) FROM sb JOIN kb USING (bit) WHERE sb.segment_id = m.segment_id) = (SELECT count(*) FROM kb) AS maybe FROM m")
def bloom_prune_segments(spark, d):
    """Which segments a lookup opens: those whose range and whose Bloom filter admit the key."""
    rows = _flushed(spark, d)
    filters = rows.select("segment_id", F.explode(bloom.positions(F.col("key"), SEGMENT_M, SEGMENT_K)).alias("bit")).distinct()
    wanted = spark.range(1).select(F.explode(F.array_distinct(bloom.positions(F.lit(KEY), SEGMENT_M, SEGMENT_K))).alias("bit"))
    on = filters.join(F.broadcast(wanted), "bit").groupBy("segment_id").agg(F.count(F.lit(1)).alias("_on"))  # as many rows as hash functions
    need = F.size(F.array_distinct(bloom.positions(F.lit(KEY), SEGMENT_M, SEGMENT_K)))
    found = segments.manifest(rows).select("segment_id", segments.may_hold(KEY).alias("in_range"))
    return found.join(on, "segment_id", "left").select("segment_id", "in_range", (F.coalesce("_on", F.lit(0)) == need).alias("maybe"))


@query("bloom_merge", f"WITH {BITS.replace('WHERE p_partkey % 2 = 0', '')} SELECT bit FROM bits")
def bloom_merge(spark, d):
    return bloom.merge(_bits(spark, d), bloom.build(table(spark, d, "part").where("p_partkey % 2 = 1"), "p_partkey", BLOOM_M, BLOOM_K))


@query("bloom_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def bloom_semi_join(spark, d):
    return bloom.semi_join(table(spark, d, "lineitem"), table(spark, d, "part").where("p_size < 5"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


@query("plain_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def plain_semi_join(spark, d):
    """The same without the filter, for comparison."""
    keys = table(spark, d, "part").where("p_size < 5").select("p_partkey")
    return table(spark, d, "lineitem").join(keys, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


# --- Count-Min ---

CMS_M, CMS_K = cms.parameters(0.01, 0.01)
CMS_CELL = f"CAST('0x' || substr(md5(r || ':' || x), 1, 8) AS BIGINT) % {CMS_M}"
CMS = f"""cr AS (SELECT CAST(unnest(range(0, {CMS_K})) AS INTEGER) AS r), cx AS (SELECT CAST(l_partkey AS VARCHAR) AS x, count(*) AS n FROM lineitem GROUP BY ALL),
ct AS (SELECT r AS row, {CMS_CELL} AS col, CAST(sum(n) AS BIGINT) AS cnt FROM cx, cr GROUP BY ALL),
ce AS (SELECT x, n, min(cnt) AS estimate FROM (SELECT x, n, r, {CMS_CELL} AS c FROM cx, cr) JOIN ct ON row = r AND col = c GROUP BY x, n)"""


def _cms(spark, d):
    return cms.build(table(spark, d, "lineitem"), "l_partkey", CMS_M, CMS_K)


@query("cms_params", "SELECT e AS epsilon, d AS delta, CAST(ceil(exp(1) / e) AS BIGINT) AS m, CAST(ceil(ln(exp(1) / d)) AS BIGINT) AS k FROM (VALUES (0.01::DOUBLE, 0.01::DOUBLE), (0.001::DOUBLE, 0.01::DOUBLE)) AS t(e, d)")
def cms_params(spark, d):
    return spark.createDataFrame([(e, x, *cms.parameters(e, x)) for e, x in ((0.01, 0.01), (0.001, 0.01))], "epsilon double, delta double, m long, k long")


@query("cms_table", f"WITH {CMS} SELECT row, col, cnt FROM ct")
def cms_table(spark, d):
    return _cms(spark, d)


@query("cms_point", f"WITH {CMS} SELECT x AS p_partkey, coalesce(estimate, 0) AS estimate FROM ce")
def cms_point(spark, d):
    wanted = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return cms.query(wanted, "p_partkey", _cms(spark, d), CMS_M, CMS_K)


@query("cms_topn", f"WITH {CMS} SELECT x AS l_partkey, estimate FROM ce ORDER BY estimate DESC, x LIMIT 10")
def cms_topn(spark, d):
    return cms.top(table(spark, d, "lineitem"), "l_partkey", _cms(spark, d), CMS_M, CMS_K, 10)


@query("cms_error", f"WITH {CMS} SELECT CAST(max(estimate - n) AS BIGINT) AS worst, count(*) FILTER (estimate < n) AS n_under FROM ce")
def cms_error(spark, d):
    true = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("l_partkey")).agg(F.count(F.lit(1)).alias("n"))
    both = cms.query(table(spark, d, "lineitem"), "l_partkey", _cms(spark, d), CMS_M, CMS_K).join(true, "l_partkey")
    return both.agg(F.max(F.col("estimate") - F.col("n")).alias("worst"), F.count_if(F.col("estimate") < F.col("n")).alias("n_under"))


@query("cms_merge", f"WITH {CMS} SELECT row, col, cnt FROM ct")
def cms_merge(spark, d):
    rows = table(spark, d, "lineitem")
    return cms.merge(*[cms.build(rows.where(f"l_linenumber % 2 = {k}"), "l_partkey", CMS_M, CMS_K) for k in (0, 1)])


# --- HyperLogLog ---


def _regs(p: int, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"hh AS (SELECT {g}{_h('CAST(l_partkey AS VARCHAR)')} AS h FROM lineitem), rg AS (SELECT {g}CAST(h >> {32 - p} AS INTEGER) AS reg, CAST(max(CASE WHEN h = 0 THEN 33 ELSE bit_count((h & -h) - 1) + 1 END) AS INTEGER) AS rank FROM hh GROUP BY ALL)"


def _estimate(p: int, by: str = "") -> str:
    g, m, a = (f"{by}, " if by else ""), 1 << p, hll.alpha(p)
    return f"""es AS (SELECT {g}sum(pow(2.0::DOUBLE, -rank)) AS s, {m} - count(*) AS empty FROM rg {f'GROUP BY {by}' if by else ''}),
er AS (SELECT *, {a * m * m!r}::DOUBLE / (coalesce(s, 0) + empty) AS raw FROM es)
SELECT {g}CAST(floor(CASE WHEN empty > 0 AND raw <= {5 * m} THEN {m}::DOUBLE * ln({m}::DOUBLE / empty) WHEN raw > {2.0**32 / 30!r} THEN -4294967296::DOUBLE * ln(1 - raw / 4294967296::DOUBLE) ELSE raw END) AS BIGINT) AS estimate FROM er"""


@query("hll_registers", f"WITH {_regs(10)} SELECT reg, rank FROM rg")
def hll_registers(spark, d):
    return hll.registers(table(spark, d, "lineitem"), "l_partkey", 10)


def _hll_query(p: int) -> Query:
    return lambda spark, d: hll.estimate(hll.registers(table(spark, d, "lineitem"), "l_partkey", p), p)


for _p in (4, 10, 14):
    query(f"hll_estimate_p{_p}", f"WITH {_regs(_p)}, {_estimate(_p)}")(_hll_query(_p))


@query("hll_by_group", f"WITH {_regs(10, 'l_returnflag')}, {_estimate(10, 'l_returnflag')}")
def hll_by_group(spark, d):
    return hll.estimate(hll.registers(table(spark, d, "lineitem"), "l_partkey", 10, ("l_returnflag",)), 10, ("l_returnflag",))


@query("hll_merge", f"WITH {_regs(12)}, {_estimate(12)}")
def hll_merge(spark, d):
    rows = table(spark, d, "lineitem")
    return hll.estimate(hll.merge(*[hll.registers(rows.where(f"l_linenumber % 3 = {k}"), "l_partkey", 12) for k in range(3)]), 12)


# --- SimHash ---

STOPPED = ", ".join(f"'{w}'" for w in sorted(set(simhash.STOP_WORDS)))
TOKENS = f"tk AS (SELECT doc_id, w FROM (SELECT doc_id, upper(x) AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9]+')) AS x FROM documents)) WHERE w <> '' AND w NOT IN ({STOPPED}))"
PRINTS = f"""{TOKENS}, tf AS (SELECT doc_id, w, count(*) AS n FROM tk GROUP BY ALL), th AS (SELECT doc_id, n, {_h('w')} AS h0, {_h('w', 1)} AS h1 FROM tf), ta AS (SELECT doc_id, sum(n) AS a FROM tf GROUP BY doc_id),
tb AS (SELECT doc_id, b, sum(n * ((h0 >> b) & 1)) AS c0, sum(n * ((h1 >> b) & 1)) AS c1 FROM th, (SELECT unnest(range(0, 32)) AS b) GROUP BY ALL),
tp AS (SELECT doc_id, CAST(sum(CASE WHEN 2 * c0 > a THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN 2 * c1 > a THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS lo FROM tb JOIN ta USING (doc_id) GROUP BY doc_id),
fp AS (SELECT doc_id, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM documents LEFT JOIN tp USING (doc_id))"""
HEX = "lower(printf('%08x%08x', {0}hi, {0}lo))"


def _prints(spark, d):
    return simhash.fingerprints(table(spark, d, "documents"), "doc_id", "text")


@query("simhash_tokens", f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM tk GROUP BY doc_id")
def simhash_tokens(spark, d):
    return simhash.token_counts(table(spark, d, "documents"), "doc_id", "text")


@query("simhash_fingerprint", f"WITH {PRINTS} SELECT doc_id, {HEX.format('')} AS fingerprint FROM fp")
def simhash_fingerprint(spark, d):
    return _prints(spark, d).select("doc_id", simhash.hexed().alias("fingerprint"))


@query("hamming_pairs", f"WITH {PRINTS} SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM fp a JOIN fp b ON b.doc_id = a.doc_id + 1")
def hamming_pairs(spark, d):
    prints = _prints(spark, d)
    a = prints.select(F.col("doc_id").alias("a"), F.col("hi").alias("ahi"), F.col("lo").alias("alo"), (F.col("doc_id") + 1).alias("b"))
    b = prints.select(F.col("doc_id").alias("b"), F.col("hi").alias("bhi"), F.col("lo").alias("blo"))
    return a.join(b, "b").select("a", "b", simhash.hamming(F.col("ahi"), F.col("alo"), F.col("bhi"), F.col("blo")).cast("int").alias("distance"))


@query("near_fingerprints", f"WITH {PRINTS}, dp AS (SELECT hi, lo, count(*) AS n FROM fp GROUP BY ALL) SELECT {HEX.format('a.')} AS a, {HEX.format('b.')} AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance, a.n AS n_a, b.n AS n_b FROM dp a JOIN dp b ON (a.hi < b.hi OR (a.hi = b.hi AND a.lo < b.lo)) AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3")
def near_fingerprints(spark, d):
    return simhash.near(_prints(spark, d), 3)


# --- traces ---

CACHE = 40
LRU = f"""WITH t AS (SELECT event_type, event_id, CAST(user_id AS VARCHAR) AS user_id, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS prev FROM events),
s AS (SELECT t.event_type, t.event_id, t.user_id, t.prev IS NOT NULL AND (SELECT count(DISTINCT u.user_id) FROM t u WHERE u.event_type = t.event_type AND u.event_id > t.prev AND u.event_id < t.event_id) < {CACHE} AS hit FROM t)"""


@query("lru_trace", f"{LRU} SELECT * FROM s")
def lru_trace(spark, d):
    return traces.lru(table(spark, d, "events"), "event_type", "user_id", "event_id", CACHE)


@query("lru_hit_rate", f"{LRU} SELECT event_type, count(*) AS n, count(*) FILTER (hit) AS hits FROM s GROUP BY event_type")
def lru_hit_rate(spark, d):
    return lru_trace(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


TOKENS_MAX, INTERVAL = 3, 20 * 86400
BUCKET = f"""WITH RECURSIVE t AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS r FROM events),
b AS (SELECT user_id, event_id, r, s AS last, true AS allowed, {TOKENS_MAX - 1} AS tokens_left FROM t WHERE r = 1
UNION ALL SELECT t.user_id, t.event_id, t.r, CASE WHEN t.s - last >= {INTERVAL} THEN t.s ELSE last END, t.s - last >= {INTERVAL} OR tokens_left > 0, CASE WHEN t.s - last >= {INTERVAL} THEN {TOKENS_MAX - 1} ELSE greatest(tokens_left - 1, 0) END FROM b JOIN t ON t.user_id = b.user_id AND t.r = b.r + 1)"""


def _bucket(spark, d):
    requests = table(spark, d, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    return traces.token_bucket(requests, "user_id", "s", "event_id", TOKENS_MAX, INTERVAL)


@query("token_bucket_decisions", f"{BUCKET} SELECT user_id, event_id, allowed, CAST(tokens_left AS BIGINT) AS tokens_left FROM b")
def token_bucket_decisions(spark, d):
    return _bucket(spark, d)


@query("token_bucket_summary", f"{BUCKET} SELECT user_id, count(*) AS n, count(*) FILTER (allowed) AS n_allowed FROM b GROUP BY user_id")
def token_bucket_summary(spark, d):
    return _bucket(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("n_allowed"))


# --- hashes and built-in sketches ---


# Both hashes in unsigned numbers of 128 bits.
M32, M64 = 1 << 32, 1 << 64


def _turned(x: str, r: int, bits: int) -> str:
    return f"(({x}) * {1 << r} % {1 << bits} + ({x}) // {1 << (bits - r)})"


def _word(first: str, size: int, upto: str) -> str:
    """Bytes from a place on as one number, low byte first; ``upto`` of them at most."""
    return f"list_reduce(list_prepend(CAST(0 AS UHUGEINT), list_transform(range(0, least({size}, {upto})), lambda j: CAST(b[{first} + j + 1] AS UHUGEINT) * CAST(pow(256, j) AS UHUGEINT))), lambda x, y: x + y)"


def _k(x: str, first: int, second: int, r: int, bits: int) -> str:
    return f"({_turned(f'({x}) * {first} % {1 << bits}', r, bits)} * {second} % {1 << bits})"


K32 = lambda x: _k(x, 0xCC9E2D51, 0x1B873593, 15, 32)
K1, K2 = (lambda x: _k(x, 0x87C37B91114253D5, 0x4CF5AD432745937F, 31, 64)), (lambda x: _k(x, 0x4CF5AD432745937F, 0x87C37B91114253D5, 33, 64))
Z = "CAST(0 AS UHUGEINT)"
H1 = lambda h, k: f"((({_turned(f'xor({h}[1], {K1(k + '[1]')})', 27, 64)} + {h}[2]) % {M64}) * 5 + {0x52DCE729}) % {M64}"
H2 = lambda h, k: f"((({_turned(f'xor({h}[2], {K2(k + '[2]')})', 31, 64)} + {H1(h, k)}) % {M64}) * 5 + {0x38495AB5}) % {M64}"
F64 = lambda x: f"xor({x}, ({x}) // {1 << 33})"
MURMUR = f"""WITH c AS (SELECT c_name, list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b, CAST(strlen(c_name) AS BIGINT) AS n FROM customer),
w AS (SELECT *, list_transform(range(0, n // 4), lambda i: {_word('4 * i', 4, '4')}) AS w32, {_word('4 * (n // 4)', 4, 'n % 4')} AS t32,
  list_transform(range(0, n // 16), lambda i: [{_word('16 * i', 8, '8')}, {_word('16 * i + 8', 8, '8')}]) AS w64,
  {_word('16 * (n // 16)', 8, 'n % 16')} AS t1, {_word('16 * (n // 16) + 8', 8, 'greatest(n % 16 - 8, 0)')} AS t2 FROM c),
r AS (SELECT *, list_reduce(list_prepend({Z}, w32), lambda h, k: ({_turned(f'xor(h, {K32("k")})', 13, 32)} * 5 + {0xE6546B64}) % {M32}) AS h, list_reduce(list_prepend([{Z}, {Z}], w64), lambda h, k: [{H1('h', 'k')}, {H2('h', 'k')}]) AS p FROM w),
a AS (SELECT c_name, xor(xor(h, {K32('t32')}), CAST(n AS UHUGEINT)) AS h, xor(xor(p[1], {K1('t1')}), CAST(n AS UHUGEINT)) AS x, xor(xor(p[2], {K2('t2')}), CAST(n AS UHUGEINT)) AS y FROM r),
s AS (SELECT c_name, xor(h, h // 65536) * {0x85EBCA6B} % {M32} AS h, (x + y) % {M64} AS x, (x + y + y) % {M64} AS y FROM a),
u AS (SELECT c_name, xor(h, h // 8192) * {0xC2B2AE35} % {M32} AS h, {F64('x')} * {0xFF51AFD7ED558CCD} % {M64} AS x, {F64('y')} * {0xFF51AFD7ED558CCD} % {M64} AS y FROM s),
v AS (SELECT c_name, xor(h, h // 65536) AS h, {F64('x')} * {0xC4CEB9FE1A85EC53} % {M64} AS x, {F64('y')} * {0xC4CEB9FE1A85EC53} % {M64} AS y FROM u),
z AS (SELECT c_name, h, ({F64('x')} + {F64('y')}) % {M64} AS x FROM v)
SELECT c_name, CAST(h AS BIGINT) AS h32, lower(format('{{:08X}}', CAST(x // {M32} AS BIGINT)) || format('{{:08X}}', CAST(x % {M32} AS BIGINT))) AS h64 FROM z"""


@query("murmur3_keys", MURMUR)
def murmur3_keys(spark, d):
    from kvspark.functions.hashing import murmur3_32, murmur3_64_hex

    keys = table(spark, d, "customer").select("c_name")
    return keys.select("c_name", murmur3_32(F.col("c_name")).alias("h32"), murmur3_64_hex(F.col("c_name")).alias("h64"))


@query("builtin_approx_distinct")
def builtin_approx_distinct(spark, d):
    return table(spark, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.01).alias("estimate"))


@query("builtin_hll")
def builtin_hll(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(14))).alias("estimate"))


@query("builtin_top_k")
def builtin_top_k(spark, d):
    return table(spark, d, "lineitem").selectExpr("approx_top_k(l_partkey, 10) AS found").select(F.explode("found").alias("x")).select("x.item", "x.count")
