import random

import pytest
from pyspark.sql import functions as F

from kvspark.model import OPLOG, Config
from kvspark.operators import compaction, integrity, scan, segments, traces, versions
from kvspark.operators.sketches import hll
from kvspark.sources import oplog as logs
from kvspark.sources import tables
from kvspark.store import Store


def ops(spark, rows):
    return spark.createDataFrame([(k, v, v is None, i, i) for i, (k, v) in enumerate(rows)], OPLOG)


def test_users_fixture(spark, tmp_path):
    """Ten users, three deletes, then up to user 45."""
    store = Store(spark, str(tmp_path / "s"), Config(segment_ops=8))
    store.put_many((f"user{i:03d}", f"data{i % 5}") for i in range(1, 11))
    store.delete_many(["user005", "user007", "user009"])
    assert store.as_of(9).count() == 10 and store.as_of(12).count() == 7
    store.put_many((f"user{i:03d}", f"data{i % 5}") for i in range(11, 46))
    live = [r["key"] for p in store.prefix_scan("user", 10) for r in p]
    assert live == [f"user{i:03d}" for i in range(1, 46) if i not in (5, 7, 9)]
    assert store.get("user001") == "data1" and store.get("user005") is None and store.get("nobody") is None
    pages = [[r["key"] for r in p] for p in store.range_scan("user001", "user010", 7)]
    assert pages == [[f"user{i:03d}" for i in (1, 2, 3, 4, 6, 8, 10)]]  # an exact multiple gives no empty page
    store.flush()
    assert all(r["ok"] for r in store.validate().collect())
    store.compact(str(tmp_path / "t"))
    again = Store(spark, str(tmp_path / "t"))
    assert [r["key"] for p in again.prefix_scan("", 100) for r in p] == live
    assert again.log().count() == 42
    store.put("user005", "back")
    assert store.get("user005") == "back"


def test_reserved_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.put("system_x", "1")
    with pytest.raises(ValueError):
        store.delete("system_x")
    rows = spark.createDataFrame([("Ana",), ("Marko",), ("Ana",)], "x string")
    store.create("bloom", "names", n=20, p=0.05)
    store.add("bloom", "names", rows, "x")
    assert all(r["maybe"] for r in store.has_key("names", rows, "x").collect()) and store.has_key("none", rows, "x") is None
    store.create("cms", "names", epsilon=0.01, delta=0.01)
    assert {r["estimate"] for r in store.count("names", rows, "x").collect()} == {0}
    store.add("cms", "names", rows, "x")
    store.add("cms", "names", rows, "x")
    assert {r["x"]: r["estimate"] for r in store.count("names", rows, "x").collect()} == {"Ana": 4, "Marko": 2}
    store.create("hll", "names", p=10)
    store.add("hll", "names", rows, "x")
    assert store.cardinality("names") == 2 and store.cardinality("none") is None
    store.add_fingerprint("a", "Hello world")
    store.add_fingerprint("b", "Hello world hello world")
    assert store.hamming("a", "b") == 0 and store.hamming("a", "c") is None
    assert store.drop("bloom", "names") and store.drop("bloom", "never") and store.describe("bloom", "names") is None
    assert list(store.prefix_scan("")) == []
    with pytest.raises(KeyError):
        store.add("bloom", "names", rows, "x")


def test_last_writer_wins_like_a_dict(spark):
    random.seed(5)
    rows = [(f"k{random.randint(0, 15)}", random.choice([None, "a", "b", "c"])) for _ in range(300)]
    model = {}
    for k, v in rows:
        model[k] = v
    log = ops(spark, rows)
    live = {k: v for k, v in model.items() if v is not None}
    assert {r["key"]: r["value"] for r in versions.visible(log).collect()} == live
    flushed = segments.newest_in_segment(segments.assign(log, 32))
    assert {r["key"]: r["value"] for r in versions.visible(flushed).collect()} == live
    assert {r["key"]: r["value"] for r in compaction.merge(flushed, gc=True).collect()} == live
    keys = spark.createDataFrame([(f"k{i}",) for i in range(20)] + [("k1",)], "key string")
    assert {r["key"] for r in versions.missing(log, keys).collect()} == {f"k{i}" for i in range(20)} - set(live)
    assert {r["key"]: r["present"] for r in versions.exists(log, keys).collect()} == {f"k{i}": f"k{i}" in live for i in range(20)}
    assert versions.ranked(log).where("version_rank = 1").count() == len(model)


def test_pushdown(spark, tmp_path):
    logs.append(ops(spark, [("a", "1"), ("b", "2")]), str(tmp_path / "log"))
    raw = spark.read.parquet(str(tmp_path / "log"))
    plan = versions.get(raw, "a")._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan
    assert "StringStartsWith(key,a)" in scan.prefix(raw, "a")._jdf.queryExecution().toString()


def test_numbered_pages(spark):
    rows = spark.createDataFrame([(f"k{i:03d}",) for i in range(57)], "key string")
    assert {r["key"]: r["page"] for r in scan.numbered(rows, 10).collect()} == {f"k{i:03d}": i // 10 for i in range(57)}


def test_crc_and_replay(spark, tmp_path):
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary")).alias("c")).first()["c"] == 3421780262
    path = str(tmp_path / "log")
    logs.append(ops(spark, [("a", "1"), ("b", None)]), path)
    assert logs.replay(spark, path).count() == 2
    damaged = logs.with_crc(ops(spark, [("c", "3")])).withColumn("value", F.lit("4"))
    damaged.write.mode("append").parquet(path)
    assert {r["key"] for r in logs.replay(spark, path).collect()} == {"a", "b"}
    assert logs.after(logs.replay(spark, path), 0).count() == 1


def test_segments_on_disk(spark, tmp_path):
    rows = segments.newest_in_segment(segments.assign(ops(spark, [(f"k{i:02d}", str(i)) for i in range(40)]), 10))
    segments.write(rows, str(tmp_path))
    assert segments.read(spark, str(tmp_path)).count() == 40
    assert {r["segment_id"] for r in segments.read(spark, str(tmp_path), "k12", "k14").collect()} == {1}
    offsets = segments.offsets(rows).where("segment_id = 0").orderBy("key").collect()
    assert [r["byte_offset"] for r in offsets] == [34 * i for i in range(10)]
    index = segments.sparse(segments.offsets(rows), 4, ("key", "seq"))
    assert [r["key"] for r in index.where("segment_id = 0").orderBy("key").collect()] == ["k00", "k04", "k08", "k09"]
    assert {r["segment_id"]: r["start_offset"] for r in segments.lookup_offset(index, "k05").collect()}[0] == 34 * 4


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9])
def test_merkle(spark, n):
    import hashlib

    rows = spark.createDataFrame([(0, f"k{i}", str(i), i) for i in range(n)], "segment_id long, key string, value string, seq long")
    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    found = integrity.leaves(rows)
    assert integrity.roots(found).first()["merkle_root"] == level[0]
    assert all(r["verified"] for r in integrity.proofs(found).collect())
    changed = integrity.leaves(rows.withColumn("value", F.when(F.col("seq") == n - 1, "x").otherwise(F.col("value"))))
    assert [tuple(r) for r in integrity.differences(found, changed).collect()] == [(0, n - 1, "MODIFIED")]


def test_tiered_counts_follow_a_simulation():
    for threshold, levels in ((2, 4), (3, 4), (4, 5)):
        tables = [0] * (levels + 1)
        for flush in range(1, 60):
            tables[1] += 1
            for level in range(1, levels - 1):
                if tables[level] >= threshold:
                    tables[level] = 0
                    tables[level + 1] += 1
            assert compaction.tiered_counts(flush, threshold, levels) == [(x, tables[x]) for x in range(1, levels)]


def test_token_bucket_fixture(spark):
    times = [0, 0, 1, 1, 2, 2, 3, 14, 14, 15]
    rows = spark.createDataFrame([("u", t, i) for i, t in enumerate(times)], "who string, s long, i long")
    got = [r["allowed"] for r in traces.token_bucket(rows, "who", "s", "i", 5, 10).orderBy("i").collect()]
    assert got == [True] * 5 + [False] * 2 + [True] * 3


def test_lru_fixture(spark):
    trace = [1, 2, 1, 2, 3, 4, 5, 1, 2]
    rows = spark.createDataFrame([("c", i, str(k)) for i, k in enumerate(trace)], "cache string, i long, k string")
    hits = lambda c: [r["hit"] for r in traces.lru(rows, "cache", "k", "i", c).orderBy("i").collect()]
    assert hits(3) == [False, False, True, True, False, False, False, False, False]
    assert hits(10) == [False, False, True, True, False, False, False, True, True]


def test_generations(spark):
    rows = spark.createDataFrame([(0, i, k) for i, k in enumerate("aabbcca")], "shard int, seq long, key string")
    assert [r["generation"] for r in segments.generations(rows, "shard", 2).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2, 2]
    flushed = lambda n: [r["flushed"] for r in segments.generations(rows, "shard", 2, n).orderBy("seq").collect()]
    assert flushed(1) == [True] * 7 and flushed(2) == [True] * 5 + [False] * 2 and flushed(4) == [False] * 7


def test_memtables_flush_and_log(spark, tmp_path):
    """Two memtables of two keys: full ones leave the log, oldest first; reads merge both; nothing is written twice."""
    with Store(spark, str(tmp_path / "s"), Config(memtables=2, memtable_keys=2, cache_capacity=2, tables_per_level=3, max_levels=4)) as store:
        store.put("a", "1")
        store.put("b", "2")
        assert store.tables().count() == 0 and store.dump_log().count() == 2
        store.put("a", "3")
        store.delete("c")  # the second is full: the first goes
        assert [(r["level"], r["min_key"], r["max_key"], r["n_records"]) for r in store.tables().collect()] == [(1, "a", "b", 2)]
        assert {r["key"] for r in store.dump_log().collect()} == {"a", "c"}
        assert {(r["key"], r["tombstone"]) for r in store.dump_memtables().collect()} == {("a", False), ("c", True)}
        assert store.get("a") == "3" and store.get("b") == "2" and store.get("c") is None
        assert store.get_from_level("a", 1)["value"] == "1" and [r["value"] for r in store.get_from_table("b", 0)] == ["2"]
        store.flush()
        store.flush()
        store.put("d", "4")
        assert store.dump_log().count() == 1 and store.tables().count() == 2 and all(r["ok"] for r in store.validate().collect())
        assert store._cache.get("a") == "3" and "c" not in store._cache and store.get("a") == "3"
        store.delete("a")
        assert store.get("a") is None
        store.flush()
        assert "a" not in store._cache and store.get("a") is None
        assert [r["key"] for p in store.prefix_scan("") for r in p] == ["b", "d"]
        store.compact_size_tiered()
        assert [(r["level"], r["n_records"], r["n_tombstones"]) for r in store.tables().collect()] == [(2, 4, 2)]
        assert [r["key"] for p in store.prefix_scan("") for r in p] == ["b", "d"] and store.get("a") is None and all(r["ok"] for r in store.validate(2).collect())
        store.put("e", "5")
    again = Store(spark, str(tmp_path / "s"))
    assert again.dump_log().count() == 0 and again.get("e") == "5" and again.tables(1).count() == 1
    again.remove_tables([r["table_id"] for r in again.tables(1).collect()])
    assert again.get("e") is None and again.get("b") == "2"
    again.reset()
    assert again.get("b") is None and again.tables().count() == 0 and again._seq == -1


def test_damage_is_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put_many((f"k{i}", str(i)) for i in range(20))
    store.flush()
    path = f"{store.path}/tables/table=0"
    rows = spark.read.parquet(path).withColumn("value", F.when(F.col("key") == "k7", "x").otherwise(F.col("value"))).collect()
    spark.createDataFrame(rows, OPLOG).write.mode("overwrite").parquet(path)
    assert [r["ok"] for r in store.validate().collect()] == [False]


def test_leveled_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Config(level_size_multiplier=2, max_levels=4))
    for n in range(4):
        store.put_many((f"k{(n * 3 + j) % 8}", f"{n}") for j in range(3))
        store.flush()
    before = [tuple(r) for p in store.prefix_scan("") for r in p]
    store.compact_leveled()
    levels = [r["level"] for r in store.tables().collect()]
    assert levels.count(1) == 2 and levels.count(2) >= 1 and [tuple(r) for p in store.prefix_scan("") for r in p] == before


def test_two_writers(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a.put_many([("x", "1"), ("y", "1")])
    b.put("x", "2")
    assert sorted(r["seq"] for r in Store(spark, str(tmp_path / "s")).dump_log().collect()) == [0, 1, 2]
    assert Store(spark, str(tmp_path / "s")).get("x") == "2"


def test_bulk_load(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Config(segment_ops=10))
    store.load(ops(spark, [(f"k{i % 7}", str(i)) for i in range(35)]))
    assert store.tables().count() == 4 and store.get("k6") == "34" and store.dump_log().count() == 0
    store.put("k6", "35")
    assert store.get("k6") == "35" and store.multi_get(spark.createDataFrame([("k6",), ("none",)], "key string")).count() == 1


def test_padded_keys_never_shorten(spark):
    got = [r["p"] for r in spark.createDataFrame([(7,), (123456,), (1234567,), (12345678,)], "n long").select(tables.padded(F.col("n"), 6).alias("p")).collect()]
    assert got == ["000007", "123456", "1234567", "12345678"]


def test_varint(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", segments.varint_encode(F.col("n")).alias("c")).withColumn("d", segments.varint_decode(F.col("c"))).collect()

    def plain(n):
        out = b""
        while True:
            out += bytes([n % 128 + 128 * (n > 127)])
            n //= 128
            if not n:
                return out.hex().upper()

    assert [(r["c"], r["d"]) for r in rows] == [(plain(n), n) for n in numbers]


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n" + "".join(f"{i:032x},{i % 40:032x},01{i:03d},a city,SP\n" for i in range(100)))
    rows = tables.read_csv(spark, str(tmp_path / "c.csv"))
    assert {t for _, t in rows.dtypes} == {"string"} and rows.count() == 100
    assert abs(hll.estimate(hll.registers(rows, "customer_unique_id", 14), 14).first()["estimate"] - 40) <= 1
    assert rows.first()["customer_zip_code_prefix"].startswith("0")


def test_proof_of_a_changed_leaf(spark):
    rows = spark.createDataFrame([(0, f"k{i}", str(i), i) for i in range(6)], "segment_id long, key string, value string, seq long")
    changed = rows.withColumn("value", F.when(F.col("seq") == 4, "x").otherwise(F.col("value")))
    got = {r["leaf_idx"]: r["verified"] for r in integrity.proofs(integrity.leaves(rows), integrity.leaves(changed)).collect()}
    assert got == {i: i != 4 for i in range(6)}


def test_config():
    with pytest.raises(ValueError):
        Config(segment_ops=0)
    with pytest.raises(ValueError):
        Config(bloom_rate=1.0)
    assert "segment_ops=512" in repr(Config())
