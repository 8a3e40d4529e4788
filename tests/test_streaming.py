import random

from kvspark.model import OPLOG
from kvspark.operators import traces, versions
from kvspark.streaming import state as streams


def test_upsert_equals_batch(spark, tmp_path):
    random.seed(1)
    rows = [(f"k{random.randint(0, 9)}", random.choice("abc"), random.random() < 0.2, i, i) for i in range(200)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], OPLOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.log_stream(spark, str(tmp_path / "in"), OPLOG, 1)
    streams.upsert(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in streams.state(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in versions.lww(spark.createDataFrame(rows, OPLOG)).collect()}


def test_token_bucket_equals_batch(spark, tmp_path):
    rows = [(f"u{i % 3}", i // 3, i) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "who string, s long, order long").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema("who string, s long, order long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.token_bucket(stream, 3, 8).writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = traces.token_bucket(spark.createDataFrame(rows, "who string, s long, order long"), "who", "s", "order", 3, 8)
    assert spark.table("bucket").count() == 60
    assert {r["order"]: r["allowed"] for r in spark.table("bucket").collect()} == {r["order"]: r["allowed"] for r in batch.collect()}


def test_latest_is_a_streaming_aggregation(spark, tmp_path):
    spark.createDataFrame([("a", "1", False, 1, 1), ("a", "2", False, 2, 2)], OPLOG).write.parquet(str(tmp_path / "in"))
    stream = streams.latest(streams.log_stream(spark, str(tmp_path / "in"), OPLOG))
    stream.writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r["value"] for r in spark.table("latest").collect()] == ["2"]
