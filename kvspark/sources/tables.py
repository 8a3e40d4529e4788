"""Test tables as operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(n: Column, digits: int) -> Column:
    """A number with leading zeros up to ``digits`` digits; longer numbers stay whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


def events_oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key a user; error events are deletes."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), padded(F.col("user_id"), 6)).alias("key"), F.concat("event_type", F.lit("|"), "props").alias("value"),
        (F.col("event_type") == "error").alias("tombstone"), "ts", F.col("event_id").alias("seq"),
    )


def events_oplog2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key a user and kind of event: denser scans."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), padded(F.col("user_id"), 6), F.lit(":"), "event_type").alias("key"), F.col("props").alias("value"),
        (F.col("event_id") % 5 == 0).alias("tombstone"), "ts", F.col("event_id").alias("seq"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated records with a header, all columns as text, for the sketches."""
    return spark.read.csv(path, header=True)
