"""Ordered scans by prefix and by inclusive range, with keyset pages.

A page is a filter and a bounded top-k, so page n + 1 costs what page 1 costs. Page numbers over a whole
scan come from a range sort and one count for each of its partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kvspark.operators.versions import user_keys, visible
from kvspark.staging import cut


def prefix(oplog: DataFrame, start: str) -> DataFrame:
    """Visible keys that start with a prefix; the empty one matches all."""
    return visible(user_keys(oplog.where(F.col("key").startswith(start)) if start else oplog))


def between(oplog: DataFrame, low: str, high: str) -> DataFrame:
    """Visible keys of [low, high]."""
    return visible(user_keys(oplog.where(F.col("key").between(low, high))))


def page(rows: DataFrame, size: int, after: str | None = None) -> DataFrame:
    """The next ``size`` rows in the order of keys after a key."""
    return (rows if after is None else rows.where(F.col("key") > after)).orderBy("key").limit(size)


def numbered(rows: DataFrame, size: int) -> DataFrame:
    """Adds page numbers from 0 over the whole scan. Keys are unique."""
    from pyspark.sql import Window

    run = rows.select("key").repartitionByRange("key").sortWithinPartitions("key").withColumn("_at", F.monotonically_increasing_id())
    # The sorted run is stored for the count and the join alike, so bounds are drawn once.
    run = cut(run)
    part = F.shiftright("_at", 33)
    counts = run.groupBy(part.alias("_part")).count()
    offset = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", offset.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    pages = run.withColumn("_part", part).join(F.broadcast(offsets), "_part").select("key", F.floor(place / size).cast("long").alias("page"))  # one row a partition
    return rows.join(pages, "key")


class Cursor:
    """Pages of a scan, one after the other; ``end`` tells that nothing follows."""

    def __init__(self, rows: DataFrame, size: int) -> None:
        if size < 1:
            raise ValueError("a page has at least one row")
        self.rows, self.size, self.token, self.end = rows, size, None, False

    def next(self) -> list[Row]:
        found = page(self.rows, self.size + 1, self.token).collect()  # one row more than the page shows the end
        self.end = len(found) <= self.size
        found = found[: self.size]
        self.token = found[-1]["key"] if found else self.token
        return found

    def reset(self) -> None:
        self.token, self.end = None, False

    def __iter__(self) -> Iterator[list[Row]]:
        while not self.end and (rows := self.next()):
            yield rows
