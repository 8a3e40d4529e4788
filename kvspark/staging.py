"""Tables between steps: lineage is cut by writing to a folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: list[tuple[SparkSession, str]] = []
_OWN_DIR: list[str] = []

#: The planner says this size or more of tables that it knows nothing about.
UNKNOWN = 1 << 60
#: A key with more than one in so many of all rows is heavy; so there are fewer heavy keys than this.
HEAVY = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, one below the warehouse, or in local mode, where driver and executor are one process, a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="kvspark-stages-"))
    return _OWN_DIR[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lineage ends there.

    The table survives a lost executor, keeps column pruning and gives the optimizer true sizes. It is
    deleted by drop_cut(), release() or drop_staged(), and else when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_folder(spark: SparkSession, path: str) -> None:
    """Have a folder deleted with the tables of cut()."""
    _STAGED.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _stage_of(df: DataFrame) -> str | None:
    return next((x for f in df.inputFiles()[:1] for x in f.split("/") if x.startswith("stage-")), None)


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind one cut() result that is no longer read."""
    name = _stage_of(df)
    for spark, path in list(_STAGED):
        if name and path.endswith(name):
            _STAGED.remove((spark, path))
            _delete(spark, path)


def staged() -> int:
    """How many tables there are now, for release()."""
    return len(_STAGED)


def release(since: int, *kept: DataFrame) -> None:
    """Delete the tables that came after ``since``, except those behind ``kept``; for a step whose result is stored."""
    names = {_stage_of(df) for df in kept}
    for spark, path in _STAGED[since:]:
        if path.rsplit("/", 1)[-1] not in names:
            _STAGED.remove((spark, path))
            _delete(spark, path)


def drop_staged() -> None:
    """Delete all tables of cut(); call it once the results that read them are stored."""
    release(0)


def _at_end() -> None:
    drop_staged()
    for path in _OWN_DIR:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_at_end)


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it comes from files without a shuffle, and so has the same rows in the same order whenever it is read; else it is written first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return cut(df) if "Exchange" in plan or "Scan ExistingRDD" in plan else df


def tasks(df: DataFrame, bytes_a_task: int = 64 << 20) -> int:
    """Partitions of a shuffle that follow the size of a table of files; the session's number at least, also where the size is unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), -(-size // bytes_a_task) if size < UNKNOWN else 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_back(rows: DataFrame, per_key: DataFrame, key: str, total: int, n: str = "_n") -> DataFrame:
    """Rows with the columns of ``per_key``, a table of one row for each key with the number ``n`` of its rows; rows of other keys go.

    Heavy keys (more than 1/HEAVY of ``total`` rows each, so fewer than HEAVY keys) are broadcast, so that
    no task gets all rows of one; the rest shuffles. ``rows`` and ``per_key`` are read more than once.
    """
    heavy = F.col(n) * HEAVY > total
    found = rows.join(F.broadcast(per_key.where(heavy)), key)
    rest = rows.join(F.broadcast(per_key.where(heavy).select(key)), key, "left_anti").join(per_key.where(~heavy).hint("merge"), key)
    return found.unionByName(rest)
