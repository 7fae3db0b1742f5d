"""Cutting lineage in loops, and how many tasks a table needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of files that a task of a shuffle is given.
SHARE = 4 << 20


def parts(*frames: DataFrame) -> int:
    """Tasks over which a shuffle of these frames is spread, by the size of the files they read; 0 if that is not known.

    Spark itself makes a fixed number of partitions, or joins them by their
    compressed size, so a task's share grows with the table.
    """
    total = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
        total += sum(n for n in sizes if n < 1 << 50)  # larger: a table whose size is not known
    return min(-(-total // SHARE), 4096)


def spread(df: DataFrame, keys, cells: int | None = None, tasks: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` over ``tasks``, by default as many as its files need; as it is while the session's own tasks do.

    ``cells`` bounds its rows, so a small result of large files is left alone.
    """
    n = min(parts(df) if tasks is None else tasks, 4096)
    if n <= df.sparkSession.sparkContext.defaultParallelism or cells is not None and cells < n << 14:
        return df
    return df.repartition(n, *keys)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder, which the driver and all executors see."""
    return f"{_shared(spark.sparkContext)}/tessera/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint; a folder of our own is set only where the session has none."""
    _shared(df.sparkSession.sparkContext)
    return df.checkpoint()


def _shared(context) -> str:
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir().rstrip("/")
