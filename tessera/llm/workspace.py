"""Where operators put tables that cut lineage: a folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables written since the innermost ``tables`` began.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own, which only a local master may have."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_tessera_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark._tessera_shared = found
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    if _written.get() is not None:
        _written.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialize`` wrote inside. What goes on after must not read them."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own(df: DataFrame, skip: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` by their names as they are, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in skip]


def unpacked(df: DataFrame, row: str, skip: tuple[str, ...] = ()) -> list[Column]:
    """The fields of the struct column ``row``."""
    return [F.col(row).getField(c).alias(c) for c in df.schema[row].dataType.names if c not in skip]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
