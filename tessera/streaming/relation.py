"""Structured Streaming: a causal relation that grows with its points, and a matrix that sums streamed cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField

from tessera.operators.causal import BLOCK, relation


def cross_relation(old: DataFrame, new: DataFrame, precedes, block: int = BLOCK) -> DataFrame:
    """Edges between old and new points in either direction; blocks meet by an equi-join on their pair."""
    cols = [c for c in old.columns if c != "id"]
    n_old, n_new = (1 + int(x.agg(F.coalesce(F.max(F.floor(F.col("id") / block)), F.lit(-1))).first()[0]) for x in (old, new))
    if not n_old or not n_new:
        return old.sparkSession.createDataFrame([], "i bigint, j bigint")
    own = F.floor(F.col("id") / block).cast("int")
    a = old.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols], own.alias("p")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_new - 1))))
    b = new.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols], own.alias("q")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n_old - 1))))
    left, right = (lambda k: F.col(f"a_c{k}")), (lambda k: F.col(f"b_c{k}"))
    both = a.join(b, ["p", "q"]).select("a", "b", precedes(left, right).alias("up"), precedes(right, left).alias("down"))
    return both.filter("up").select(F.col("a").alias("i"), F.col("b").alias("j")).unionByName(both.filter("down").select(F.col("b").alias("i"), F.col("a").alias("j")))


def maintain_relation(points: DataFrame, precedes, folder: str, checkpoint: str, block: int = BLOCK) -> StreamingQuery:
    """Append to ``folder`` the points of a stream (id, c0, c1, ...) and their relation in time order.

    A batch meets the points of the batches before it. Both tables are written
    under the batch's number, so a batch that is run again replaces what it left.
    """
    schema = points.schema

    def batch(new: DataFrame, epoch: int) -> None:
        spark: SparkSession = new.sparkSession
        new = new.persist()
        try:
            before = spark.read.schema(type(schema)([*schema.fields, StructField("epoch", LongType())])).parquet(f"{folder}/points").filter(F.col("epoch") < epoch).drop("epoch") if epoch else spark.createDataFrame([], schema)
            edges = relation(new, precedes, "time", block).unionByName(cross_relation(before, new, precedes, block))
            edges.write.mode("overwrite").parquet(f"{folder}/edges/epoch={epoch}")
            new.write.mode("overwrite").parquet(f"{folder}/points/epoch={epoch}")
        finally:
            new.unpersist()

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulate(cells: DataFrame, name: str, checkpoint: str | None = None, start: Callable | None = None) -> StreamingQuery:
    """The running sum of streamed cells (i, j, v), kept in an in-memory table ``name``."""
    out = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).writeStream.outputMode("complete").format("memory").queryName(name)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).trigger(availableNow=True).start()
