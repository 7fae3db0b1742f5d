"""Sharding by extendible hashing, in DataFrame operations only.

A document's key is the first 60 bits of the md5 of its doc_id. A bucket is a
prefix of those bits. The directory begins with the empty prefix; a bucket
whose texts have more bytes than the limit splits on the next bit, and only
such buckets do. The sums are taken ``STEP`` bits at a time over pre-aggregated
cells; only documents of cells that are still too large are looked at again.

A bucket of one document, or of rows that share a doc_id, cannot split any
further: it keeps its rows and is marked ``oversize``. Null text has no bytes;
a null doc_id hashes as the empty string. An empty table gives no shards. Rows are
packed while they are dealt, so no name of theirs clashes with ours; a long text
only counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workspace

BITS, STEP = 60, 12
#: Directory rows that are broadcast; a larger directory is joined by shuffle.
SMALL = 50_000
OUT = ("shard", "depth", "shard_bytes", "shard_docs", "oversize")


def _hash(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, bits) -> Column:
    return F.expr(f"shiftright({h}, {BITS} - {bits})")


def directory(keyed: DataFrame, max_bytes: int) -> list[DataFrame]:
    """For each level of ``STEP`` bits, the cells that are settled there: cell, depth, bytes and rows of their bucket."""
    out, rest = [], keyed.select("_h", "_n")
    for bits in range(STEP, BITS + 1, STEP):
        cells = rest.groupBy(_prefix("_h", bits).alias("cell")).agg(F.sum("_n").alias("n"), F.count("*").alias("rows"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        cells = workspace.materialize(cells, "cells")
        paths = cells.withColumn("d", F.explode(F.sequence(F.lit(0 if bits == STEP else bits - STEP + 1), F.lit(bits)))).withColumn("p", F.expr(f"shiftright(cell, {bits} - d)"))
        buckets = paths.groupBy("d", "p").agg(F.sum("n").alias("shard_bytes"), F.sum("rows").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = buckets.filter((F.col("shard_bytes") <= max_bytes) | (F.col("lo") == F.col("hi")))
        found = paths.select("cell", "d", "p").join(fits.select("d", "p", "shard_bytes", "shard_docs"), ["d", "p"]).groupBy("cell").agg(F.min(F.struct(F.col("d").alias("depth"), "shard_bytes", "shard_docs")).alias("x"))
        settled = workspace.materialize(found.select("cell", "x.*"), "directory")
        out.append(settled)
        open_ = cells.select("cell").join(settled.select("cell"), "cell", "left_anti")
        if open_.isEmpty():
            break
        rest = rest.withColumn("cell", _prefix("_h", bits)).join(open_, "cell", "left_semi").drop("cell")
    return out


def shard(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its shard (a bit string), depth, shard_bytes, shard_docs and oversize; columns of these names are replaced."""
    keyed = docs.select(F.struct(*workspace.own(docs, OUT)).alias("_row"), _hash(key).alias("_h"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint").alias("_n"))
    levels = directory(keyed, max_bytes)
    out = keyed
    for k, level in enumerate(levels):
        named = level.select(F.col("cell").alias(f"_c{k}"), F.struct("depth", "shard_bytes", "shard_docs").alias(f"_x{k}"))
        out = out.withColumn(f"_c{k}", _prefix("_h", STEP * (k + 1))).join(workspace.broadcast_if_small(named, SMALL), f"_c{k}", "left")
    found = F.coalesce(*[F.col(f"_x{k}") for k in range(len(levels))])
    out = out.withColumn("_x", found)
    return out.select(
        *workspace.unpacked(out, "_row"),
        F.when(F.col("_x.depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(shiftright(_h, {BITS} - _x.depth)), _x.depth, '0')")).alias("shard"),
        F.col("_x.depth").alias("depth"), F.col("_x.shard_bytes").alias("shard_bytes"), F.col("_x.shard_docs").alias("shard_docs"),
        (F.col("_x.shard_bytes") > max_bytes).alias("oversize"),
    )


def sql(max_bytes: int) -> str:
    """The same assignment of ``documents`` in DuckDB's SQL."""
    return f"""
with k as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h, cast(coalesce(strlen(text), 0) as bigint) as n_bytes from documents),
b as (select d, h >> ({BITS} - d) as p, sum(n_bytes) as shard_bytes, count(*) as shard_docs, min(h) as lo, max(h) as hi from k, (select unnest(range(0, {BITS} + 1)) as d) group by all),
f as (select * from b where shard_bytes <= {max_bytes} or lo = hi),
x as (select k.doc_id, k.h, k.n_bytes, min(f.d) as depth from k join f on f.p = k.h >> ({BITS} - f.d) group by all)
select x.doc_id, x.n_bytes, case when depth = 0 then '' else right(lpad(bin(h >> ({BITS} - depth)), 64, '0'), cast(depth as integer)) end as shard,
  cast(depth as integer) as depth, cast(f.shard_bytes as bigint) as shard_bytes, f.shard_docs, f.shard_bytes > {max_bytes} as oversize
from x join f on f.d = x.depth and f.p = x.h >> ({BITS} - x.depth)"""
