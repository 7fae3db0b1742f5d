"""Token counts by a separator scan of flat token files.

A flat file is ids of a fixed width, one after another, and nothing else. It is
cut into blocks of ids without regard to documents. A block is searched for the
end-of-document id in one vector comparison; what it tells is the places after
the ends it holds. A prefix scan over a file's blocks (the greatest such place so
far, and the number of ends so far) gives each block the place where its first
document began and that document's number, so documents that go across blocks
are put together. A document does not go on into another file. Ids after a
file's last end are a document that is not closed.

Files are written by the executors with pyarrow's file systems, under a name of
their own for each attempt; the manifest that Spark commits says which count.
They are read in ranges, or as whole rows of Spark's binaryFile source where
only Spark can open the store.

Null or empty text: the end id alone, so 0 tokens. Repeated rows stay repeated.
An empty table, or empty files, give no rows. A null doc_id stays null; other columns
are ignored. A long text takes as much memory as its bytes and ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels, workspace
from .tokens import encoder, past_vocabulary

BLOCK_IDS = 4 << 20
SCHEMA = "file string, block bigint, n_ids bigint, ends array<bigint>"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the ids of ``docs`` to flat files in ``folder``, a file per task; returns the manifest: doc_id, file, doc (its number in the file), width."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, n = encoder(tokenizer, end_id), None, 0
        name = f"part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.bin"
        system, root = _file_system(folder)
        try:
            for batch in batches:
                for a, b, data, offsets in kernels.utf8_slices(batch["text"]):
                    if out is None:
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(f"{root}/{name}")
                    ids, _ = enc.encode(data, offsets)
                    out.write(ids.tobytes())
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array([name] * (b - a)), pa.array(np.arange(n, n + b - a)), pa.array(np.full(b - a, enc.dtype.itemsize, dtype=np.int32))], names=["doc_id", "file", "doc", "width"])
                    n += b - a
        finally:
            if out is not None:
                out.close()

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return workspace.materialize(plain.mapInArrow(work, "doc_id bigint, file string, doc bigint, width int"), "manifest")


def _scan(raw: bytes, width: int, first: int, end_id: int) -> np.ndarray:
    """Places after the ends in the ids of a block that begins at ``first``."""
    return np.flatnonzero(np.frombuffer(raw, dtype=f"<u{width}") == end_id) + (first + 1)


def scan_blocks(spark: SparkSession, folder: str, end_id: int, width: int, block_ids: int = BLOCK_IDS, files: DataFrame | None = None) -> DataFrame:
    """A row per block of the flat files in ``folder`` (only those named in ``files``, if given)."""
    found = spark.read.format("binaryFile").load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    if files is not None:
        found = found.join(files.select("file").distinct(), "file", "left_semi")
    step = block_ids * width
    try:
        _file_system(folder)
        ranged = True
    except Exception:
        ranged = False
    if ranged:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    system, path = _file_system(row["path"])
                    with system.open_input_file(path) as f:
                        raw = f.read_at(min(step, row["length"] - row["at"]), row["at"])
                    if len(raw) % width:
                        raise ValueError(f"{row['path']}: its size is no multiple of {width}")
                    ends = _scan(raw, width, row["at"] // width, end_id)
                    yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["at"] // step]), pa.array([len(raw) // width]), pa.array([ends], type=pa.list_(pa.int64()))], names=["file", "block", "n_ids", "ends"])

        blocks = found.filter("length > 0").select("path", "file", "length", F.explode(F.expr(f"sequence(0L, length - 1, {step}L)")).alias("at"))
        return blocks.repartition(workspace.partitions(spark), "file", "at").mapInArrow(work, SCHEMA)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw, name = batch["content"][k].as_buffer(), batch["file"][k].as_py()
                for at in range(0, raw.size, step):
                    piece = raw.slice(at, min(step, raw.size - at))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // step]), pa.array([piece.size // width]), pa.array([_scan(piece, width, at // width, end_id)], type=pa.list_(pa.int64()))], names=["file", "block", "n_ids", "ends"])

    return found.select("file", "content").mapInArrow(whole, SCHEMA)


def stitch(blocks: DataFrame) -> DataFrame:
    """A row per document of the scanned blocks: file, doc, start (in the file), n_ids (with the end id), closed.

    The scan goes over a row of four numbers for each block; the places of the
    ends stay with their blocks, which are dealt by file and block.
    """
    blocks = workspace.materialize(blocks, "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    n_ends = F.size("ends").cast("bigint")
    prefix = (
        blocks.select("file", "block", "n_ids", n_ends.alias("n_ends"), F.when(n_ends > 0, F.element_at("ends", -1)).alias("last"))
        .withColumn("began", F.coalesce(F.max("last").over(before), F.lit(0)))
        .withColumn("doc0", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("total", F.coalesce(F.sum("n_ids").over(before), F.lit(0)) + F.col("n_ids"))
        .withColumn("is_last", F.count("*").over(after) == 0)
        .select("file", "block", "began", "doc0", "total", (F.col("is_last") & (F.col("total") > F.coalesce("last", "began"))).alias("open"))
    )
    scanned = blocks.select("file", "block", "ends").hint("merge").join(prefix, ["file", "block"])
    ends = F.when(F.col("open"), F.concat("ends", F.array("total"))).otherwise(F.col("ends"))
    docs = scanned.withColumn("all_ends", ends).select("file", "doc0", "began", "all_ends", F.size("ends").alias("n_closed"), F.posexplode("all_ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("began")).otherwise(F.expr("get(all_ends, k - 1)"))
    return docs.select("file", (F.col("doc0") + F.col("k")).alias("doc"), start.alias("start"), (F.col("end") - start).alias("n_ids"), (F.col("k") < F.col("n_closed")).alias("closed"))


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write ``docs`` to flat files and count them by a scan: doc_id, n_tokens (without the end id).

    ``end_id`` must be an id that no text has; without one it is the first past the vocabulary.
    """
    spark = docs.sparkSession
    end_id = past_vocabulary(tokenizer) if end_id is None else end_id
    folder = workspace.table_path(spark, "flat")
    manifest = write_flat(docs, folder, tokenizer, end_id)
    width = manifest.select("width").first()
    if width is None:
        return manifest.select("doc_id", F.col("doc").alias("n_tokens"))
    found = stitch(scan_blocks(spark, folder, end_id, width[0], block_ids, manifest))
    # The manifest packs so well on disk that its size there would make Spark broadcast it
    return manifest.select("doc_id", "file", "doc").hint("merge").join(found, ["file", "doc"]).select("doc_id", (F.col("n_ids") - F.col("closed").cast("int")).alias("n_tokens"))
