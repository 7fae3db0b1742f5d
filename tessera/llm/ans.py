"""Token ids in a binary form: static range asymmetric numeral system (rANS).

One frequency table, scaled to a power of two, serves all blocks. A block holds
whole documents; its ids go to independent interleaved coder states ("lanes"),
id t to lane t mod lanes. Every so many steps it keeps the states and the place
in the word stream, so a reader can begin there, and checksums of the ids and of
the block itself.

A folder holds all that a reader needs: ``table`` (the frequencies) and ``blocks``.
Block bytes, little-endian: header (HEAD), checkpoints (place u64, states u64 x
lanes, in ascending step), words u32. The blocks are rows of a Parquet table
written by Spark, so a lost task is written again under the commit protocol.

Null text: no ids but the end id. A null doc_id sorts first. Repeated rows stay
repeated. An empty table gives an empty table. Other columns are ignored. A very
long text is a block of its own; it takes some 20 times the memory of its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, workspace
from .tokens import encoder

HEAD = struct.Struct("<4sBBHIIQQIII")  # magic, version, bits, lanes, steps between checkpoints, checkpoints, ids, words, table crc, ids crc, crc of the header before it and of all after it
MAGIC, VERSION = b"RNSB", 2
HEAD_MARKS = struct.calcsize("<4sBBHI")  # where the header says how many checkpoints there are
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


class Table:
    """Frequencies of ids, scaled to 2**bits; every id that occurs keeps at least one slot."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray, bits: int):
        self.ids, self.freqs, self.bits = ids.astype(np.int64), freqs.astype(np.int64), bits
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(size, dtype=np.uint64)
        self.low = np.zeros(size, dtype=np.uint64)
        self.freq[self.ids] = self.freqs
        self.low[self.ids] = np.cumsum(self.freqs) - self.freqs
        self.crc = zlib.crc32(np.concatenate((self.ids, self.freqs, [bits])).astype("<i8").tobytes())
        self._slots: np.ndarray | None = None

    @classmethod
    def scaled(cls, ids: np.ndarray, counts: np.ndarray, bits: int = 20) -> "Table":
        """From counts; ``bits`` grows if the ids need more slots."""
        if not len(ids):
            return cls(ids, counts, bits)
        bits = max(bits, int(np.ceil(np.log2(len(ids)))) + 2)
        order = np.argsort(ids)
        ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        room = (1 << bits) - len(ids)
        share = counts / counts.sum() * room
        freqs = 1 + np.floor(share).astype(np.int64)
        left = (1 << bits) - int(freqs.sum())
        freqs[np.argsort(np.floor(share) - share, kind="stable")[:left]] += 1
        return cls(ids, freqs, bits)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(self.ids.astype(np.uint32), self.freqs)
        return self._slots

    def __getstate__(self):
        return self.ids, self.freqs, self.bits

    def __setstate__(self, state):
        self.__init__(*state)


def encode_block(ids: np.ndarray, table: Table, lanes: int = 1024, every: int = 512) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    freq, low = table.freq[ids], table.low[ids]
    if n and not freq.all():
        raise ValueError("an id is not in the frequency table")
    bits, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    x = np.full(lanes, _LOW, dtype=np.uint64)
    out: list[np.ndarray] = []
    marks, written = [], 0
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(n, (step + 1) * lanes))
        f, c = freq[at], low[at]
        xs = x[: len(f)]
        over = np.flatnonzero(xs >= (f << room))
        if len(over):
            full = xs[over]
            out.append(full.astype(np.uint32))
            written += len(over)
            xs[over] = full >> _32
        q = xs // f
        xs[:] = (q << bits) + (xs - q * f) + c
        if step % every == 0:
            marks.append((written, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, dtype=np.uint32)
    body = b"".join([*(struct.pack("<Q", written - w) + x.astype("<u8").tobytes() for w, x in reversed(marks)), words.astype("<u4").tobytes()])
    head = HEAD.pack(MAGIC, VERSION, table.bits, lanes, every, len(marks), n, len(words), table.crc, zlib.crc32(ids.astype("<u4").tobytes()), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block, or of the spans between checkpoints ``first`` and ``last``."""
    magic, version, bits_, lanes, every, n_marks, n, n_words, table_crc, ids_crc, body_crc = HEAD.unpack_from(block)
    view = memoryview(block)
    if magic != MAGIC or version != VERSION or zlib.crc32(view[HEAD.size :], zlib.crc32(view[: HEAD.size - 4])) != body_crc:
        raise ValueError("damaged block, or not one of this format")
    if table_crc != table.crc:
        raise ValueError("a block of another table")
    at = HEAD.size + n_marks * (8 + 8 * lanes)
    words = np.frombuffer(block, dtype="<u4", count=n_words, offset=at)
    last = n_marks if last is None else min(last, n_marks)
    if first >= last:
        return np.zeros(0, dtype=np.uint32)
    mark = HEAD.size + first * (8 + 8 * lanes)
    place = struct.unpack_from("<Q", block, mark)[0]
    x = np.frombuffer(block, dtype="<u8", count=lanes, offset=mark + 8).astype(np.uint64)
    steps = range(first * every, min(-(-n // lanes), last * every))
    out = np.empty(min(n, steps.stop * lanes) - steps.start * lanes, dtype=np.uint32)
    slots, freq, low, bits, mask = table.slots, table.freq, table.low, np.uint64(bits_), np.uint64((1 << bits_) - 1)
    for step in steps:
        a = (step - steps.start) * lanes
        k = min(lanes, len(out) - a)
        xs = x[:k]
        slot = xs & mask
        ids = slots[slot]
        out[a : a + k] = ids
        xs = freq[ids] * (xs >> bits) + slot - low[ids]
        need = np.flatnonzero(xs < _LOW)
        if len(need):
            xs[need] = (xs[need] << _32) | words[place : place + len(need)]
            place += len(need)
        x[:k] = xs
    if first == 0 and last == n_marks and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged block: ids")
    return out


TOKENS = "doc_id bigint, n_tokens bigint, width int, ids binary, tokens array<bigint>, counts array<bigint>"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row per document with its packed ids; the first row of each batch also carries the batch's id counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, press = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=1)
        width = enc.dtype.itemsize
        for batch in batches:
            for a, b, data, offsets in kernels.utf8_slices(batch["text"]):
                ids, pointers = enc.encode(data, offsets)
                seen = np.bincount(ids)
                kinds = np.flatnonzero(seen)
                n = b - a
                first = np.zeros(n + 1, dtype=np.int64)
                first[1:] = len(kinds)
                packed = [press.compress(ids[i:j].tobytes()) for i, j in zip(pointers, pointers[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, n), pa.array(np.diff(pointers)), pa.array(np.full(n, width, dtype=np.int32)), pa.array(packed, type=pa.binary()), kernels.lists(kinds, first, pa.int64()), kernels.lists(seen[kinds], first, pa.int64())],
                    names=["doc_id", "n_tokens", "width", "ids", "tokens", "counts"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, TOKENS)


BLOCKS = "part int, block int, base bigint, n_tokens bigint, doc_ids array<bigint>, doc_lens array<bigint>, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = 1 << 20, bits: int = 20) -> None:
    """Encode ``docs`` in ascending doc_id order to the folder ``path``.

    The ids are counted over all documents first (at most one row per id of the
    vocabulary comes to the driver), kept as a packed table, dealt by doc_id
    range, and encoded range by range.
    """
    spark = docs.sparkSession
    packed = workspace.materialize(tokenized(docs, tokenizer, end_id), "ids", "none")
    seen = packed.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy(F.col("x.tokens").alias("id")).agg(F.sum("x.counts").alias("n")).toArrow()
    table = Table.scaled(seen["id"].to_numpy(), seen["n"].to_numpy(), bits)
    total = int(seen["n"].to_numpy().sum()) if seen.num_rows else 0
    kept = spark.createDataFrame(pa.table({"id": pa.array(table.ids), "freq": pa.array(table.freqs)}), "id bigint, freq bigint") if len(table.ids) else spark.createDataFrame([], "id bigint, freq bigint")
    kept.withColumn("bits", F.lit(table.bits)).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, part = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        waiting, ids, held, block, base = [], [], 0, 0, 0
        for batch in batches:
            docs_, widths, blobs = batch["doc_id"].to_pylist(), batch["width"].to_pylist(), batch["ids"]
            for k in range(batch.num_rows):
                one = np.frombuffer(unpack.decompress(blobs[k].as_buffer()), dtype=f"<u{widths[k]}")
                waiting.append((docs_[k], len(one)))
                ids.append(one)
                held += len(one)
                if held >= block_ids:
                    yield _row(part, block, base, waiting, ids, shared.value)
                    block, base, held, waiting, ids = block + 1, base + held, 0, [], []
        if waiting:
            yield _row(part, block, base, waiting, ids, shared.value)

    n = max(1, -(-total // (8 * block_ids)), min(workspace.partitions(spark), -(-total // block_ids)))
    dealt = packed.select("doc_id", "width", "ids").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    dealt.mapInArrow(work, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Table:
    """The frequency table of the folder ``path``: a row per id of the vocabulary that occurs."""
    got = spark.read.schema("id bigint, freq bigint, bits int").parquet(f"{path}/table").toArrow().sort_by("id")
    return Table(got["id"].to_numpy(), got["freq"].to_numpy(), got["bits"][0].as_py() if got.num_rows else 20)


def _row(part, block, base, waiting, ids, table) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    row = [part, block, base, len(flat), [d for d, _ in waiting], [n for _, n in waiting], encode_block(flat, table)]
    return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)], names=["part", "block", "base", "n_tokens", "doc_ids", "doc_lens", "payload"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the folder ``path``: doc_id, start, n_tokens, ids_crc32, ids (packed little-endian u32)."""
    return _decoded(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), read_table(spark, path), True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, without the ids themselves."""
    return _decoded(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), read_table(spark, path), False)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """A row per span between checkpoints: part, block, span, ids (packed u32). Spans are decoded apart, by as many tasks as there are."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, span, payload in zip(*(batch[c].to_pylist() for c in ("part", "block", "span", "payload"))):
                ids = decode_block(payload, shared.value, span, span + 1).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in ((part, pa.int32()), (block, pa.int32()), (span, pa.int32()), (ids, pa.binary()))], names=["part", "block", "span", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    n = F.conv(F.hex(F.reverse(F.substring("payload", HEAD_MARKS + 1, 4))), 16, 10).cast("int")
    spans = blocks.select("part", "block", "payload", F.explode(F.sequence(F.lit(0), n - 1)).alias("span"))
    return spans.repartition(workspace.partitions(spark), "part", "block", "span").mapInArrow(work, "part int, block int, span int, ids binary")


def _decoded(blocks: DataFrame, table: Table, with_ids: bool) -> DataFrame:
    spark = blocks.sparkSession
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row for each range of doc_ids
    starts, at = {}, 0
    for part, n in sizes:
        starts[part], at = at, at + n
    shared = spark.sparkContext.broadcast((table, starts))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decode_block(batch["payload"][k].as_py(), table).astype("<u4")
                docs, lens = batch["doc_ids"][k].values, batch["doc_lens"][k].values.to_numpy()
                ends = np.cumsum(lens)
                start = starts[batch["part"][k].as_py()] + batch["base"][k].as_py() + ends - lens
                bytes_ = [ids[e - n : e].tobytes() for e, n in zip(ends, lens)]
                columns = [docs, pa.array(start), pa.array(lens), pa.array([zlib.crc32(x) for x in bytes_], type=pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(bytes_, type=pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return blocks.select("part", "base", "doc_ids", "doc_lens", "payload").mapInArrow(work, schema)
