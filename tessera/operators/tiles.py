"""Sparse products by tiles of the result.

Cells of both sides that share the inner index are packed: on the side whose
outer index is longer by block of that index, on the other to lists. A block of
the result gets each list once for each of its packed cells' inner indices, and
NumPy multiplies and sums there, so no pair of cells is ever shuffled.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frames import parts

#: Columns of a tile, and cells of a packed list: as a power of two.
WIDE, LIST = 12, 10
#: Rows of a block, at most, and blocks wanted below that.
ROWS, BLOCKS = 256, 32
#: Tiles that a task holds as dense sums: 9 bytes a cell, 288 MB at most.
HELD = 32
#: Pairs of cells that are multiplied at once, and sums that are kept before equal cells are merged.
CHUNK, RUNS = 1 << 21, 1 << 23
#: Stands for a null index.
NULL = -(1 << 63)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no package


def product(left: DataFrame, right: DataFrame, rows: int, cols: int, kind: str) -> DataFrame:
    """i, j, v: sums of x * y over equal k of (i, k, x) and (k, j, y), whose values are ``kind``: bigint or double."""
    if cols > rows:
        out = product(right.select(F.col("j").alias("i"), "k", F.col("y").alias("x")), left.select("k", F.col("i").alias("j"), F.col("x").alias("y")), cols, rows, kind)
        return out.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    bits = min(ROWS, max(1, rows // BLOCKS)).bit_length() - 1
    tasks = max(parts(left, right), left.sparkSession.sparkContext.defaultParallelism)

    def packed(df, axis, value, shift):
        keyed = df.filter("k is not null").repartition(tasks, "k").withColumn(axis, F.coalesce(axis, F.lit(NULL)))
        lists = keyed.groupBy("k", F.shiftright(axis, shift).alias("b")).agg(F.collect_list(F.struct(axis, value)).alias("l"))
        return lists.select("k", "b", F.col(f"l.{axis}").alias(axis), F.col(f"l.{value}").alias(value))

    both = packed(left, "i", "x", bits).join(packed(right, "j", "y", LIST).drop("b"), "k")
    blocks = min(-(-rows >> bits), 4096)
    dealt = both.select("b", "i", "x", "j", "y").repartitionById(blocks, F.pmod("b", F.lit(blocks)).cast("int")).sortWithinPartitions("b")
    summed = dealt.mapInArrow(lambda batches: _summed(batches, bits, kind), f"i bigint, j bigint, v {kind}")
    null = F.lit(NULL)
    return summed.select(F.nullif("i", null).alias("i"), F.nullif("j", null).alias("j"), "v")


def _summed(batches, bits: int, kind: str):
    """Sums of the blocks of a partition; rows of a block follow each other."""
    own = None
    for batch in batches:
        b = batch["b"].to_numpy()
        sides = [(batch[a].offsets.to_numpy().astype(np.int64), batch[a].values.to_numpy(), *_values(batch[v].values)) for a, v in (("i", "x"), ("j", "y"))]
        pairs = np.concatenate(([0], np.cumsum(np.diff(sides[0][0]) * np.diff(sides[1][0]))))
        ends = np.append(np.flatnonzero(np.diff(b)) + 1, len(b))
        at = 0
        for end in ends if len(b) else ():
            if own is None or own.block != b[at]:
                if own is not None:
                    yield from own.cells()
                own = _Block(int(b[at]), bits, kind, own)
            while at < end:
                to = min(int(end), max(at + 1, int(np.searchsorted(pairs, pairs[at] + CHUNK, "right")) - 1))
                own.add(*(part for side in sides for part in _cut(side, at, to)))
                at = to
    if own is not None:
        yield from own.cells()


def _values(v: pa.Array):
    """Values with nulls as zeros, and where the nulls are."""
    if not v.null_count:
        return v.to_numpy(), None
    return v.fill_null(0).to_numpy(), v.is_null().to_numpy(zero_copy_only=False)


def _cut(side, at: int, to: int):
    """Rows of a list column: offsets from 0, indices, values, nulls."""
    offsets, index, value, null = side
    s, e = offsets[at], offsets[to]
    return offsets[at : to + 1] - s, index[s:e], value[s:e], None if null is None else null[s:e]


class _Block:
    """Sums of one block of rows: dense tiles, and runs of single cells when there are too many tiles or integers may not fit."""

    def __init__(self, block: int, bits: int, kind: str, before: _Block | None):
        self.block, self.bits, self.kind = block, bits, kind
        self.tile = 1 << bits + WIDE
        self.acc, self.seen = (before.acc, before.seen) if before else (np.zeros(HELD * self.tile, np.float64 if kind == "double" else np.int64), np.zeros(HELD * self.tile, np.uint8))
        self.slots: dict[int, int] = {}  # first column >> WIDE: place of the tile
        self.runs, self.kept, self.merged, self.most = [], 0, 0, 0

    def add(self, lo, i, x, xnull, ro, j, y, ynull):
        """Multiplies each cell of a row's left list with each of its right list."""
        wide = j >> WIDE
        found = np.unique(wide)
        if len(found) > HELD:
            for k in range(0, len(found), HELD):
                some = (wide >= found[k]) & (wide <= found[min(k + HELD, len(found)) - 1])
                self.add(lo, i, x, xnull, np.concatenate(([0], np.cumsum(some)))[ro], j[some], y[some], None if ynull is None else ynull[some])
            return
        if not len(i) or not len(j):
            return
        row = np.repeat(np.arange(len(lo) - 1), np.diff(lo))
        times = np.diff(ro)[row]
        n = int(times.sum())
        other = np.arange(n) + np.repeat(ro[row] - np.cumsum(times) + times, times)
        null = None
        if xnull is not None or ynull is not None:
            null = (np.repeat(xnull, times) if xnull is not None else False) | (ynull[other] if ynull is not None else False)
        local = i & ((1 << self.bits) - 1)
        if self.kind == "bigint":
            self.most += n * max(abs(int(x.min())), abs(int(x.max()))) * max(abs(int(y.min())), abs(int(y.max())))
            if self.most >> 63:  # too large for sums in 64 bits to be sure: exact integers
                self.flush()
                v = np.repeat(x.astype(object), times) * y.astype(object)[other]
                self.keep(np.repeat(local, times), j[other], v, np.where(null, 1, 2).astype(np.uint8) if null is not None else np.full(n, 2, np.uint8))
                return
        if len(self.slots.keys() | set(found.tolist())) > HELD:
            self.flush()
        for w in found.tolist():
            self.slots.setdefault(w, len(self.slots))
        place = np.array([self.slots[w] for w in found.tolist()])
        right = (place[np.searchsorted(found, wide)] if len(found) > 1 else place[0]) * self.tile + (j & ((1 << WIDE) - 1))
        at = np.repeat(local << WIDE, times) + right[other]
        with np.errstate(all="ignore"):
            v = np.repeat(x, times) * y[other]
            if null is None:
                np.add.at(self.acc, at, v)
                self.seen[at] = 2
                return
            np.add.at(self.acc, at[~null], v[~null])
        self.seen[at[null]] = np.maximum(self.seen[at[null]], 1)
        self.seen[at[~null]] = 2

    def flush(self):
        """Sums of the tiles to a run."""
        for part in self.dense(None):
            self.keep(*part)

    def dense(self, rows: int | None):
        """Row in the block, column, sum and mark of the cells of the tiles, by ``rows`` cells; the tiles are empty then."""
        used = len(self.slots) * self.tile
        first = np.array(list(self.slots), dtype=np.int64)
        at = np.flatnonzero(self.seen[:used])
        for k in range(0, len(at), rows or max(1, len(at))):
            some = at[k : k + rows] if rows else at
            cell = some & (self.tile - 1)
            yield cell >> WIDE, first[some >> self.bits + WIDE] << WIDE | cell & ((1 << WIDE) - 1), self.acc[some], self.seen[some]
        self.acc[:used], self.seen[:used] = 0, 0
        self.slots = {}

    def keep(self, *run):
        self.runs.append(run)
        self.kept += len(run[0])
        if self.kept > 2 * self.merged + RUNS:
            self.merge()

    def merge(self):
        """One run of different cells."""
        i, j, v, seen = (np.concatenate(x) for x in zip(*self.runs))
        order = np.lexsort((j, i))
        i, j, v, seen = i[order], j[order], v[order], seen[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 0) | (np.diff(j) != 0))))
        with np.errstate(all="ignore"):
            self.runs = [(i[first], j[first], np.add.reduceat(v, first), np.maximum.reduceat(seen, first))]
        self.kept = self.merged = len(first)

    def cells(self, rows: int = 1 << 18):
        """Batches of the block's cells."""
        if self.runs:
            self.flush()
            self.merge()
            whole = self.runs[0]
            found = (tuple(x[k : k + rows] for x in whole) for k in range(0, len(whole[0]), rows))
        else:
            found = self.dense(rows)
        for i, j, v, seen in found:
            if v.dtype == object:
                if any(s >> 63 not in (0, -1) for s in v):
                    raise OverflowError("a sum of products does not fit 64 bits")
                v = v.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(i + (self.block << self.bits)), pa.array(j), pa.array(v, mask=seen == 1)], names=["i", "j", "v"])


__all__ = ["product"]
