"""Block matrices: one relation with shifted coordinates, and the boundaries between blocks on the handle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tessera.functions import dtypes as D

from .array import Matrix


def block_matrix(blocks) -> Matrix:
    """A rectangular grid of matrices; heights agree in a row of the grid, widths in a column."""
    blocks = [[b() if isinstance(b, Thunk) else b for b in row] for row in blocks]
    if not blocks or len({len(row) for row in blocks}) != 1 or not blocks[0]:
        raise ValueError("a grid is rectangular and not empty")
    heights = [row[0].shape[0] for row in blocks]
    widths = [b.shape[1] for b in blocks[0]]
    for row, h in zip(blocks, heights):
        for b, w in zip(row, widths):
            if b.shape != (h, w):
                raise ValueError(f"a block of {b.shape} where {(h, w)} fits")
    out = blocks[0][0].dtype
    for row in blocks:
        for b in row:
            out = b.dtype if b.dtype == out else D.resolve("add", out, b.dtype)
    down, right, df = _bounds(heights), _bounds(widths), None
    for row, i0 in zip(blocks, down):
        for b, j0 in zip(row, right):
            one = b.df.select((F.col("i") + i0).alias("i"), (F.col("j") + j0).alias("j"), D.cast(F.col("v"), b.dtype, out).alias("v"))
            df = one if df is None else df.unionByName(one)
    return Matrix(df, down[-1], right[-1], out, row_partitions=down, col_partitions=right)


def _bounds(sizes) -> list[int]:
    out = [0]
    for n in sizes:
        out.append(out[-1] + n)
    return out


def _partitions(m: Matrix) -> tuple[list[int], list[int]]:
    return m.row_partitions or [0, m.shape[0]], m.col_partitions or [0, m.shape[1]]


def get_block(m: Matrix, r: int, c: int) -> Matrix:
    rows, cols = _partitions(m)
    if not (0 <= r < len(rows) - 1 and 0 <= c < len(cols) - 1):
        raise IndexError((r, c))
    return m[rows[r] : rows[r + 1], cols[c] : cols[c + 1]]


def set_block(m: Matrix, r: int, c: int, value: Matrix) -> Matrix:
    """``m`` with one block replaced."""
    rows, cols = _partitions(m)
    box = rows[r], rows[r + 1], cols[c], cols[c + 1]
    if value.shape != (box[1] - box[0], box[3] - box[2]):
        raise ValueError(f"a block of {value.shape} does not fit")
    outside = (F.col("i") < box[0]) | (F.col("i") >= box[1]) | (F.col("j") < box[2]) | (F.col("j") >= box[3])
    new = value.df.select((F.col("i") + box[0]).alias("i"), (F.col("j") + box[2]).alias("j"), D.cast(F.col("v"), value.dtype, m.dtype).alias("v"))
    return Matrix(m.df.filter(outside).unionByName(new), *m.shape, m.dtype, row_partitions=rows, col_partitions=cols)


def refine(m: Matrix, rows, cols) -> Matrix:
    """``m`` with more boundaries; the old ones must be among them."""
    old = _partitions(m)
    new = sorted(set(rows)), sorted(set(cols))
    for a, b in zip(old, new):
        if not set(a) <= set(b):
            raise ValueError("boundaries can only be added")
    return Matrix(m.df, *m.shape, m.dtype, m.structure, dict(m.properties), *new)


def with_blocks(m: Matrix):
    """Rows of ``m`` with the block they are in: bi, bj, i, j, v."""
    rows, cols = _partitions(m)

    def bucket(axis, bounds):
        return F.expr(f"size(filter(array({', '.join(map(str, bounds[1:-1])) or '-1'}), b -> b <= {axis} and b >= 0))").cast("int")

    return m.df.select(bucket("i", rows).alias("bi"), bucket("j", cols).alias("bj"), "i", "j", "v")


def common(a: Matrix, b: Matrix) -> tuple[Matrix, Matrix]:
    """Both with the union of their boundaries."""
    (ar, ac), (br, bc) = _partitions(a), _partitions(b)
    return refine(a, {*ar, *br}, {*ac, *bc}), refine(b, {*ar, *br}, {*ac, *bc})


class Thunk:
    """A block that is made when it is first needed, and then kept."""

    def __init__(self, make: Callable[[], Matrix]):
        self._make, self._made = make, None

    def __call__(self) -> Matrix:
        if self._made is None:
            self._made = self._make()
        return self._made
