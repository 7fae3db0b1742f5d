"""Reading and replacing parts: filters with shifted indices, joins with index lists, anti-joins for assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.functions import properties as P

from .array import Array, Matrix, Vector, is_number

#: Index lists of at most so many entries are broadcast.
SMALL = 1 << 20


class _Axis:
    """What a key selects on one axis: a single index, a stepped range, or a list."""

    def __init__(self, key, n: int):
        self.n, self.single, self.range, self.list = n, None, None, None
        if isinstance(key, (int, np.integer)) and not isinstance(key, (bool, np.bool_)):
            k = int(key) + (n if key < 0 else 0)
            if not 0 <= k < n:
                raise IndexError(f"index {key} of {n}")
            self.single, self.range = k, range(k, k + 1)
        elif isinstance(key, slice):
            self.range = range(*key.indices(n))
        else:
            found = np.asarray(key)
            if found.ndim != 1:
                raise IndexError("an index list has one dimension")
            if found.dtype == bool:
                if len(found) != n:
                    raise IndexError(f"a mask of {len(found)} on an axis of {n}")
                found = np.flatnonzero(found)
            elif len(found) and found.dtype.kind not in "iu":
                raise IndexError("indices are integers")
            found = np.where(found < 0, found + n, found).astype(np.int64)
            if len(found) and not (0 <= found.min() and found.max() < n):
                raise IndexError(f"an index is out of {n}")
            self.list = found

    def __len__(self):
        return len(self.list) if self.list is not None else len(self.range)

    def places(self, spark) -> DataFrame:
        """place in the result, source index."""
        if self.list is None:
            r = self.range
            return spark.range(len(r)).select(F.col("id").alias("place"), (F.lit(r.start) + F.col("id") * r.step).alias("source"))
        import pyarrow as pa

        if not len(self.list):
            return spark.createDataFrame([], "place bigint, source bigint")
        return spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(self.list))), "source": pa.array(self.list)}))

    def pick(self, df: DataFrame, axis: str) -> DataFrame:
        """The selected rows with their new index."""
        if self.list is None:
            r = self.range
            if not len(r):
                return df.limit(0)
            c = F.col(axis)
            lo, hi = min(r[0], r[-1]), max(r[0], r[-1])
            df = df.filter((c >= lo) & (c <= hi))
            if abs(r.step) != 1:
                df = df.filter((c - r.start) % abs(r.step) == 0)
            return df.withColumn(axis, ((c - r.start) / r.step).cast("bigint") if abs(r.step) != 1 else (c - r.start) * r.step)
        places = self.places(df.sparkSession)
        places = F.broadcast(places) if len(self.list) <= SMALL else places
        return df.join(places, df[axis] == places["source"]).drop(axis, "source").withColumnRenamed("place", axis)


def _keys(key, shape) -> tuple[_Axis, _Axis]:
    key = key if isinstance(key, tuple) else (key,)
    if Ellipsis in [k for k in key if k is Ellipsis]:
        at = next(k for k, x in enumerate(key) if x is Ellipsis)
        key = key[:at] + (slice(None),) * (3 - len(key)) + key[at + 1 :]
    key = key + (slice(None),) * (2 - len(key))
    if len(key) != 2:
        raise IndexError("a matrix has two axes")
    return _Axis(key[0], shape[0]), _Axis(key[1], shape[1])


def get(m: Matrix, key):
    """A number for two integers; else a matrix, also where one axis has a single index. Two lists are taken pairwise."""
    rows, cols = _keys(key, m.shape)
    if rows.single is not None and cols.single is not None:
        found = m.df.filter((F.col("i") == rows.single) & (F.col("j") == cols.single)).select("v").first()
        value = D.python_value(found["v"] if found else None, m.dtype)
        return float(value) if m.structure == "causal" else value
    if rows.list is not None and cols.list is not None:
        if len(rows.list) != len(cols.list):
            raise IndexError("index lists differ in length")
        import pyarrow as pa

        want = m.spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(rows.list))), "a": pa.array(rows.list), "b": pa.array(cols.list)})) if len(rows.list) else m.spark.createDataFrame([], "place bigint, a bigint, b bigint")
        want = F.broadcast(want) if len(rows.list) <= SMALL else want
        df = m.df.join(want, (F.col("i") == F.col("a")) & (F.col("j") == F.col("b"))).select(F.lit(0).cast("bigint").alias("i"), F.col("place").alias("j"), "v")
        return Matrix(df, 1, len(rows.list), m.dtype)
    df = cols.pick(rows.pick(m.df, "i"), "j")
    return Matrix(df, len(rows), len(cols), m.dtype)


def get_vector(v: Vector, key):
    axis = _Axis(key, len(v))
    if axis.single is not None:
        found = v.df.filter(F.col("i") == axis.single).select("v").first()
        return D.python_value(found["v"] if found else None, v.dtype)
    return v._new(axis.pick(v.df, "i"), n=len(axis))


def _bit_checked(value):
    if is_number(value) and value not in (0, 1):
        raise TypeError("a bit is 0 or 1")


def assigned(m: Matrix, key, value) -> Matrix:
    """``m`` with the selected cells replaced by a number, or by an array that is broadcast to them."""
    from .elementwise import _stretched, lift

    rows, cols = _keys(key, m.shape)
    pairwise = rows.list is not None and cols.list is not None
    if m.dtype == "bit":
        _bit_checked(value)
    if m.structure in ("causal", "triangular", "diagonal") and rows.single is not None and cols.single is not None:
        inside = {"causal": rows.single < cols.single, "triangular": rows.single <= cols.single, "diagonal": rows.single == cols.single}[m.structure]
        if not inside:
            if m.structure == "causal":
                import warnings

                warnings.warn("an assignment outside the strict upper triangle is ignored", UserWarning, stacklevel=3)
                return m
            if value != 0:
                raise ValueError(f"outside a {m.structure} matrix")
    spark = m.spark
    if pairwise:
        import pyarrow as pa

        n = len(rows.list)
        cells = spark.createDataFrame(pa.table({"r": pa.array(np.zeros(n, dtype=np.int64)), "c": pa.array(np.arange(n)), "i": pa.array(rows.list), "j": pa.array(cols.list)}))
        shape = (1, n)
    else:
        r, c = rows.places(spark), cols.places(spark)
        cells = r.select(F.col("place").alias("r"), F.col("source").alias("i")).crossJoin(c.select(F.col("place").alias("c"), F.col("source").alias("j")))  # exactly the cells that are written
        shape = (len(rows), len(cols))
    rest = m.df.join(cells.select("i", "j"), ["i", "j"], "left_anti")
    if is_number(value):
        new = cells.select("i", "j").distinct().withColumn("v", D.literal(value, m.dtype)) if value != 0 else None
    else:
        x = lift(value, m)
        df = _stretched(x, shape).select(F.col("i").alias("r"), F.col("j").alias("c"), D.cast(F.col("v"), x.dtype, m.dtype).alias("v"))
        new = cells.join(df, ["r", "c"]).groupBy("i", "j").agg(F.max_by("v", F.struct("r", "c")).alias("v")) if pairwise else cells.join(df, ["r", "c"]).select("i", "j", "v")
    df = rest if new is None else rest.unionByName(new)
    above = below = diagonal = True
    if rows.single is not None and cols.single is not None:
        above, below, diagonal = rows.single < cols.single, rows.single > cols.single, rows.single == cols.single
    structure = m.structure if m.structure in ("dense",) or (rows.single is not None and cols.single is not None and m.structure in ("causal", "triangular", "diagonal")) else "dense"
    return Matrix(df, *m.shape, m.dtype, structure, P.written(m.properties, above, below, diagonal))


def assigned_vector(v: Vector, key, value) -> Vector:
    from .elementwise import lift

    axis = _Axis(key, len(v))
    if v.dtype == "bit":
        _bit_checked(value)
    cells = axis.places(v.spark)
    rest = v.df.join(cells.select(F.col("source").alias("i")), "i", "left_anti")
    if is_number(value):
        new = cells.select(F.col("source").alias("i")).distinct().withColumn("v", D.literal(value, v.dtype))
        df = rest.unionByName(new) if value != 0 else rest
    else:
        x = lift(value, v)
        if not isinstance(x, Vector) or len(x) != len(axis):
            raise ValueError("a vector of the selected length is needed")
        new = cells.join(x.df.select(F.col("i").alias("place"), D.cast(F.col("v"), x.dtype, v.dtype).alias("v")), "place").select(F.col("source").alias("i"), "v")
        df = rest.unionByName(new)
    return Vector(df, len(v), v.dtype, v.is_row, P.written(v.properties, True, True, True))


def submatrix(m: Array, row: int, col: int, rows: int, cols: int) -> Matrix:
    """A rectangle, as a filter with shifted indices; a view of a view is one filter after optimisation."""
    if row < 0 or col < 0 or row + rows > m.shape[0] or col + cols > m.shape[1]:
        raise IndexError("outside the matrix")
    return get(m, (slice(row, row + rows), slice(col, col + cols)))
