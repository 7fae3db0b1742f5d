"""Handles of matrices and vectors: a DataFrame of coordinates and what is known without reading it.

A matrix is a relation (i, j, v), a vector (i, v); a cell without a row is zero,
and a bit is there or not (v is true). A handle never changes its DataFrame's
content; an assignment puts a new DataFrame into the handle.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.functions import properties as P

STRUCTURES = ("dense", "triangular", "causal", "diagonal", "identity", "symmetric", "antisymmetric")
#: Structures whose cells lie in a strict or full upper triangle.
UPPER = ("triangular", "causal")


class DTypeWarning(UserWarning):
    """A value changed its element type."""


class OverflowRiskWarning(UserWarning):
    """An integer result may not fit."""


class PerformanceWarning(UserWarning):
    """A plan that is slow or large."""


class StorageWarning(UserWarning):
    """Something about stored data."""


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no active SparkSession")
    return found


class Array:
    """What matrices and vectors share."""

    axes: tuple[str, ...]

    def __init__(self, df: DataFrame, dtype: str, structure: str = "dense", props: Mapping | None = None):
        self.dtype, self.structure = D.normalize(dtype), structure
        self.df = df.select(*self.axes, "v")
        self._props = P.Properties(props, self.shape)

    @property
    def shape(self) -> tuple[int, int]:
        raise NotImplementedError

    @property
    def properties(self) -> P.Properties:
        return self._props

    @properties.setter
    def properties(self, values: Mapping) -> None:
        self._props = P.Properties(values, self.shape)

    @property
    def is_complex(self) -> bool:
        return D.is_complex(self.dtype)

    def size(self) -> int:
        r, c = self.shape
        return r * c

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def eval(self):
        """The handle with its rows kept in executors' memory and disk."""
        self.df.persist()
        return self

    def close(self) -> None:
        self.df.unpersist()

    def copy(self):
        raise NotImplementedError

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def as_type(self, dtype: str):
        """The same values as another element type; a value that does not fit raises."""
        dtype = D.normalize(dtype)
        if dtype == self.dtype:
            return self
        return self._new(self.df.withColumn("v", D.cast(F.col("v"), self.dtype, dtype)), dtype)

    def _new(self, df, dtype=None, structure=None, props=None):
        raise NotImplementedError

    def values_as(self, dtype: str) -> Column:
        return D.cast(F.col("v"), self.dtype, dtype)

    def __array__(self, dtype=None, copy=None):
        from tessera.sources.storage import to_numpy

        return to_numpy(self, dtype=dtype)

    __array_ufunc__ = None

    # Operators, all in tessera.operators.elementwise and products

    def __add__(self, other):
        from . import elementwise

        return elementwise.add(self, other)

    def __radd__(self, other):
        from . import elementwise

        return elementwise.add(other, self)

    def __sub__(self, other):
        from . import elementwise

        return elementwise.subtract(self, other)

    def __rsub__(self, other):
        from . import elementwise

        return elementwise.subtract(other, self)

    def __mul__(self, other):
        from . import elementwise

        return elementwise.multiply(self, other)

    def __rmul__(self, other):
        from . import elementwise

        return elementwise.multiply(other, self)

    def __truediv__(self, other):
        from . import elementwise

        return elementwise.divide(self, other)

    def __rtruediv__(self, other):
        from . import elementwise

        return elementwise.divide(other, self)

    def __neg__(self):
        from . import elementwise

        return elementwise.negative(self)

    def __invert__(self):
        from . import elementwise

        return elementwise.bitwise_not(self)

    def __and__(self, other):
        from . import elementwise

        return elementwise.bitwise(self, other, "and")

    def __or__(self, other):
        from . import elementwise

        return elementwise.bitwise(self, other, "or")

    def __xor__(self, other):
        from . import elementwise

        return elementwise.bitwise(self, other, "xor")

    def __matmul__(self, other):
        from . import products

        return products.matmul(self, other)

    def __rmatmul__(self, other):
        from . import products

        return products.matmul(other, self)


class Matrix(Array):
    axes = ("i", "j")

    def __init__(self, df: DataFrame, rows: int, cols: int, dtype: str, structure: str = "dense", props: Mapping | None = None, row_partitions=None, col_partitions=None):
        self._shape = (int(rows), int(cols))
        if structure not in STRUCTURES:
            raise ValueError(f"unknown structure {structure!r}")
        if structure not in ("dense", "identity") and rows != cols:
            raise ValueError(f"a {structure} matrix is square")
        self.row_partitions, self.col_partitions = row_partitions, col_partitions
        super().__init__(df, dtype, structure, props)

    @property
    def shape(self):
        return self._shape

    def rows(self) -> int:
        return self._shape[0]

    def cols(self) -> int:
        return self._shape[1]

    def __len__(self):
        return self._shape[0]

    def _new(self, df, dtype=None, structure=None, props=None, shape=None):
        r, c = shape or self._shape
        return Matrix(df, r, c, dtype or self.dtype, structure or (self.structure if shape is None else "dense"), props)

    def copy(self):
        return Matrix(self.df, *self._shape, self.dtype, self.structure, dict(self._props), self.row_partitions, self.col_partitions)

    copy_storage = copy

    @property
    def T(self):
        """Rows and columns swapped: a projection."""
        df = self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        structure = "dense" if self.structure in UPPER else self.structure
        props = P.through(self._props, "transpose", not self.is_complex)
        if self.structure in UPPER:
            props.setdefault("is_lower_triangular", True)
        return self._new(df, structure=structure, shape=self._shape[::-1], props=props)

    def transpose(self):
        return self.T

    def conj(self):
        return self._new(self.df.withColumn("v", D.conjugate(F.col("v"), self.dtype)), props=P.through(self._props, "conj", not self.is_complex))

    conjugate = conj

    @property
    def H(self):
        out = self.T.conj()
        out.properties = P.through(self._props, "adjoint", not self.is_complex)
        return out

    # Indexing

    def get(self, i: int, j: int):
        return self[i, j]

    def __getitem__(self, key):
        from . import indexing

        return indexing.get(self, key)

    def __setitem__(self, key, value):
        from . import indexing

        out = indexing.assigned(self, key, value)
        self.df, self.structure, self._props = out.df, out.structure, out._props

    def set(self, i: int, j: int, value) -> None:
        self[i, j] = value

    def fill(self, value):
        """All cells become ``value``; returns the handle."""
        from tessera.sources.constructors import full

        self.df, self.structure, self._props = full(self._shape, value, self.dtype, self.spark).df, "dense", P.Properties({"is_zero": True} if value == 0 else {}, self._shape)
        return self

    def set_identity(self):
        from tessera.sources.constructors import identity

        self.df = identity(list(self._shape), dtype=self.dtype, spark=self.spark).df
        self.structure, self._props = "dense", P.Properties({"is_identity": True, "is_diagonal": True, "diagonal_value": 1, "has_unit_diagonal": True}, self._shape)
        return self

    def get_diagonal(self) -> "Vector":
        return Vector(self.df.filter("i = j").select("i", "v"), min(self._shape), self.dtype)

    def set_diagonal(self, values) -> None:
        from tessera.sources.constructors import vector

        v = values if isinstance(values, Vector) else vector(values, dtype=self.dtype)
        self.df = self.df.filter("i <> j").unionByName(v.as_type(self.dtype).df.select("i", F.col("i").alias("j"), "v"))
        self._props = P.Properties(P.written(self._props, False, False, True), self._shape)

    # Blocks

    def get_block(self, r: int, c: int) -> "Matrix":
        from . import blocks

        return blocks.get_block(self, r, c)

    def set_block(self, r: int, c: int, value: "Matrix") -> "Matrix":
        from . import blocks

        return blocks.set_block(self, r, c, value)

    def refine_partitions(self, rows, cols) -> "Matrix":
        from . import blocks

        return blocks.refine(self, rows, cols)

    # Names of the operations

    def multiply(self, other):
        return self @ other

    matmul = multiply

    def elementwise_multiply(self, other):
        return self * other

    def trace(self):
        from . import reductions

        return reductions.trace(self)

    def determinant(self):
        from . import reductions

        return reductions.determinant(self)

    def invert(self):
        from . import linalg

        return linalg.invert(self)

    inverse = invert

    def qr(self):
        from . import linalg

        return linalg.qr(self)

    def lu(self):
        from . import linalg

        return linalg.lu(self)

    def __repr__(self):
        return f"Matrix({self._shape[0]}x{self._shape[1]}, {self.dtype}, {self.structure})"

    def __str__(self):
        return preview(self)


class Vector(Array):
    axes = ("i",)

    def __init__(self, df: DataFrame, n: int, dtype: str, is_row: bool = False, props: Mapping | None = None):
        self._n, self.is_row = int(n), is_row
        super().__init__(df, dtype, "dense", props)

    @property
    def shape(self):
        return (1, self._n) if self.is_row else (self._n, 1)

    def __len__(self):
        return self._n

    def _new(self, df, dtype=None, structure=None, props=None, n=None):
        return Vector(df, self._n if n is None else n, dtype or self.dtype, self.is_row, props)

    def copy(self):
        return Vector(self.df, self._n, self.dtype, self.is_row, dict(self._props))

    copy_storage = copy

    @property
    def T(self):
        return Vector(self.df, self._n, self.dtype, not self.is_row, {k: v for k, v in self._props.items()})

    def transpose(self):
        return self.T

    def conj(self):
        return self._new(self.df.withColumn("v", D.conjugate(F.col("v"), self.dtype)), props=P.through(self._props, "conj", not self.is_complex))

    conjugate = conj

    @property
    def H(self):
        return self.conj().T

    def __getitem__(self, key):
        from . import indexing

        return indexing.get_vector(self, key)

    def __setitem__(self, key, value):
        from . import indexing

        out = indexing.assigned_vector(self, key, value)
        self.df, self._props = out.df, out._props

    def get(self, i: int):
        return self[i]

    def set(self, i: int, value) -> None:
        self[i] = value

    def fill(self, value):
        from tessera.sources.constructors import full_vector

        self.df, self._props = full_vector(self._n, value, self.dtype, self.spark).df, P.Properties({}, self.shape)
        return self

    def dot(self, other):
        from . import reductions

        return reductions.dot(self, other)

    def __repr__(self):
        return f"Vector({self._n}, {self.dtype}{', row' if self.is_row else ''})"

    def __str__(self):
        return preview(self)


def preview(x: Array, edge: int = 3) -> str:
    """The edge items of an array; reads those cells only."""
    r, c = x.shape
    if isinstance(x, Vector):
        r, c = len(x), 1
    rows = list(range(r)) if r <= 2 * edge else [*range(edge), *range(r - edge, r)]
    cols = list(range(c)) if c <= 2 * edge else [*range(edge), *range(c - edge, c)]
    df = x.df.filter(F.col("i").isin(rows))
    df = df.filter(F.col("j").isin(cols)) if isinstance(x, Matrix) else df.withColumn("j", F.lit(0))
    cells = {(row["i"], row["j"]): D.python_value(row["v"], x.dtype) for row in df.collect()}
    zero = D.python_value(None, x.dtype)
    lines = []
    for k, i in enumerate(rows):
        if k and i != rows[k - 1] + 1:
            lines.append("...")
        own = [str(cells.get((i, j), zero)) for j in cols]
        if len(cols) < c:
            own.insert(edge, "...")
        lines.append("[" + ", ".join(own) + "]")
    return f"{x!r}\n" + "\n".join(lines)


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """All cells of a matrix: one range, no join."""
    if rows * cols > 10**9:
        warnings.warn(f"a grid of {rows}x{cols} cells", PerformanceWarning, stacklevel=3)
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("bigint").alias("i") if cols else F.col("id").alias("i"), (F.col("id") % max(cols, 1)).alias("j"))


def densified(x: Array) -> DataFrame:
    """A row for every cell, zeros included."""
    if isinstance(x, Vector):
        return x.spark.range(len(x)).select(F.col("id").alias("i")).join(x.df, "i", "left").withColumn("v", F.coalesce("v", D.zero(x.dtype)))
    return grid(x.spark, *x.shape).join(x.df, ["i", "j"], "left").withColumn("v", F.coalesce("v", D.zero(x.dtype)))


def is_number(x) -> bool:
    return isinstance(x, (bool, int, float, complex, np.number, np.bool_))


def scalar_type(x) -> str:
    if isinstance(x, np.generic):
        return D.normalize(x.dtype)
    return "complex_float64" if isinstance(x, complex) else "float64" if isinstance(x, float) else "int64"
