"""Matrices and vectors from data, from formulas and from seeded hashes."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.operators.array import Array, DTypeWarning, Matrix, Vector, grid, is_number, session

#: Cells of driver-side data that go into one frame at once.
CHUNK = 1 << 20


def _infer(data: np.ndarray) -> str:
    if data.dtype == object:
        raise TypeError("cells must be numbers")
    return {"b": "bit", "i": "int32", "u": "int32", "f": "float64", "c": "complex_float64"}.get(data.dtype.kind) or D.normalize(data.dtype)


def _frame(spark: SparkSession, columns: dict[str, np.ndarray], values: np.ndarray, dtype: str) -> DataFrame:
    """Coordinates and values that are on the driver as a frame with an explicit schema."""
    import pyarrow as pa

    kind = D.KINDS[dtype]
    if kind.family == "complex":
        part = pa.float64() if kind.bits == 64 else pa.float32()
        v = pa.StructArray.from_arrays([pa.array(values.real.astype(np.float64)).cast(part, safe=False), pa.array(values.imag.astype(np.float64)).cast(part, safe=False)], names=["re", "im"])
    elif dtype == "uint64":
        import decimal

        v = pa.array([decimal.Decimal(int(x)) for x in values], type=pa.decimal128(20, 0))
    else:
        of = {"bit": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "float16": pa.float32(), "float32": pa.float32(), "float64": pa.float64()}[dtype]
        v = pa.array(values).cast(of) if kind.family in ("int", "uint") and values.dtype != bool else pa.array(values.astype({"bit": bool, "float16": np.float16}.get(dtype, of.to_pandas_dtype())).astype(of.to_pandas_dtype()))
    table = pa.table({**{k: pa.array(x.astype(np.int64)) for k, x in columns.items()}, "v": v})
    schema = ", ".join(f"{k} bigint" for k in columns) + f", v {kind.sql}"
    return spark.createDataFrame(table).select(*[F.col(k).cast("bigint") for k in columns], F.col("v").cast(kind.sql).alias("v")) if table.num_rows else spark.createDataFrame([], schema)


def _checked(data: np.ndarray, dtype: str) -> np.ndarray:
    """Driver-side values as ``dtype``, or an error if they do not fit."""
    fam = D.family(dtype)
    if data.dtype.kind == "c" and fam != "complex":
        raise TypeError(f"complex numbers do not fit {dtype}")
    if fam in ("int", "uint"):
        whole = data.astype(np.int64) if data.dtype == bool else np.trunc(data) if data.dtype.kind == "f" else data
        bits = D.KINDS[dtype].bits
        lo, hi = (0, 2**bits - 1) if fam == "uint" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
        if whole.size and (int(whole.min()) < lo or int(whole.max()) > hi):
            raise OverflowError(f"values do not fit {dtype}")
        return whole.astype(dtype)
    return data


def from_numpy(data, dtype=None, spark: SparkSession | None = None) -> Array:
    """A 1-D or 2-D array; one-dimensional float32 becomes float64 as two-dimensional does not."""
    data, spark = np.asarray(data), spark or session()
    if data.ndim not in (1, 2):
        raise ValueError("one or two dimensions only")
    if dtype is None:
        name = "float64" if data.ndim == 1 and data.dtype == np.float32 else D.normalize(data.dtype)
    else:
        name = D.normalize(dtype)
    where = np.nonzero(data)
    values = _checked(data[where], name)
    if data.ndim == 1:
        return Vector(_frame(spark, {"i": where[0]}, values, name), len(data), name)
    return Matrix(_frame(spark, {"i": where[0], "j": where[1]}, values, name), *data.shape, name)


asarray = from_numpy


def matrix(source, dtype=None, spark: SparkSession | None = None, **how):
    """A matrix from a nested list or array, a vector from a flat one, a block matrix from a grid of matrices.

    A square list that is zero on and below the diagonal makes a triangular matrix.
    """
    if isinstance(source, Array):
        return source if dtype is None else source.as_type(dtype)
    if isinstance(source, np.ndarray):
        return from_numpy(source, dtype, spark)
    if is_number(source):
        raise TypeError("a single number is no matrix")
    if isinstance(source, Sequence) and source and isinstance(source[0], Sequence) and any(isinstance(x, Array) for row in source for x in row):
        if not all(isinstance(x, Matrix) for row in source for x in row):
            raise TypeError("a grid holds matrices only")
        from tessera.operators.blocks import block_matrix

        return block_matrix(source)
    data = np.array(source)
    if data.ndim == 0:
        raise TypeError("a single number is no matrix")
    if data.ndim > 2:
        raise ValueError("one or two dimensions only")
    name = D.normalize(dtype) if dtype is not None else _infer(data) if data.size else "float64"
    out = from_numpy(data, name, spark)
    if data.ndim == 2 and data.shape[0] == data.shape[1] > 1 and not np.tril(data).any():
        kind = "causal" if name == "bit" else "triangular" if name in ("float64", "int32") else "dense"
        if kind != "dense":
            return Matrix(out.df, *data.shape, name, kind)
    return out


def vector(source, dtype=None, spark: SparkSession | None = None, *, max_in_ram_bytes: int | None = None) -> Vector:
    """A vector from a flat list or array."""
    if isinstance(source, Vector):
        return source if dtype is None else source.as_type(dtype)
    data = np.asarray(source)
    if data.ndim != 1:
        raise ValueError("a vector has one dimension")
    name = D.normalize(dtype) if dtype is not None else (D.normalize(data.dtype) if isinstance(source, np.ndarray) else _infer(data) if data.size else "float64")
    return from_numpy(data, "float64" if dtype is None and isinstance(source, np.ndarray) and data.dtype == np.float32 else name, spark)


def from_frame(df: DataFrame, rows: int, cols: int | None = None, dtype: str | None = None, structure: str = "dense") -> Array:
    """A handle on a frame with columns i, (j,) v; cells that repeat are the user's error."""
    if dtype is None:
        found = dict(df.dtypes)["v"]
        dtype = next((k.name for k in D.KINDS.values() if k.sql == found and not k.name.startswith("uint") and k.name != "float16"), None)
        if dtype is None:
            raise TypeError(f"no element type for {found}")
    return Vector(df, rows, dtype) if cols is None else Matrix(df, rows, cols, dtype, structure)


def _shape(shape) -> tuple[int, ...]:
    shape = (shape,) if isinstance(shape, (int, np.integer)) else tuple(shape)
    if len(shape) not in (1, 2) or any(n < 0 for n in shape):
        raise ValueError(f"no shape: {shape}")
    return tuple(int(n) for n in shape)


def zeros(shape, *, dtype, spark: SparkSession | None = None):
    """No rows at all."""
    shape, name, spark = _shape(shape), D.normalize(dtype), spark or session()
    sql = D.KINDS[name].sql
    if len(shape) == 1:
        return Vector(spark.createDataFrame([], f"i bigint, v {sql}"), shape[0], name)
    return Matrix(spark.createDataFrame([], f"i bigint, j bigint, v {sql}"), *shape, name, props={"is_zero": True})


empty = zeros


def ones(shape, *, dtype, spark: SparkSession | None = None):
    shape, name, spark = _shape(shape), D.normalize(dtype), spark or session()
    return full_vector(shape[0], 1, name, spark) if len(shape) == 1 else full(shape, 1, name, spark)


def full(shape, value, dtype: str, spark: SparkSession | None = None) -> Matrix:
    spark = spark or session()
    cells = grid(spark, *shape) if value != 0 else grid(spark, 0, 1)
    return Matrix(cells.withColumn("v", D.literal(value, dtype)), *shape, dtype)


def full_vector(n: int, value, dtype: str, spark: SparkSession | None = None, is_row: bool = False) -> Vector:
    spark = spark or session()
    return Vector(spark.range(n if value != 0 else 0).select(F.col("id").alias("i"), D.literal(value, dtype).alias("v")), n, dtype, is_row)


def identity(x, dtype: str = "float64", spark: SparkSession | None = None) -> Matrix:
    """Ones on the diagonal; the size is a number, [rows, cols], or that of an array."""
    spark = spark or (x.spark if isinstance(x, Array) else session())
    if isinstance(x, Matrix):
        r, c = x.shape
    elif isinstance(x, Vector):
        r = c = len(x)
    elif isinstance(x, (list, tuple)):
        r, c = _shape(x)
    else:
        r = c = int(x)
    df = spark.range(min(r, c)).select(F.col("id").alias("i"), F.col("id").alias("j"), D.literal(1, dtype).alias("v"))
    return Matrix(df, r, c, dtype, "identity", {"is_identity": True, "is_diagonal": True} if r == c else {"is_identity": True})


I = identity  # noqa: E741


def diagonal_matrix(values, dtype: str = "float64", spark: SparkSession | None = None) -> Matrix:
    """A diagonal matrix of a size (then zero) or of diagonal values."""
    if isinstance(values, (int, np.integer)):
        z = zeros((values, values), dtype=dtype, spark=spark)
        return Matrix(z.df, values, values, z.dtype, "diagonal", {"is_diagonal": True})
    v = values if isinstance(values, Vector) else vector(values, dtype, spark)
    return Matrix(v.df.select("i", F.col("i").alias("j"), "v"), len(v), len(v), v.dtype, "diagonal", {"is_diagonal": True})


def unit_vector(n: int, active: int, spark: SparkSession | None = None) -> Vector:
    if not 0 <= active < n:
        raise IndexError(active)
    return from_frame((spark or session()).range(1).select(F.lit(active).cast("bigint").alias("i"), F.lit(1.0).alias("v")), n)


def causal_matrix(source, populate: bool = True, spark: SparkSession | None = None, p: float = 0.5, seed: int | None = None) -> Matrix:
    """Strictly upper bits: random of a size, or those of an array; values on and below the diagonal are ignored."""
    if isinstance(source, (int, np.integer)):
        return random_causal(int(source), p, seed, spark) if populate else Matrix(zeros((source, source), dtype="bit", spark=spark).df, source, source, "bit", "causal")
    m = source if isinstance(source, Matrix) else from_numpy(np.asarray(source), spark=spark)
    if m.shape[0] != m.shape[1]:
        raise ValueError("a causal matrix is square")
    if isinstance(source, np.ndarray) or not isinstance(source, Matrix):
        data = np.asarray(source)
        if np.tril(data).any():
            warnings.warn("values on and below the diagonal are ignored", UserWarning, stacklevel=2)
        if not np.isin(data, (0, 1)).all():
            warnings.warn("values other than 0 and 1 become bits", DTypeWarning, stacklevel=2)
    return Matrix(m.df.filter("i < j").filter(D.nonzero(F.col("v"), m.dtype)).withColumn("v", F.lit(True)), *m.shape, "bit", "causal")


def _bernoulli(p: float, seed: int):
    """Whether a cell is set: a hash of its place, so it does not depend on partitions."""
    if not 0 <= p <= 1:
        raise ValueError("p is a probability")
    return F.shiftrightunsigned(F.xxhash64("i", "j", F.lit(seed)), 11) < F.lit(int(p * (1 << 53)))


def _seed(seed: int | None) -> int:
    return int(np.random.default_rng().integers(1 << 62)) if seed is None else int(seed)


def random_causal(n: int, p: float = 0.5, seed: int | None = None, spark: SparkSession | None = None) -> Matrix:
    """Each cell above the diagonal with probability p."""
    spark = spark or session()
    cells = spark.range(n).select(F.col("id").alias("i")).filter(F.col("i") < n - 1).select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(n - 1).cast("bigint"))).alias("j"))
    return Matrix(cells.filter(_bernoulli(p, _seed(seed))).withColumn("v", F.lit(True)), n, n, "bit", "causal")


def random_bits(rows: int, cols: int, p: float = 0.5, seed: int | None = None, spark: SparkSession | None = None) -> Matrix:
    return Matrix(grid(spark or session(), rows, cols).filter(_bernoulli(p, _seed(seed))).withColumn("v", F.lit(True)), rows, cols, "bit")


def _mirrored(m: Matrix, sign: int) -> Matrix:
    other = m.df.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), (D.minus(F.col("v"), m.is_complex) if sign < 0 else F.col("v")).alias("v"))
    own = m.df.filter("i <= j" if sign > 0 else "i < j")
    return Matrix(own.unionByName(other), *m.shape, m.dtype, "symmetric" if sign > 0 else "antisymmetric")


def symmetric_from_triangular(m: Matrix) -> Matrix:
    """The upper triangle and its mirror image."""
    return _mirrored(m, 1)


def antisymmetric_from_triangular(m: Matrix) -> Matrix:
    """The strict upper triangle and its negated mirror image."""
    return _mirrored(m if m.dtype != "bit" else m.as_type("int32"), -1)


def _typed(name: str, dtype: str, dims: int):
    def make(*args, spark: SparkSession | None = None):
        if len(args) == 1 and not isinstance(args[0], (int, np.integer)):
            source = args[0]
            return (matrix if dims == 2 else vector)(source, dtype, spark) if isinstance(source, Array) else from_numpy(np.asarray(source), dtype, spark)
        if dims == 1:
            return zeros(int(args[0]), dtype=dtype, spark=spark)
        out = zeros(tuple(args) if len(args) == 2 else (args[0], args[0]), dtype=dtype, spark=spark)
        out.properties = {}
        return out

    make.__name__ = make.__qualname__ = name
    make.__doc__ = f"A {dtype} {'matrix' if dims == 2 else 'vector'} of zeros of a size, or of an array's values."
    return make


_NAMES = {
    "bit": "Bit", "int8": "Int8", "int16": "Int16", "int32": "Integer", "int64": "Int64", "uint8": "UInt8", "uint16": "UInt16", "uint32": "UInt32", "uint64": "UInt64",
    "float16": "Float16", "float32": "Float32", "float64": "Float", "complex_float16": "ComplexFloat16", "complex_float32": "ComplexFloat32", "complex_float64": "ComplexFloat64",
}
TYPED = {f"{prefix}{'Matrix' if dims == 2 else 'Vector'}": _typed(f"{prefix}{'Matrix' if dims == 2 else 'Vector'}", t, dims) for t, prefix in _NAMES.items() for dims in (1, 2)}
TYPED["DenseBitMatrix"] = TYPED.pop("BitMatrix")
