"""Elementwise operations. Sums are unions with one grouped sum, products inner joins; zeros stay absent wherever the operation keeps them."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.functions import properties as P
from tessera.functions.frames import spread

from .array import Array, Matrix, Vector, densified, is_number, scalar_type


def lift(x, like: Array):
    """NumPy arrays and lists as handles."""
    if isinstance(x, Array) or is_number(x):
        return x
    from tessera.sources.constructors import from_numpy

    return from_numpy(np.asarray(x), spark=like.spark)


def _both(a, b):
    like = a if isinstance(a, Array) else b
    return lift(a, like), lift(b, like)


def structure_of(op: str, a: Matrix, b: Matrix) -> str:
    """Structure of the elementwise result."""
    x, y = ("diagonal" if s == "identity" and m.shape[0] == m.shape[1] else "dense" if s == "identity" else s for s, m in ((a.structure, a), (b.structure, b)))
    if op == "mul":
        if "diagonal" in (x, y):
            return "diagonal"
        if {x, y} <= {"symmetric", "antisymmetric"}:
            return "symmetric" if x == y else "antisymmetric"
        for kind in ("causal", "triangular"):
            if kind in (x, y):
                return kind
        return "dense"
    if x == y:
        return x
    if {x, y} <= {"diagonal", "symmetric"}:
        return "symmetric"
    if {x, y} <= {"diagonal", "triangular", "causal"}:
        return "triangular"
    return "dense"


def _flat(x: Array) -> DataFrame:
    """Coordinates of ``x`` as a matrix has them."""
    return x.df if isinstance(x, Matrix) else x.df.select(*((F.lit(0).cast("bigint").alias("i"), F.col("i").alias("j")) if x.is_row else (F.col("i"), F.lit(0).cast("bigint").alias("j"))), "v")


def _stretched(x: Array, shape: tuple[int, int]) -> DataFrame:
    """Coordinates of ``x`` repeated to ``shape``."""
    df = _flat(x)
    for axis, own, whole in (("i", x.shape[0], shape[0]), ("j", x.shape[1], shape[1])):
        if own != whole:
            if own != 1:
                raise ValueError(f"shapes {x.shape} and {shape} do not fit")
            df = df.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(whole - 1).cast("bigint")))) if whole else df.limit(0)
    return df.select("i", "j", "v")


def _aligned(a: Array, b: Array):
    """``(frame of a, frame of b, maker of the result, keys)`` after broadcasting."""
    if isinstance(a, Vector) and isinstance(b, Vector) and a.is_row == b.is_row:
        if len(a) != len(b):
            raise ValueError(f"lengths {len(a)} and {len(b)} differ")
        return a.df, b.df, lambda df, t, s: Vector(df, len(a), t, a.is_row), ["i"]
    shape = tuple(max(p, q) if min(p, q) else 0 for p, q in zip(a.shape, b.shape))
    return _stretched(a, shape), _stretched(b, shape), lambda df, t, s: Matrix(df, *shape, t, s), ["i", "j"]


def _met(a: Array, b: Array, x: DataFrame, y: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """i, j, x, y of the cells of both (i, j, x) and (i, j, y). A side of one row or column meets every row or column of the other without being repeated."""
    from .products import _hint

    on, take = [], []
    for axis, p, q, whole in zip("ij", a.shape, b.shape, shape):
        for own, side in ((p, a), (q, b)):
            if own not in (1, whole):
                raise ValueError(f"shapes {side.shape} and {shape} do not fit")
        if p == q:
            on.append(axis)
            take.append(axis)
        else:
            take.append(f"_x.{axis}" if p == whole else f"_y.{axis}")
    left, right = (df if side.shape == shape else _hint(df, side.size()) for df, side in ((x, a), (y, b)))
    left, right = left.alias("_x"), right.alias("_y")
    both = left.join(right, on) if on else left.crossJoin(right)
    return both.select(*take, "x", "y")


def _structure(op, a, b):
    return structure_of(op, a, b) if isinstance(a, Matrix) and isinstance(b, Matrix) and a.shape == b.shape else "dense"


def _bounded(fn):
    """``fn`` whose result keeps the block boundaries of both matrices."""

    @functools.wraps(fn)
    def run(a, b, *more):
        out = fn(a, b, *more)
        if isinstance(a, Matrix) and isinstance(b, Matrix) and a.shape == b.shape and (a.row_partitions or b.row_partitions):
            from .blocks import common

            both = common(a, b)[0]
            out.row_partitions, out.col_partitions = both.row_partitions, both.col_partitions
        return out

    return run


@_bounded
def add(a, b, sign: int = 1):
    a, b = _both(a, b)
    if is_number(b):
        return add_scalar(a, b if sign == 1 else -b)
    if is_number(a):
        return add_scalar(b if sign == 1 else negative(b), a)
    out = D.resolve("add", a.dtype, b.dtype)
    x, y, make, keys = _aligned(a, b)
    cplx, wide = D.is_complex(out), D.wide_type(out)
    x = x.withColumn("v", D.cast(F.col("v"), a.dtype, wide))
    y = y.withColumn("v", D.cast(F.col("v"), b.dtype, wide))
    if sign == -1:
        y = y.withColumn("v", D.minus(F.col("v"), cplx))
    rows = x.unionByName(y)
    if a.shape == b.shape:
        rows = spread(rows, keys, a.size())
    summed = rows.groupBy(*keys).agg(D.total(F.col("v"), cplx).alias("v"))
    return make(summed.withColumn("v", D.cast(F.col("v"), wide, out)), out, _structure("add", a, b))


def add_all(first: Array, *more: Array):
    """The sum of several arrays of one shape: one union and one grouped sum."""
    out, wide = first.dtype, None
    for m in more:
        out = D.resolve("add", out, m.dtype)
    wide, cplx = D.wide_type(out), D.is_complex(out)
    keys = list(first.axes)
    df = None
    for m in (first, *more):
        if m.shape != first.shape:
            raise ValueError("shapes differ")
        one = m.df.withColumn("v", D.cast(F.col("v"), m.dtype, wide))
        df = one if df is None else df.unionByName(one)
    df = spread(df, keys, first.size()).groupBy(*keys).agg(D.total(F.col("v"), cplx).alias("v"))
    return first._new(df.withColumn("v", D.cast(F.col("v"), wide, out)), out)


def subtract(a, b):
    return add(a, b, -1)


@_bounded
def multiply(a, b):
    a, b = _both(a, b)
    if is_number(b):
        return scale(a, b)
    if is_number(a):
        return scale(b, a)
    out = D.resolve("hadamard", a.dtype, b.dtype)
    if not (isinstance(a, Vector) and isinstance(b, Vector) and a.is_row == b.is_row) and a.shape != b.shape and 0 not in a.shape + b.shape:
        shape = tuple(map(max, a.shape, b.shape))
        wide = "bit" if out == "bit" else D.wide_type(out)
        x, y = (_flat(m).select("i", "j", D.cast(F.col("v"), m.dtype, wide).alias(n)) for m, n in ((a, "x"), (b, "y")))
        value = F.col("x") if out == "bit" else D.cast(D.times(F.col("x"), F.col("y"), D.is_complex(out)), wide, out)
        return Matrix(_met(a, b, x, y, shape).select("i", "j", value.alias("v")), *shape, out, "dense")
    x, y, make, keys = _aligned(a, b)
    if out == "bit":
        return make(x.join(y.select(*keys), keys), out, _structure("mul", a, b))
    cplx, wide = D.is_complex(out), D.wide_type(out)
    df = x.select(*keys, D.cast(F.col("v"), a.dtype, wide).alias("x")).join(y.select(*keys, D.cast(F.col("v"), b.dtype, wide).alias("y")), keys)
    return make(df.select(*keys, D.cast(D.times(F.col("x"), F.col("y"), cplx), wide, out).alias("v")), out, _structure("mul", a, b))


@_bounded
def divide(a, b):
    """The quotient of every cell, with inf and nan as IEEE 754 has them; the result is dense."""
    a, b = _both(a, b)
    if is_number(b):
        if b == 0:
            return divide(a, _constant(a, b))
        out = D.resolve("divide", a.dtype, _scalar_dtype(a, b))
        cplx = D.is_complex(out)
        wide = "complex_float64" if cplx else "float64"
        v = D.over(D.cast(F.col("v"), a.dtype, wide), D.literal(b, wide), cplx)
        return a._new(a.df.withColumn("v", D.cast(v, wide, out)), out)
    if is_number(a):
        return divide(_constant(b, a), b)
    out = D.resolve("divide", a.dtype, b.dtype)
    x, y, make, keys = _aligned(a, b)
    cplx = D.is_complex(out)
    wide = "complex_float64" if cplx else "float64"
    blank = make(x.limit(0).withColumn("v", D.zero(out)), out, "dense")
    full = densified(blank).select(*keys)
    df = full.join(x.select(*keys, D.cast(F.col("v"), a.dtype, wide).alias("x")), keys, "left").join(y.select(*keys, D.cast(F.col("v"), b.dtype, wide).alias("y")), keys, "left")
    v = D.over(F.coalesce("x", D.zero(wide)), F.coalesce("y", D.zero(wide)), cplx)
    return make(df.select(*keys, D.cast(v, wide, out).alias("v")), out, "dense")


def _constant(like: Array, value):
    from tessera.sources.constructors import full, full_vector

    t = scalar_type(value)
    return full(like.shape, value, t, like.spark) if isinstance(like, Matrix) else full_vector(len(like), value, t, like.spark, like.is_row)


def _scalar_dtype(x: Array, s) -> str:
    """A scalar's part in promotion: floats and complex keep theirs, an int is 64 bits wide with floats and follows the array otherwise."""
    if isinstance(x, Vector):
        return {"int": x.dtype if D.family(x.dtype) in ("float", "complex") else "int32" if x.dtype == "bit" else x.dtype, "float": "float64", "complex": "complex_float64"}[_family(s)]
    return {"int": "float64", "float": "float64", "complex": "complex_float64"}[_family(s)]


def _family(s) -> str:
    return "complex" if isinstance(s, complex) or isinstance(s, np.complexfloating) else "float" if isinstance(s, (float, np.floating)) else "int"


def scalar_result(x: Array, s) -> str:
    """Element type of an array with a Python number.

    A matrix takes the number as a 64-bit float. A vector keeps float types; with
    a float number others become float64; with an int number bit and int32 give
    int32, int16 stays, other integers give float64.
    """
    kind, fam = _family(s), D.family(x.dtype)
    if kind == "complex":
        if isinstance(x, Vector) and fam != "complex":
            raise TypeError("a complex number needs a complex vector")
        return D.resolve("mul", x.dtype, "complex_float64")
    if fam in ("float", "complex"):
        return x.dtype if isinstance(x, Vector) else D.resolve("mul", x.dtype, "float64")
    if isinstance(x, Vector) and kind == "int":
        return {"bit": "int32", "int32": "int32", "int16": "int16"}.get(x.dtype, "float64")
    return "float64"


def scale(x: Array, s):
    if isinstance(s, np.generic):
        s = s.item()
    if isinstance(x, Matrix) and x.structure == "identity":
        x = x._new(x.df, structure="diagonal" if x.shape[0] == x.shape[1] else "dense", props=dict(x.properties))
    out = scalar_result(x, s)
    wide, cplx = D.wide_type(out), D.is_complex(out)
    v = D.times(D.cast(F.col("v"), x.dtype, wide), D.literal(s, wide), cplx)
    n = x.shape[0] if x.shape[0] == x.shape[1] else None
    return x._new(x.df.withColumn("v", D.cast(v, wide, out)), out, props=P.scaled(x.properties, s, n))


def add_scalar(x: Array, s):
    """Every cell plus a number; the result is dense."""
    if isinstance(s, np.generic):
        s = s.item()
    if isinstance(x, Vector) and _family(s) == "complex":
        raise TypeError("a complex number cannot be added to a vector")
    out = scalar_result(x, s)
    if s == 0:
        return x.as_type(out)
    wide, cplx = D.wide_type(out), D.is_complex(out)
    v = D.plus(D.cast(F.col("v"), x.dtype, wide), D.literal(s, wide), cplx)
    return x._new(densified(x).withColumn("v", D.cast(v, wide, out)), out, "dense")


def negative(x: Array):
    out = "int32" if x.dtype == "bit" else x.dtype
    if D.family(out) == "uint":
        out = {8: "int16", 16: "int32", 32: "int64", 64: "int64"}[D.KINDS[out].bits]
    wide = D.wide_type(out)
    return x._new(x.df.withColumn("v", D.cast(D.minus(D.cast(F.col("v"), x.dtype, wide), D.is_complex(out)), wide, out)), out)


def _cells(x: Array, where: Array | None) -> DataFrame:
    """Every cell of ``x``, zeros too; with ``where`` only those it has."""
    if where is None:
        return densified(x)
    if where.shape != x.shape:
        raise ValueError(f"shapes {x.shape} and {where.shape} do not fit")
    if where is x:
        return x.df
    return where.df.select(*x.axes).join(x.df, list(x.axes), "left").withColumn("v", F.coalesce("v", D.zero(x.dtype)))


def _unary(x: Array, fn, zero_stays: bool, where: Array | None = None):
    if x.is_complex:
        raise TypeError("real arrays only")
    out = x.dtype if D.family(x.dtype) == "float" else "float64"
    df = x.df if zero_stays else _cells(x, where)
    structure = x.structure if zero_stays or x.structure == "symmetric" and where is None else "dense"
    if structure == "identity":
        structure = "diagonal" if x.shape[0] == x.shape[1] else "dense"
    return x._new(df.withColumn("v", D.cast(fn(D.cast(F.col("v"), x.dtype, "float64")), "float64", out)), out, structure)


def sin(x):
    return _unary(x, F.sin, True)


def cos(x, where=None):
    """Cosine of every cell, or of the cells that ``where`` has; the others are left out. So for ``exp``, ``log`` and the complement."""
    return _unary(x, F.cos, False, where)


def exp(x, where=None):
    return _unary(x, F.exp, False, where)


def log(x, where=None):
    """Natural logarithm; -inf at 0 and nan below."""
    return _unary(x, lambda v: F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(F.log(v)), False, where)


def sqrt(x):
    return _unary(x, F.sqrt, True)


def absolute(x):
    if x.is_complex:
        part = "float64" if x.dtype.endswith("64") else "float32"
        return x._new(x.df.withColumn("v", D.cast(F.sqrt(F.pow(F.col("v.re"), 2) + F.pow(F.col("v.im"), 2)), "float64", part)), part)
    return x if x.dtype == "bit" else x._new(x.df.withColumn("v", F.abs("v")))


def bitwise_not(x: Matrix, where=None):
    """Bits flip, of a causal matrix only those above the diagonal; integers are complemented in every cell, or in the cells that ``where`` has."""
    if x.dtype == "bit":
        if where is not None:
            raise TypeError("bits flip in every cell")
        if isinstance(x, Vector):
            full = x.spark.range(len(x)).select(F.col("id").alias("i"))
            return x._new(full.join(x.df, "i", "left_anti").withColumn("v", F.lit(True)))
        from .array import grid

        cells = grid(x.spark, *x.shape)
        cells = cells.filter("i < j") if x.structure == "causal" else cells
        return x._new(cells.join(x.df, ["i", "j"], "left_anti").withColumn("v", F.lit(True)), structure=x.structure if x.structure == "causal" else "dense")
    if D.family(x.dtype) == "int":
        return x._new(_cells(x, where).withColumn("v", F.bitwise_not("v")), structure="dense")
    if D.family(x.dtype) == "uint":
        top = (1 << D.KINDS[x.dtype].bits) - 1
        return x._new(_cells(x, where).withColumn("v", (F.lit(top).cast("decimal(20,0)") - F.col("v")).cast(D.KINDS[x.dtype].sql)), structure="dense")
    raise TypeError(f"no complement of {x.dtype}")


def bitwise(a: Array, b: Array, op: str):
    """AND, OR and XOR of bit arrays as set operations on coordinates."""
    a, b = _both(a, b)
    if a.dtype != "bit" or b.dtype != "bit" or a.shape != b.shape:
        raise TypeError("bit arrays of one shape only")
    keys = list(a.axes)
    x, y = a.df.select(*keys), b.df.select(*keys)
    if op == "and":
        df = x.intersect(y)
    elif op == "or":
        df = x.union(y).distinct()
    else:
        df = x.union(y).groupBy(*keys).count().filter("count = 1").select(*keys)
    return a._new(df.withColumn("v", F.lit(True)), structure=a.structure if a.structure == b.structure else "dense")
