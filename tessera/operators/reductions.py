"""Reductions to a number: grouped aggregates that combine before the shuffle. Results are kept on the handle."""

from __future__ import annotations

import cmath
import math

from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.functions import properties as P

from .array import Array, Matrix, Vector, is_number


def _complex(row, a: str = "re", b: str = "im") -> complex:
    return complex(row[a] or 0.0, row[b] or 0.0)


def _wide(x: Array):
    return D.cast(F.col("v"), x.dtype, "complex_float64")


def _kept(x: Array, key: str, make):
    if key in x.properties:
        return x.properties[key]
    value = make()
    try:
        x.properties[key] = value
    except ValueError:
        pass
    return value


def sum(x: Array) -> complex:  # noqa: A001
    """The sum of all cells, always complex."""
    v = _wide(x)
    return complex(_kept(x, "sum", lambda: _complex(x.df.agg(F.sum(v["re"]).alias("re"), F.sum(v["im"]).alias("im")).first())))


def norm(x: Array) -> float:
    """Frobenius norm, or length of a vector."""
    v = _wide(x)
    return float(_kept(x, "norm", lambda: math.sqrt(x.df.agg(F.sum(v["re"] * v["re"] + v["im"] * v["im"]).alias("s")).first()["s"] or 0.0)))


def trace(m: Matrix):
    """Sum of the diagonal."""
    props = m.properties
    if "trace" not in props and "diagonal_value" in props:
        return props["diagonal_value"] * min(m.shape)
    v = _wide(m)

    def make():
        value = _complex(m.df.filter("i = j").agg(F.sum(v["re"]).alias("re"), F.sum(v["im"]).alias("im")).first())
        return value if m.is_complex else value.real

    return _kept(m, "trace", make) if m.shape[0] == m.shape[1] else make()


def determinant(m: Matrix):
    """By structure: a product over the diagonal where it is enough, else a factorisation in one task."""
    n = m.shape[0]
    if m.shape[1] != n:
        raise ValueError("a square matrix is needed")

    def make():
        kind = P.effective_structure(m.properties)
        if kind == "zero" and n or m.structure in ("causal",) and n or m.properties.get("has_zero_diagonal") and kind.endswith("triangular") and n:
            return 0.0
        if m.structure in ("identity", "diagonal", "triangular") or kind != "general":
            on = m.df.filter("i = j")
            if m.is_complex:
                from .linalg import dense_task

                return dense_task([m], lambda a: a.diagonal().prod())
            row = on.agg(F.count("*").alias("n"), F.product(D.cast(F.col("v"), m.dtype, "float64")).alias("p")).first()
            return float(row["p"] if row["p"] is not None else 1.0) if row["n"] == n else 0.0
        from .linalg import slogdet

        sign, size = slogdet(m)
        return sign * (cmath.exp(size).real if size < 709 else math.inf)

    return _kept(m, "determinant", make)


def dot(a: Vector, b: Vector):
    """Sum of products, without conjugation: float or complex."""
    if len(a) != len(b):
        raise ValueError(f"lengths {len(a)} and {len(b)} differ")
    if a.dtype == b.dtype == "bit":
        return float(a.df.join(b.df.select("i"), "i").count())
    both = a.df.select("i", _wide(a).alias("x")).join(b.df.select("i", _wide(b).alias("y")), "i")
    p = D.times(F.col("x"), F.col("y"), True)
    value = _complex(both.select(p.alias("p")).agg(F.sum("p.re").alias("re"), F.sum("p.im").alias("im")).first())
    return value if a.is_complex or b.is_complex else value.real


def inner(a: Vector, b: Vector):
    """As dot; integers and bits give an exact int."""
    whole = ("bit", "int", "uint")
    if D.family(a.dtype) not in whole or D.family(b.dtype) not in whole:
        return dot(a, b)
    if len(a) != len(b):
        raise ValueError(f"lengths {len(a)} and {len(b)} differ")
    if a.dtype == b.dtype == "bit":
        return int(a.df.join(b.df.select("i"), "i").count())
    out = D.wide_type(D.resolve("mul", a.dtype, b.dtype))
    both = a.df.select("i", D.cast(F.col("v"), a.dtype, out).alias("x")).join(b.df.select("i", D.cast(F.col("v"), b.dtype, out).alias("y")), "i")
    return int(both.agg(F.sum(F.col("x") * F.col("y")).alias("s")).first()["s"] or 0)


def cross_product(a: Vector, b: Vector) -> Vector:
    """Of vectors of three cells."""
    if len(a) != 3 or len(b) != 3:
        raise ValueError("three cells are needed")
    x, y = (v.df.select(*[F.coalesce(F.max(F.when(F.col("i") == k, D.cast(F.col("v"), v.dtype, "float64"))), F.lit(0.0)).alias(f"{n}{k}") for k in range(3)]) for v, n in ((a, "x"), (b, "y")))
    parts = [F.col(f"x{p}") * F.col(f"y{q}") - F.col(f"x{q}") * F.col(f"y{p}") for p, q in ((1, 2), (2, 0), (0, 1))]
    df = x.crossJoin(y).select(F.posexplode(F.array(*parts)).alias("i", "v")).select(F.col("i").cast("bigint").alias("i"), "v")  # one row on each side
    return Vector(df, 3, "float64")


__all__ = ["sum", "norm", "trace", "determinant", "dot", "inner", "cross_product", "is_number"]
