"""Products. A matrix product is an equi-join on the inner index with a grouped sum; diagonals need no grouping, and dense blocks go through NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.functions import properties as P
from tessera.plans import trace

from .array import Array, Matrix, Vector, is_number
from .elementwise import lift, scale
from .tiles import product as by_tiles

#: Rows of a vector or diagonal that are broadcast; longer ones are joined by shuffle.
SMALL = 1 << 20
BLOCK = 256
#: Cells of a result whose sums each task takes before the shuffle; larger results go by tiles.
FEW = 1 << 22


def _effective(m: Matrix) -> str:
    if m.structure in ("identity", "diagonal"):
        return m.structure
    found = P.effective_structure(m.properties)
    return found if found != "general" else {"triangular": "upper_triangular", "causal": "upper_triangular"}.get(m.structure, "general")


def _hint(df: DataFrame, length: int) -> DataFrame:
    """A broadcast of a side that has at most SMALL rows, else the side as it is."""
    return F.broadcast(df) if length <= SMALL else df


def matmul(a, b, layout: str = "coo"):
    """Product of matrices and vectors.

    ``layout`` "coo" multiplies coordinates, in tiles if the result has more than
    FEW cells; "block" gathers dense blocks for NumPy, which pays for float
    matrices with few zeros.
    """
    like = a if isinstance(a, Array) else b
    a, b = lift(a, like), lift(b, like)
    if is_number(a) or is_number(b):
        raise TypeError("a matrix product needs arrays")
    if isinstance(a, Vector) and isinstance(b, Vector):
        if not a.is_row and b.is_row:
            return outer(a, b)
        from .reductions import inner

        return inner(a, b)
    if isinstance(b, Vector):
        return matvec(a, b)
    if isinstance(a, Vector):
        return vecmat(a, b)
    if a.shape[1] != b.shape[0]:
        raise ValueError(f"shapes {a.shape} and {b.shape} do not fit")
    out = D.resolve("matmul", a.dtype, b.dtype)
    x, y = _effective(a), _effective(b)
    shape = (a.shape[0], b.shape[1])
    if "zero" in (x, y):
        trace.note("matmul", "zero")
        return Matrix(a.df.limit(0).withColumn("v", D.zero(out)), *shape, out, props={"is_zero": True})
    if x == "identity" and a.structure == "identity" and a.shape[0] == a.shape[1]:
        trace.note("matmul", "identity")
        return b.as_type(out)
    if y == "identity" and b.structure == "identity" and b.shape[0] == b.shape[1]:
        trace.note("matmul", "identity")
        return a.as_type(out)
    wide, cplx = D.wide_type(out), D.is_complex(out)
    left = a.df.select("i", F.col("j").alias("k"), D.cast(F.col("v"), a.dtype, wide).alias("x"))
    right = b.df.select(F.col("i").alias("k"), "j", D.cast(F.col("v"), b.dtype, wide).alias("y"))
    structure, props = _result(a, b, x, y, shape)
    product = D.times(F.col("x"), F.col("y"), cplx)
    if "diagonal" in (x, y) or "identity" in (x, y):
        trace.note("matmul", "diagonal")
        if x in ("diagonal", "identity"):
            left = _hint(left.filter("i = k"), a.shape[0])
        else:
            right = _hint(right.filter("k = j"), b.shape[1])
        df = left.join(right, "k").select("i", "j", D.cast(product, wide, out).alias("v"))
        return Matrix(df, *shape, out, structure, props)
    if layout == "block" and D.family(out) in ("float", "complex"):
        trace.note("matmul", "block")
        return Matrix(_block_product(a, b, wide, out), *shape, out, structure, props)
    if shape[0] * shape[1] > FEW and not cplx and wide != "uint64":
        trace.note("matmul", "tiles")
        bits = a.dtype == b.dtype == "bit"  # counted whatever their values
        if bits:
            left, right = left.withColumn("x", F.lit(1).cast("bigint")), right.withColumn("y", F.lit(1).cast("bigint"))
        df = by_tiles(left, right, *shape, D.KINDS[wide].sql)
        return Matrix(df.withColumn("v", D.cast(F.col("v"), wide, out)), *shape, out, structure, props)
    if a.dtype == b.dtype == "bit":
        trace.note("matmul", "bit")
        df = left.select("i", "k").join(right.select("k", "j"), "k").groupBy("i", "j").agg(F.count("*").cast("int").alias("v"))
        return Matrix(df, *shape, out, structure, props)
    trace.note("matmul", "coo")
    df = left.join(right, "k").groupBy("i", "j").agg(D.total(product, cplx).alias("v"))
    return Matrix(df.withColumn("v", D.cast(F.col("v"), wide, out)), *shape, out, structure, props)


def _result(a: Matrix, b: Matrix, x: str, y: str, shape) -> tuple[str, dict]:
    """Structure and properties of the product."""
    upper, lower = {"upper_triangular", "diagonal", "identity"}, {"lower_triangular", "diagonal", "identity"}
    if shape[0] != shape[1] or a.shape[0] != a.shape[1]:
        return "dense", {}
    if x in ("diagonal", "identity") and y in ("diagonal", "identity"):
        return "diagonal", {"is_diagonal": True}
    if x in upper and y in upper:
        strict = a.structure == "causal" or b.structure == "causal"
        return "triangular", {"is_upper_triangular": True, **({"has_zero_diagonal": True} if strict else {})}
    if x in lower and y in lower:
        return "dense", {"is_lower_triangular": True}
    return "dense", {}


def to_blocks(df: DataFrame, size: int, rows: int, cols: int) -> DataFrame:
    """Coordinates gathered to dense row-major blocks: bi, bj, nr, nc, data. At most size x size cells meet in a group."""
    keyed = df.select(F.floor(F.col("i") / size).cast("int").alias("bi"), F.floor(F.col("j") / size).cast("int").alias("bj"), (F.col("i") % size).cast("int").alias("r"), (F.col("j") % size).cast("int").alias("c"), "v")
    cplx = "struct" in dict(df.dtypes)["v"]

    def pack(key, table):
        bi, bj = key[0].as_py(), key[1].as_py()
        nr, nc = min(size, rows - bi * size), min(size, cols - bj * size)
        out = np.zeros((nr, nc), dtype=np.complex128 if cplx else np.float64)
        v = table["v"].combine_chunks()
        out[table["r"].to_numpy(), table["c"].to_numpy()] = v.field("re").to_numpy() + 1j * v.field("im").to_numpy() if cplx else v.to_numpy()
        return pa.table([pa.array([x], type=t) for x, t in ((bi, pa.int32()), (bj, pa.int32()), (nr, pa.int32()), (nc, pa.int32()), (out.tobytes(), pa.binary()))], names=["bi", "bj", "nr", "nc", "data"])

    return keyed.groupBy("bi", "bj").applyInArrow(pack, "bi int, bj int, nr int, nc int, data binary")


def _block_product(a: Matrix, b: Matrix, wide: str, out: str) -> DataFrame:
    """Blocks meet on the inner block index; a group adds the products of one result block in ascending inner index."""
    cplx = D.is_complex(out)
    kind = np.complex128 if cplx else np.float64
    x = to_blocks(a.df.withColumn("v", D.cast(F.col("v"), a.dtype, wide)), BLOCK, *a.shape).select("bi", F.col("bj").alias("k"), "nr", F.col("nc").alias("inner"), F.col("data").alias("x"))
    y = to_blocks(b.df.withColumn("v", D.cast(F.col("v"), b.dtype, wide)), BLOCK, *b.shape).select(F.col("bi").alias("k"), "bj", "nc", F.col("data").alias("y"))

    def multiply(batches):
        for batch in batches:
            parts = [(np.frombuffer(r["x"], dtype=kind).reshape(r["nr"], r["inner"]) @ np.frombuffer(r["y"], dtype=kind).reshape(r["inner"], r["nc"])).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["bi"], batch["bj"], batch["k"], batch["nr"], batch["nc"], pa.array(parts, type=pa.binary())], names=["bi", "bj", "k", "nr", "nc", "part"])

    parts = x.join(y, "k").mapInArrow(multiply, "bi int, bj int, k int, nr int, nc int, part binary")

    def add(key, table):
        rows = table.sort_by("k")
        nr, nc = rows["nr"][0].as_py(), rows["nc"][0].as_py()
        total = np.zeros((nr, nc), dtype=kind)
        for p in rows["part"]:
            total += np.frombuffer(p.as_buffer(), dtype=kind).reshape(nr, nc)
        i, j = np.nonzero(total)
        v = total[i, j]
        cells = pa.StructArray.from_arrays([pa.array(v.real), pa.array(v.imag)], names=["re", "im"]) if cplx else pa.array(v)
        return pa.table([pa.array(i + key[0].as_py() * BLOCK), pa.array(j + key[1].as_py() * BLOCK), cells], names=["i", "j", "v"])

    cell = "struct<re:double,im:double>" if cplx else "double"
    return parts.groupBy("bi", "bj").applyInArrow(add, f"i bigint, j bigint, v {cell}").withColumn("v", D.cast(F.col("v"), wide, out))


def matvec(a: Matrix, x: Vector) -> Vector:
    if a.shape[1] != len(x):
        raise ValueError(f"shapes {a.shape} and {len(x)} do not fit")
    out = D.resolve("matvec", a.dtype, x.dtype)
    wide, cplx = D.wide_type(out), D.is_complex(out)
    right = _hint(x.df.select(F.col("i").alias("j"), D.cast(F.col("v"), x.dtype, wide).alias("y")), len(x))
    df = a.df.select("i", "j", D.cast(F.col("v"), a.dtype, wide).alias("x")).join(right, "j").groupBy("i").agg(D.total(D.times(F.col("x"), F.col("y"), cplx), cplx).alias("v"))
    return Vector(df.withColumn("v", D.cast(F.col("v"), wide, out)), a.shape[0], out)


def vecmat(x: Vector, a: Matrix) -> Vector:
    out = matvec(Matrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), *a.shape[::-1], a.dtype), x)
    return Vector(out.df, a.shape[1], out.dtype, True)


def outer(u: Vector, v: Vector) -> Matrix:
    out = D.resolve("outer", u.dtype, v.dtype)
    x, y = u.df.select("i", F.col("v").alias("x")), v.df.select(F.col("i").alias("j"), F.col("v").alias("y"))
    both = x.crossJoin(_hint(y, len(v)))  # every cell of the result is one pair
    if out == "bit":
        return Matrix(both.select("i", "j", F.lit(True).alias("v")), len(u), len(v), out)
    wide = D.wide_type(out)
    value = D.times(D.cast(F.col("x"), u.dtype, wide), D.cast(F.col("y"), v.dtype, wide), D.is_complex(out))
    return Matrix(both.select("i", "j", D.cast(value, wide, out).alias("v")), len(u), len(v), out)


def batch_gemv(a: Matrix, x: Matrix) -> Matrix:
    """The product with every column of ``x``."""
    return matmul(a, x)


__all__ = ["matmul", "matvec", "vecmat", "outer", "batch_gemv", "to_blocks", "scale"]
