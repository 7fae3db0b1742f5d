"""Solving and factorising. What has no relational form goes to NumPy in one task, up to a size that is checked; larger inverses recurse over blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.functions import properties as P
from tessera.plans import trace

from . import elementwise, products
from .array import Array, Matrix, Vector
from .blocks import block_matrix

#: Rows of a matrix that one task takes as a dense array.
SINGLE = 4096


def _kind(arrays) -> str:
    return "complex_float64" if any(a.is_complex for a in arrays) else "float64"


def _gather(arrays: list[Array], fn: Callable, schema: str):
    """Run ``fn`` on dense arrays in one task; it returns Arrow columns of ``schema``."""
    for a in arrays:
        if max(a.shape) > SINGLE:
            raise ValueError(f"one task takes at most {SINGLE} rows or columns, not {a.shape}")
    kind = _kind(arrays)
    frames = None
    for k, a in enumerate(arrays):
        v = D.cast(F.col("v"), a.dtype, "complex_float64")
        one = a.df.select(F.lit(k).alias("a"), "i", F.col("j") if isinstance(a, Matrix) else F.lit(0).cast("bigint").alias("j"), v["re"].alias("re"), v["im"].alias("im"))
        frames = one if frames is None else frames.unionByName(one)
    blank = arrays[0].spark.range(1).select(F.lit(-1).alias("a"), F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    shapes = [a.shape if isinstance(a, Matrix) else (len(a), 1) for a in arrays]
    real = kind == "float64"

    def run(table: pa.Table) -> pa.Table:
        which, i, j, re, im = (table[c].to_numpy() for c in ("a", "i", "j", "re", "im"))
        dense = []
        for k, shape in enumerate(shapes):
            own = which == k
            m = np.zeros(shape, dtype=np.float64 if real else np.complex128)
            m[i[own], j[own]] = re[own] if real else re[own] + 1j * im[own]
            dense.append(m)
        return fn(*dense)

    return frames.unionByName(blank).withColumn("all", F.col("i") - F.col("i")).groupBy("all").applyInArrow(run, schema)


_CELLS = "part int, i bigint, j bigint, re double, im double"


def _cells(parts) -> pa.Table:
    out = [[], [], [], [], []]
    for k, m in enumerate(parts):
        m = np.atleast_2d(m)
        i, j = np.nonzero(m)
        v = m[i, j]
        for column, x in zip(out, (np.full(len(i), k), i, j, v.real, np.imag(v))):
            column.append(x)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([pa.array(np.concatenate(c).astype(t.to_pandas_dtype()), type=t) for c, t in zip(out, kinds)], names=["part", "i", "j", "re", "im"])


def _results(arrays: list[Array], fn: Callable, shapes, dtype: str | None = None) -> list[Matrix]:
    """Matrices that ``fn`` makes of the dense arrays."""
    kind = dtype or _kind(arrays)
    found = _gather(arrays, lambda *m: _cells(fn(*m)), _CELLS)
    if len(shapes) > 1:
        found = found.persist()
    v = F.struct("re", "im") if D.is_complex(kind) else F.col("re")
    return [Matrix(found.filter(F.col("part") == k).select("i", "j", v.alias("v")), *shape, kind) for k, shape in enumerate(shapes)]


def dense_task(arrays: list[Array], fn: Callable):
    """A number that ``fn`` makes of the dense arrays."""
    row = _gather(arrays, lambda *m: _cells([np.array([[fn(*m)]]) + 0j]), _CELLS).first()
    value = complex(row["re"], row["im"]) if row else 0j
    return value if _kind(arrays) == "complex_float64" else value.real


def _square(m: Matrix) -> int:
    if m.shape[0] != m.shape[1]:
        raise ValueError("a square matrix is needed")
    return m.shape[0]


def _as_vector(m: Matrix) -> Vector:
    return Vector(m.df.select("i", "v"), m.shape[0], m.dtype)


def _inverse(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        raise ValueError("singular matrix") from None


def invert(m: Matrix) -> Matrix:
    """The inverse; a singular matrix raises. Above SINGLE rows by Schur complements of halves."""
    n = _square(m)
    if m.structure == "causal":
        raise ValueError("a strictly triangular matrix is singular")
    if D.family(m.dtype) not in ("float", "complex"):
        raise TypeError("invert needs a float or complex matrix")
    kind = P.effective_structure(m.properties)
    if kind == "zero":
        raise ValueError("singular matrix")
    if m.structure == "identity" or kind == "identity":
        return m
    if m.structure == "diagonal" or kind == "diagonal":
        trace.note("invert", "diagonal")
        on = m.df.filter("i = j")
        full = on.select("i", "j", D.cast(D.over(D.literal(1.0, _kind([m])), D.cast(F.col("v"), m.dtype, _kind([m])), m.is_complex), _kind([m]), m.dtype).alias("v"))
        return Matrix(full, n, n, m.dtype, "diagonal", {"is_diagonal": True})
    if n <= SINGLE:
        trace.note("invert", "single")
        return _results([m], lambda a: [_inverse(a)], [(n, n)])[0].as_type(m.dtype)
    trace.note("invert", "blocks")
    h = n // 2
    a, b, c, d = m[:h, :h], m[:h, h:], m[h:, :h], m[h:, h:]
    mul = lambda x, y: products.matmul(x, y, "block")
    ai = invert(a).eval()
    ca, ab = mul(c, ai), mul(ai, b)
    s = invert(d - mul(c, ab)).eval()
    upper = elementwise.negative(mul(ab, s)).eval()
    lower = elementwise.negative(mul(s, ca))
    return block_matrix([[ai - mul(upper, ca), upper], [lower, s]])


def solve(a: Matrix, b):
    """x with a x = b; b is a vector or a matrix of columns."""
    n = _square(a)
    b = elementwise.lift(b, a)
    rows = len(b) if isinstance(b, Vector) else b.shape[0]
    if rows != n:
        raise ValueError("sizes differ")
    kind = P.effective_structure(a.properties)
    if kind == "zero":
        raise ValueError("singular matrix")
    if kind == "identity" or a.structure == "identity":
        return b
    if a.structure in ("diagonal", "triangular") or kind in ("diagonal", "upper_triangular", "lower_triangular"):
        return solve_triangular(a, b)
    if n > SINGLE:
        return products.matmul(invert(a), b)
    return _solved(a, b, lambda x, y: np.linalg.solve(x, y))


def _solved(a, b, fn):
    if isinstance(b, Matrix) and b.shape[1] > SINGLE:  # columns are solved apart
        half = b.shape[1] // 2
        return block_matrix([[_solved(a, b[:, :half], fn), _solved(a, b[:, half:], fn)]])

    def run(x, y):
        try:
            return [fn(x, y)]
        except np.linalg.LinAlgError:
            raise ValueError("singular matrix") from None

    out = _results([a, b], run, [(a.shape[1], 1 if isinstance(b, Vector) else b.shape[1])])[0]
    return _as_vector(out) if isinstance(b, Vector) else out


def _substitute(a: np.ndarray, y: np.ndarray, lower: bool) -> np.ndarray:
    n = len(a)
    out = np.zeros((n, y.shape[1]), dtype=np.result_type(a, y))
    if not a.diagonal().all():
        raise ValueError("singular matrix")
    for i in range(n) if lower else range(n - 1, -1, -1):
        rest = slice(0, i) if lower else slice(i + 1, n)
        out[i] = (y[i] - a[i, rest] @ out[rest]) / a[i, i]
    return out


def solve_triangular(a: Matrix, b):
    """As solve, of a matrix known to be triangular or diagonal; cells outside the triangle count as zero. Above SINGLE rows by halves."""
    n = _square(a)
    b = elementwise.lift(b, a)
    kind = P.effective_structure(a.properties)
    if a.structure == "diagonal" or kind == "diagonal":
        inverse = invert(Matrix(a.df, n, n, a.dtype, "diagonal"))
        return products.matmul(inverse, b)
    upper = kind == "upper_triangular" or a.structure == "triangular"
    if not upper and kind != "lower_triangular":
        raise ValueError("assert is_upper_triangular or is_lower_triangular first")
    if n <= SINGLE:
        return _solved(a, b, lambda x, y: _substitute(np.triu(x) if upper else np.tril(x), y, not upper))
    h = n // 2
    props = {"is_upper_triangular": True} if upper else {"is_lower_triangular": True}

    def corner(x):
        return Matrix(x.df, *x.shape, a.dtype, props=props)

    first, last = (corner(a[h:, h:]), corner(a[:h, :h])) if upper else (corner(a[:h, :h]), corner(a[h:, h:]))
    column = Matrix(b.df.select("i", F.lit(0).cast("bigint").alias("j"), "v"), n, 1, b.dtype) if isinstance(b, Vector) else b
    top, low = column[:h, :], column[h:, :]
    x = solve_triangular(first, low if upper else top).eval()
    other = solve_triangular(last, (top - products.matmul(a[:h, h:], x)) if upper else (low - products.matmul(a[h:, :h], x)))
    out = block_matrix([[other], [x]] if upper else [[x], [other]])
    return _as_vector(out) if isinstance(b, Vector) else out


def lstsq(a: Matrix, b):
    """Least squares by the normal equations: two aggregates over the rows, and a small system."""
    b = elementwise.lift(b, a)
    t = a.H
    return solve(products.matmul(t, a), products.matmul(t, b))


def slogdet(a: Matrix) -> tuple:
    n = _square(a)
    if a.structure == "identity":
        return 1.0, 0.0
    if n > SINGLE:  # det [[A, B], [C, D]] = det A det (D - C A^-1 B)
        h = n // 2
        first, rest = a[:h, :h], a[h:, h:] - products.matmul(a[h:, :h], products.matmul(invert(a[:h, :h]), a[:h, h:]))
        (s, v), (t, w) = slogdet(first), slogdet(rest.eval())
        return s * t, v + w
    sign = dense_task([a], lambda x: np.linalg.slogdet(x)[0]) if n else 1.0
    return sign, float(np.real(dense_task([a], lambda x: _log_size(x)))) if n else 0.0


def _log_size(x: np.ndarray) -> float:
    found = np.linalg.slogdet(x)[1]
    return found if np.isfinite(found) else -math.inf


def cond(a: Matrix, p=None) -> float:
    """Frobenius norm times that of the inverse."""
    if p is not None:
        raise NotImplementedError("p is None")
    from .reductions import norm

    return norm(a) * norm(invert(a))


def eigh(a: Matrix) -> tuple[Vector, Matrix]:
    """Eigenvalues in ascending order and eigenvectors of a Hermitian matrix."""
    n = _square(a)
    if a.properties.get("is_hermitian") is False:
        raise ValueError("the matrix is asserted not to be Hermitian")
    w, v = _results([a], lambda x: [w_v[0][:, None], w_v[1]] if (w_v := np.linalg.eigh(x)) else [], [(n, 1), (n, n)])
    return _as_vector(w.as_type("float64") if not w.is_complex else Matrix(w.df.withColumn("v", F.col("v.re")), n, 1, "float64")), v


def eigvalsh(a: Matrix) -> Vector:
    n = _square(a)
    if a.properties.get("is_hermitian") is False:
        raise ValueError("the matrix is asserted not to be Hermitian")
    if "eigenvalues" in a.properties:
        from tessera.sources.constructors import vector

        return vector(sorted(np.real(a.properties["eigenvalues"]).tolist()), "float64", a.spark)
    return _as_vector(_results([a], lambda x: [np.linalg.eigvalsh(x)[:, None]], [(n, 1)], "float64")[0])


def eigvals_arnoldi(a: Matrix, k: int, m: int | None = None, tol: float = 1e-6, seed: int = 7) -> np.ndarray:
    """The k eigenvalues of largest size from a Krylov space: distributed products with vectors, and a small Hessenberg matrix on the driver.

    The m basis vectors (m is at most n, a few dozen) stay distributed; each is kept once.
    """
    from tessera.functions.frames import cut

    from .reductions import norm

    n = _square(a)
    m = min(n, m or max(2 * k + 1, 20))
    kind = _kind([a])
    spark = a.spark
    u = F.xxhash64(F.col("id"), F.lit(seed)).cast("double") / float(1 << 63)
    q = Vector(spark.range(n).select(F.col("id").alias("i"), u.alias("v")), n, "float64").as_type(kind)
    q = elementwise.divide(q, norm(q))
    basis, h = [_cut(q, cut)], np.zeros((m + 1, m), dtype=complex)
    done = m
    for step in range(m):
        w = _cut(products.matvec(a.as_type(kind), basis[step]), cut)
        for _ in range(2):  # orthogonalise twice against rounding
            both = None
            for c, b in enumerate(basis):
                one = b.conj().df.select("i", F.lit(c).alias("c"), D.cast(F.col("v"), kind, "complex_float64").alias("x"))
                both = one if both is None else both.unionByName(one)
            p = D.times(F.col("x"), D.cast(F.col("v"), kind, "complex_float64"), True)
            found = both.join(w.df, "i").select("c", p.alias("p")).groupBy("c").agg(F.sum("p.re").alias("re"), F.sum("p.im").alias("im")).collect()  # a row for each basis vector
            for row in found:
                g = complex(row["re"], row["im"])
                h[row["c"], step] += g
            terms = [elementwise.scale(basis[row["c"]], -(complex(row["re"], row["im"]) if kind.startswith("complex") else row["re"])) for row in found]
            w = _cut(elementwise.add_all(w, *terms), cut) if terms else w
        size = norm(w)
        h[step + 1, step] = size
        if size < tol * max(1e-300, float(np.abs(h).max())):
            done = step + 1
            break
        basis.append(_cut(elementwise.divide(w, size), cut))
    values = np.linalg.eigvals(h[:done, :done])
    values = values[np.argsort(-np.abs(values))][:k]
    return values.real if np.allclose(values.imag, 0, atol=1e-10 * max(1.0, np.abs(values).max(initial=0))) else values


def _cut(v: Vector, cut) -> Vector:
    return Vector(cut(v.df), len(v), v.dtype)


def qr(a: Matrix) -> tuple[Matrix, Matrix]:
    r, c = a.shape
    k = min(r, c)
    if r > SINGLE >= c:
        return _tall_qr(a)
    q, t = _results([a], lambda x: list(np.linalg.qr(x)), [(r, k), (k, c)])
    t.properties = {"is_upper_triangular": True} if k == c else {}
    return q, t


def _tall_qr(a: Matrix) -> tuple[Matrix, Matrix]:
    """Q and R of a matrix with many rows: R from the Cholesky factor of its gram matrix, twice over against rounding. The columns must be independent, with a condition below some 1e7."""
    c = a.shape[1]
    q, r = a, None
    for _ in range(2):
        step = cholesky(products.matmul(q.H, q)).H.eval()
        step.properties = {"is_upper_triangular": True}
        q = products.matmul(q, invert(step)).eval()
        r = step if r is None else products.matmul(step, r)
    r = Matrix(r.df.filter("i <= j"), c, c, r.dtype, props={"is_upper_triangular": True})
    return q, r


def _plu(x: np.ndarray) -> list[np.ndarray]:
    u, n = x.astype(np.result_type(x, np.float64)).copy(), len(x)
    l, order = np.eye(n, dtype=u.dtype), np.arange(n)
    for k in range(n):
        p = k + int(np.abs(u[k:, k]).argmax())
        if u[p, k] == 0:
            continue
        if p != k:
            u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
            l[[k, p], :k] = l[[p, k], :k]
        l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
    return [np.eye(n, dtype=u.dtype)[order], l, np.triu(u)]


def lu(a: Matrix) -> tuple[Matrix, Matrix, Matrix]:
    """P, L, U with P a = L U, by partial pivoting."""
    n = _square(a)
    p, l, u = _results([a], _plu, [(n, n)] * 3)
    l.properties, u.properties = {"is_lower_triangular": True}, {"is_upper_triangular": True}
    return p, l, u


# Extensions: not offered by the reference's own public functions beyond a name


def cholesky(a: Matrix) -> Matrix:
    n = _square(a)
    if n <= SINGLE:
        return _results([a], lambda x: [np.linalg.cholesky(x)], [(n, n)])[0]
    h = n // 2
    top = cholesky(a[:h, :h]).eval()
    top = Matrix(top.df, h, h, top.dtype, props={"is_lower_triangular": True})
    left = solve_triangular(top, a[:h, h:]).H.eval()
    low = cholesky((a[h:, h:] - products.matmul(left, left.H)).eval())
    from tessera.sources.constructors import zeros

    return block_matrix([[top, zeros((h, n - h), dtype=top.dtype, spark=a.spark)], [left, low]])


def svd(a: Matrix) -> tuple[Matrix, Vector, Matrix]:
    r, c = a.shape
    k = min(r, c)
    if r > SINGLE >= c:
        q, t = _tall_qr(a)
        u, s, v = svd(t)
        return products.matmul(q, u), s, v

    def run(x):
        u, s, v = np.linalg.svd(x, full_matrices=False)
        return [u, s[:, None], v]

    u, s, v = _results([a], run, [(r, k), (k, 1), (k, c)])
    return u, _as_vector(s), v


def pinv(a: Matrix) -> Matrix:
    if a.shape[0] > SINGLE >= a.shape[1]:
        q, t = _tall_qr(a)
        return products.matmul(invert(t), q.H)
    return _results([a], lambda x: [np.linalg.pinv(x)], [a.shape[::-1]])[0]


def eig(a: Matrix) -> tuple[Vector, Matrix]:
    n = _square(a)

    def run(x):
        w, v = np.linalg.eig(x)
        return [w[:, None] + 0j, v + 0j]

    w, v = _results([a], run, [(n, 1), (n, n)], "complex_float64")
    return _as_vector(w), v


def eigvals(a: Matrix) -> Vector:
    n = _square(a)
    return _as_vector(_results([a], lambda x: [np.linalg.eigvals(x)[:, None] + 0j], [(n, 1)], "complex_float64")[0])


def eigvals_skew(a: Matrix) -> Vector:
    """Eigenvalues of a real antisymmetric matrix: imaginary, in ascending order."""
    n = _square(a)
    return _as_vector(_results([a], lambda x: [1j * np.linalg.eigvalsh(-1j * x)[:, None]], [(n, 1)], "complex_float64")[0])
