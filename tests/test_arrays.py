"""Constructors, views, elementwise operations, products, reductions and linear algebra against NumPy."""

import itertools
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera as tc
from tessera.functions import dtypes as D
from tessera.operators import blocks, elementwise, indexing, products, reductions

N = tc.to_numpy
rng = np.random.default_rng(4)
A, B = rng.integers(-4, 5, (5, 5)).astype(float), rng.integers(-4, 5, (5, 5)).astype(float)
SAME = ("add", "sub", "mul", "div", "matmul", "matvec", "vecmat", "outer", "vadd", "vsub")
MIXED = ("add", "sub", "mul", "matvec", "vecmat", "outer", "vadd", "vsub")


def _resolves(s, t):
    try:
        return all(D.resolve(op, s, t) for op in ("add", "hadamard", "matvec", "outer"))
    except (TypeError, ValueError):
        return False


#: Each pair of different types that has a result, with the types a third of the list apart: every type comes on both sides.
PAIRS = [(s, t) for a, s in enumerate(D.DTYPES) for b, t in enumerate(D.DTYPES) if a != b and (b - a) % len(D.DTYPES) in (1, 5, 10, 14) and _resolves(s, t)]


def cell(op, a, b, u, v):
    return {
        "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: a / b, "matmul": lambda: a @ b, "matvec": lambda: a @ v, "vecmat": lambda: u.T @ b, "outer": lambda: u @ v.T, "vadd": lambda: u + v, "vsub": lambda: u - v,
    }[op]()


def check_ops(spark, s, t, ops):
    x, y = np.array([[1, 1], [0, 1]]), np.array([[1, 0], [1, 1]]) if "sub" not in ops else np.array([[1, 0], [0, 1]])
    a, b = (tc.asarray(m.astype(D.numpy_type(k)), dtype=k, spark=spark) for m, k in ((x, s), (y, t)))
    u, v = (tc.asarray(m[0].astype(D.numpy_type(k)), dtype=k, spark=spark) for m, k in ((x, s), (y, t)))
    xu, yv = x[0], y[0]
    want = {"add": x + y, "sub": x - y, "mul": x * y, "matmul": x @ y, "matvec": x @ yv, "vecmat": xu @ y, "outer": np.outer(xu, yv), "vadd": xu + yv, "vsub": xu - yv}
    frames, types = None, {}
    for op in ops:
        out = cell(op, a, b, u, v)
        types[op] = out.dtype
        w = D.cast(F.col("v"), out.dtype, "complex_float64")
        j = F.col("j") if "j" in out.df.columns else F.lit(0).cast("bigint")
        one = out.df.select(F.lit(op).alias("op"), "i", j.alias("j"), w["re"].alias("re"))
        frames = one if frames is None else frames.unionByName(one)
    got = {}
    for r in frames.collect():
        got.setdefault(r["op"], {})[r["i"], r["j"]] = r["re"]
    for op in ops:
        kind = {"sub": "sub", "vsub": "sub", "vadd": "add", "div": "divide", "matvec": "matvec", "vecmat": "matvec"}.get(op, op)
        assert types[op] == D.resolve({"mul": "hadamard"}.get(kind, kind), s, t), (op, s, t)
        with np.errstate(all="ignore"):
            full = np.atleast_2d(x / y if op == "div" else want[op]).astype(float)
        if op in ("matvec", "vecmat", "vadd", "vsub"):
            full = full.T
        for (i, j), w in np.ndenumerate(full):
            g = got.get(op, {}).get((i, j), 0.0)
            assert g == w or np.isnan(g) and np.isnan(w) or D.is_complex(types[op]) and not np.isfinite(w), (op, s, t, i, j, g, w)


@pytest.mark.parametrize("t", D.DTYPES)
def test_same_type_operations(spark, t):
    check_ops(spark, t, t, SAME if D.family(t) != "uint" else tuple(o for o in SAME if "sub" not in o))
    m = tc.asarray(np.eye(2).astype(D.numpy_type(t)), dtype=t, spark=spark)
    v = tc.asarray(np.array([1, 0]).astype(D.numpy_type(t)), dtype=t, spark=spark)
    assert m.H.dtype == m.conj().dtype == v.H.dtype == v.conj().dtype == t
    assert tc.dot(v, v) == 1
    for s in (2, 2.0):
        assert (v * s).df.count() >= 1 and (v + s).df.count() == 2


@pytest.mark.parametrize("s,t", PAIRS)
def test_mixed_type_operations(spark, s, t):
    check_ops(spark, s, t, MIXED if "uint" not in D.resolve("add", s, t) else tuple(o for o in MIXED if "sub" not in o))


def test_constructors(spark):
    assert (N(tc.zeros((2, 3), dtype="int8", spark=spark)) == np.zeros((2, 3))).all()
    assert (N(tc.ones((2, 3), dtype=float, spark=spark)) == 1).all()
    assert (N(tc.identity([2, 3], spark=spark)) == np.eye(2, 3)).all()
    assert N(tc.unit_vector(5, 2, spark)).tolist() == [0, 0, 1, 0, 0]
    assert tc.matrix([[0, 1.5], [0, 0]], spark=spark).structure == "triangular"
    assert tc.matrix([[True, False], [True, True]], spark=spark).dtype == "bit"
    assert tc.matrix([[1, 2]], spark=spark).dtype == "int32"
    assert tc.asarray(np.ones(2, dtype=np.float32), spark=spark).dtype == "float64"
    assert tc.asarray(np.ones((2, 2), dtype=np.float32), spark=spark).dtype == "float32"
    assert tc.UInt64Matrix(2, 3, spark=spark).shape == (2, 3)
    assert N(tc.UInt64Vector(np.array([2**63, 1], dtype=np.uint64), spark=spark)).tolist() == [2**63, 1]
    with pytest.raises(TypeError):
        tc.matrix(3, spark=spark)
    with pytest.raises(OverflowError):
        tc.vector([300], dtype="int8", spark=spark)
    with pytest.warns(UserWarning):
        c = tc.causal_matrix(np.array([[1, 2], [0, 0]]), spark=spark)
    assert (N(c) == [[False, True], [False, False]]).all() and c[0, 1] == 1.0
    r = tc.random_causal(40, 0.5, 3, spark)
    assert (N(r) == N(tc.random_causal(40, 0.5, 3, spark))).all() and not np.tril(N(r)).any() and 250 < N(r).sum() < 530
    assert (N(tc.random_bits(3, 4, 1.0, 1, spark))).all()
    t = tc.matrix([[0.0, 2.0], [0.0, 0.0]], spark=spark)
    assert (N(tc.symmetric_from_triangular(t)) == [[0, 2], [2, 0]]).all() and (N(tc.antisymmetric_from_triangular(t)) == [[0, 2], [-2, 0]]).all()


def test_elementwise_and_broadcasting(spark):
    a, b = tc.asarray(A, spark=spark), tc.asarray(B, spark=spark)
    with np.errstate(all="ignore"):
        for got, want in ((a + b, A + B), (a - b, A - B), (a * b, A * B), (a / b, A / B), (-a, -A), (a + 1.0, A + 1), (2.0 - a, 2 - A), (a * 3.0, A * 3), (a / 0.0, A / 0), (1.0 / a, 1 / A), (a + A[:1], A + A[:1]), (a * A[:, :1], A * A[:, :1])):
            np.testing.assert_array_equal(N(got), want)
        for f, g in ((tc.sin, np.sin), (tc.cos, np.cos), (tc.exp, np.exp), (tc.log, np.log), (tc.absolute, np.abs)):
            np.testing.assert_allclose(N(f(a)), g(A))
    np.testing.assert_array_equal(N(tc.add_all(a, b, a)), A + B + A)
    with pytest.raises(ValueError):
        a + tc.ones((3, 5), dtype=float, spark=spark)
    i = tc.matrix([[1, 2], [3, 4]], dtype="int8", spark=spark)
    assert (N(~i) == ~np.array([[1, 2], [3, 4]], dtype=np.int8)).all()
    half = tc.vector([1.0, 2.0], dtype="float16", spark=spark) * 1.0009765625
    assert N(half).dtype == np.float16
    v = tc.vector([1 + 2j, 3j], spark=spark)
    np.testing.assert_array_equal(N(v * 2j), np.array([1 + 2j, 3j]) * 2j)
    with pytest.raises(TypeError):
        tc.vector([1.0], spark=spark) * 1j


def test_half_rounding(spark):
    x = np.array([0.1, 1 / 3, 65504.0, 65519.0, 65520.0, 6e-8, 2.9e-8, -2049.0, 2051.0])
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i bigint, v double")
    got = N(tc.from_frame(df, len(x)).as_type("float16"))
    with np.errstate(over="ignore"):
        np.testing.assert_array_equal(got, x.astype(np.float16))


def test_bits(spark):
    x, y = rng.random((4, 6)) < 0.5, rng.random((4, 6)) < 0.5
    a, b = tc.asarray(x, spark=spark), tc.asarray(y, spark=spark)
    for got, want in ((a & b, x & y), (a | b, x | y), (a ^ b, x ^ y), (~a, ~x), (a * b, x & y)):
        np.testing.assert_array_equal(N(got), want)
    np.testing.assert_array_equal(N(a @ b.T), x.astype(int) @ y.T.astype(int))
    c = tc.random_causal(6, 0.5, 2, spark)
    np.testing.assert_array_equal(N(~c), np.triu(~N(c), 1))


def test_products(spark):
    a, b, v = tc.asarray(A, spark=spark), tc.asarray(B, spark=spark), tc.asarray(A[0], spark=spark)
    np.testing.assert_allclose(N(a @ b), A @ B)
    np.testing.assert_allclose(N(products.matmul(a, b, "block")), A @ B)
    np.testing.assert_allclose(N((a @ b).T), N(b.T @ a.T))
    np.testing.assert_allclose(N(a @ v), A @ A[0])
    np.testing.assert_allclose(N(v.T @ a), A[0] @ A)
    np.testing.assert_allclose(N(a @ B), A @ B)
    d = tc.diagonal_matrix([1.0, 2.0, 3.0, 4.0, 5.0], spark=spark)
    np.testing.assert_allclose(N(d @ a), np.diag([1, 2, 3, 4, 5]) @ A)
    np.testing.assert_allclose(N(a @ d), A @ np.diag([1, 2, 3, 4, 5]))
    assert tc.last_io_trace("matmul")["route"] == "diagonal"
    np.testing.assert_allclose(N(tc.identity(5, spark=spark) @ a), A)
    big = products.BLOCK
    try:
        products.BLOCK = 3
        np.testing.assert_allclose(N(products.matmul(a, b, "block")), A @ B)
    finally:
        products.BLOCK = big
    z = tc.asarray(A + 1j * B, spark=spark)
    np.testing.assert_allclose(N(z @ z), (A + 1j * B) @ (A + 1j * B))
    np.testing.assert_allclose(N(products.matmul(z, z, "block")), (A + 1j * B) @ (A + 1j * B))
    with pytest.raises(Exception):
        m = tc.matrix([[2**31 - 1]], dtype="int32", spark=spark)
        (m @ tc.matrix([[2]], dtype="int32", spark=spark)).df.collect()


def test_reductions(spark):
    a, v = tc.asarray(A, spark=spark), tc.vector([3.0, 4.0], spark=spark)
    assert tc.norm(v) == 5 and tc.sum(tc.vector([1, 2, 3], spark=spark)) == 6 + 0j
    assert np.isclose(tc.determinant(a), np.linalg.det(A)) and a.trace() == np.trace(A)
    assert a.properties["trace"] == np.trace(A)
    assert (tc.vector([1, 2, 3], spark=spark).T @ tc.vector([4, 5, 6], spark=spark)) == 32
    assert tc.vector([True, True, False], spark=spark).T @ tc.vector([True, False, True], spark=spark) == 1
    assert N(tc.cross_product(tc.vector([1.0, 0, 0], spark=spark), tc.vector([0, 1.0, 0], spark=spark))).tolist() == [0, 0, 1]
    assert tc.determinant(tc.diagonal_matrix([2.0, 3.0], spark=spark)) == 6
    assert tc.determinant(tc.random_causal(4, 0.5, 1, spark)) == 0
    big = tc.vector([2**62], dtype="int64", spark=spark)
    with pytest.raises(Exception):
        big.T @ big


def test_indexing(spark):
    a = tc.asarray(A, spark=spark)
    for key in ((slice(1, 4), slice(None)), (slice(None, None, 2), slice(4, 0, -1)), ([3, 1, 3], slice(None)), (slice(None), np.array([True, False, True, False, True])), (slice(2, 2), slice(None))):
        np.testing.assert_array_equal(N(a[key]), A[key])
    assert a[-1, 2] == A[-1, 2]
    np.testing.assert_array_equal(N(a[1, :]), A[1:2])
    np.testing.assert_array_equal(N(a[[0, 1], [2, 3]]), A[[0, 1], [2, 3]][None])
    np.testing.assert_array_equal(N(a[..., 1:3]), A[..., 1:3])
    for key, value in (((slice(0, 2), slice(0, 2)), 7.0), ((slice(None), [0, 3]), A[:, :2]), ((2, 2), 0.0), (([0, 1], [1, 0]), A[:1, :2])):
        m, want = a.copy(), A.copy()
        m[key] = value
        want[key] = value if np.isscalar(value) or not isinstance(key[0], list) else value[0]
        np.testing.assert_array_equal(N(m), want)
    v = tc.vector([1.0, 2.0, 3.0], spark=spark)
    v[1] = 9.0
    assert N(v).tolist() == [1, 9, 3] and v[-1] == 3 and N(v[1:]).tolist() == [9, 3]
    with pytest.raises(IndexError):
        a[9, 0]
    with pytest.raises(IndexError):
        a[np.array([True]), :]
    with pytest.warns(UserWarning):
        tc.random_causal(4, 0.5, 1, spark)[2, 1] = 1
    np.testing.assert_array_equal(N(tc.submatrix(a, 1, 1, 3, 3)), A[1:4, 1:4])
    assert "float64" in str(a)


def test_blocks(spark):
    a = tc.asarray(A, spark=spark)
    m = tc.matrix([[a, a], [a, a]])
    assert m.row_partitions == [0, 5, 10]
    np.testing.assert_array_equal(N(m), np.block([[A, A], [A, A]]))
    np.testing.assert_array_equal(N(m.get_block(1, 0)), A)
    np.testing.assert_array_equal(N(m.set_block(0, 1, tc.zeros((5, 5), dtype=float, spark=spark))), np.block([[A, A * 0], [A, A]]))
    with pytest.raises(ValueError):
        blocks.refine(m, [0, 10], [0, 10])
    calls = []
    t = tc.Thunk(lambda: calls.append(1) or a)
    assert t() is t() and calls == [1]
    with pytest.raises(TypeError):
        tc.matrix([[a, [1]]])


def test_linear_algebra(spark):
    s = A @ A.T + 5 * np.eye(5)
    m, b = tc.asarray(s, spark=spark), tc.asarray(B[0], spark=spark)
    np.testing.assert_allclose(N(tc.invert(m)), np.linalg.inv(s), rtol=1e-10)
    np.testing.assert_allclose(N(tc.solve(m, b)), np.linalg.solve(s, B[0]), rtol=1e-10)
    np.testing.assert_allclose(N(tc.solve(m, B)), np.linalg.solve(s, B), rtol=1e-10)
    w, v = tc.eigh(m)
    np.testing.assert_allclose(N(w), np.linalg.eigvalsh(s), rtol=1e-10)
    np.testing.assert_allclose(N(v) @ np.diag(N(w)) @ N(v).T, s, atol=1e-9)
    np.testing.assert_allclose(N(tc.eigvalsh(m)), np.linalg.eigvalsh(s), rtol=1e-10)
    np.testing.assert_allclose(N(tc.lstsq(tc.matrix([[1.0, 1], [1, 2], [1, 3]], spark=spark), tc.vector([1.0, 2, 2], spark=spark))), [2 / 3, 0.5])
    q, r = tc.qr(m)
    np.testing.assert_allclose(N(q) @ N(r), s, rtol=1e-10)
    p, low, up = tc.lu(m)
    np.testing.assert_allclose(N(p) @ s, N(low) @ N(up), rtol=1e-10)
    np.testing.assert_allclose(np.sort(tc.eigvals_arnoldi(m, 2)), np.linalg.eigvalsh(s)[-2:], rtol=1e-6)
    np.testing.assert_allclose(N(tc.cholesky(m)), np.linalg.cholesky(s))
    assert np.isclose(tc.cond(m), np.linalg.norm(s) * np.linalg.norm(np.linalg.inv(s)))
    u = tc.matrix(np.triu(s).tolist(), spark=spark)
    with pytest.raises(ValueError):
        tc.solve_triangular(u, b)
    u.properties["is_upper_triangular"] = True
    np.testing.assert_allclose(N(tc.solve_triangular(u, b)), np.linalg.solve(np.triu(s), B[0]))
    with pytest.raises(Exception):
        tc.invert(tc.zeros((2, 2), dtype=float, spark=spark))
    with pytest.raises(ValueError):
        tc.invert(tc.random_causal(3, 0.5, 1, spark))


def test_large_inverse_by_blocks(spark, monkeypatch):
    from tessera.operators import linalg

    monkeypatch.setattr(linalg, "SINGLE", 3)
    s = A[:4, :4] @ A[:4, :4].T + 5 * np.eye(4)
    np.testing.assert_allclose(N(tc.invert(tc.asarray(s, spark=spark))), np.linalg.inv(s), rtol=1e-9)


def test_properties(spark):
    m = tc.asarray(A, spark=spark)
    m.properties["is_upper_triangular"] = True
    assert m.T.properties == {"is_lower_triangular": True}
    with pytest.raises(ValueError):
        m.properties = {"is_identity": True, "has_zero_diagonal": True}
    with pytest.raises(KeyError):
        m.properties["is_nice"] = True
    with pytest.raises(ValueError):
        tc.ones((2, 3), dtype=float, spark=spark).properties["is_symmetric"] = True
    m.properties = {"trace": 2.0, "norm": 3.0, "is_symmetric": True}
    scaled = m * -2.0
    assert scaled.properties["trace"] == -4 and scaled.properties["norm"] == 6 and scaled.properties["is_symmetric"]
    m[0, 1] = 5.0
    assert "is_symmetric" not in m.properties and "trace" not in m.properties


def test_storage(spark, tmp_path):
    m = tc.matrix([[1 + 2j, 0], [0, 3]], spark=spark)
    m.properties["is_diagonal"] = True
    tc.save(m, tmp_path / "m")
    back = tc.load(tmp_path / "m", spark)
    np.testing.assert_array_equal(N(back), N(m))
    assert back.properties == {"is_diagonal": True} and back.dtype == m.dtype
    b = tc.matrix([[tc.asarray(A, spark=spark), tc.asarray(B, spark=spark)]])
    tc.save(b, tmp_path / "b")
    assert tc.load(tmp_path / "b", spark).col_partitions == [0, 5, 10]
    np.testing.assert_array_equal(N(tc.load(tmp_path / "b", spark)), np.hstack([A, B]))
    tc.save_npy(b, tmp_path / "b.npy")
    tc.convert_file(tmp_path / "b.npy", tmp_path / "b.npz", spark=spark)
    np.testing.assert_array_equal(N(tc.load_npz(tmp_path / "b.npz", spark=spark)), np.hstack([A, B]))
    assert tc.inspect(tmp_path / "m", spark)["dtype"] == "complex_float64"
    c = tc.CausalSet(20, seed="name", spark=spark)
    c.save(tmp_path / "c")
    assert (N(tc.CausalSet.load(tmp_path / "c").C) == N(c.C)).all()
    tc.set_export_max_bytes(10)
    try:
        with pytest.raises(MemoryError):
            N(b)
        assert N(b, allow_huge=True).shape == (5, 10)
    finally:
        tc.set_export_max_bytes(1 << 31)
    tc.set_backing_dir(tmp_path)
    np.testing.assert_allclose(N(tc.kept_inverse(tc.asarray(np.diag([2.0, 4.0]), spark=spark), "x")), np.diag([0.5, 0.25]))


def test_no_action_while_planning(spark):
    """Operations on arrays only plan; jobs run when values are asked for."""
    a = tc.asarray(A, spark=spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    (a @ a + a * 2.0 - a.T / 3.0)[1:3, :]
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")


def test_associativity_on_integers(spark):
    x = [tc.asarray(rng.integers(-3, 4, (4, 4)).astype(np.int64), spark=spark) for _ in range(3)]
    np.testing.assert_array_equal(N((x[0] @ x[1]) @ x[2]), N(x[0] @ (x[1] @ x[2])))
    assert list(itertools.chain([1])) == [1] and elementwise and indexing and reductions and warnings


def test_factorisations_by_blocks(spark, monkeypatch):
    """Above SINGLE rows nothing is gathered whole."""
    from tessera.operators import linalg

    monkeypatch.setattr(linalg, "SINGLE", 4)
    g = np.random.default_rng(8)
    x, tall, b = g.normal(size=(9, 9)) + 9 * np.eye(9), g.normal(size=(11, 3)), g.normal(size=9)
    a, t = tc.asarray(x, spark=spark), tc.asarray(tall, spark=spark)
    sign, size = tc.slogdet(a)
    assert sign == np.linalg.slogdet(x)[0] and np.isclose(size, np.linalg.slogdet(x)[1])
    np.testing.assert_allclose(N(tc.cholesky(a @ a.T)), np.linalg.cholesky(x @ x.T), atol=1e-8)
    for name, part in (("is_upper_triangular", np.triu(x)), ("is_lower_triangular", np.tril(x))):
        m = tc.asarray(part, spark=spark)
        m.properties = {name: True}
        np.testing.assert_allclose(N(tc.solve_triangular(m, tc.asarray(b, spark=spark))).ravel(), np.linalg.solve(part, b), atol=1e-9)
    q, r = tc.qr(t)
    np.testing.assert_allclose(N(q @ r), tall, atol=1e-9)
    np.testing.assert_allclose(N(q.T @ q), np.eye(3), atol=1e-9)
    np.testing.assert_allclose(N(tc.svd(t)[1]).ravel(), np.linalg.svd(tall, compute_uv=False), atol=1e-9)
    np.testing.assert_allclose(N(tc.pinv(t)), np.linalg.pinv(tall), atol=1e-9)


def test_kept_inverse_goes_by_content(spark, tmp_path):
    tc.set_backing_dir(f"file://{tmp_path}")
    for d in (5.0, 10.0):
        assert N(tc.kept_inverse(tc.asarray(np.diag([d, d]), spark=spark), "x"))[0, 0] == 1 / d


def test_eig_and_batch(spark):
    x = np.array([[2.0, 1.0], [0.0, 3.0]])
    a = tc.asarray(x, spark=spark)
    assert np.allclose(sorted(N(tc.eigvals(a)).real.ravel()), [2, 3])
    w, v = (N(z) for z in tc.eig(a))
    np.testing.assert_allclose(x @ v, v * w.ravel(), atol=1e-9)
    s = tc.asarray(np.array([[0.0, 2.0], [-2.0, 0.0]]), spark=spark)
    assert np.allclose(sorted(N(tc.eigvals_skew(s)).imag.ravel()), [-2, 2])
    np.testing.assert_allclose(N(tc.batch_gemv(a, a)), x @ x)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_with_a_row_or_column_repeat_nothing(spark):
    """A factor of one row or column meets the stored cells of the other, whatever the height."""
    tall = tc.Matrix(spark.createDataFrame([(0, 1, 2.0), (1 << 40, 1, 3.0), (1 << 40, 4, 5.0)], "i bigint, j bigint, v double"), (1 << 40) + 1, 5, "float64")
    row = tc.vector([1.0, 2.0, 0.0, 0.0, 4.0], spark=spark).T
    want = [(0, 1, 4.0), (1 << 40, 1, 6.0), (1 << 40, 4, 20.0)]
    for got in (tall * row, row * tall, tall * tc.matrix([[1.0, 2.0, 0.0, 0.0, 4.0]], spark=spark)):
        assert "Generate" not in _plan(got.df)
        assert sorted(map(tuple, got.df.collect())) == want and got.shape == tall.shape
    turned = tall.T * row.T
    assert sorted(map(tuple, turned.df.collect())) == sorted((j, i, v) for i, j, v in want)
    u, v = np.array([1, 2, 0]), np.array([[3, 0, 4, 5]])
    both = tc.vector(u, spark=spark) * tc.matrix(v, spark=spark)
    assert (N(both) == u[:, None] * v).all()
    bits = tc.matrix([[True, False], [True, True]], spark=spark) * tc.matrix([[False, True]], spark=spark)
    assert bits.dtype == "bit" and (N(bits) == [[False, False], [False, True]]).all()
    assert (tc.zeros((0, 3), dtype="float64", spark=spark) * tc.ones((1, 3), dtype="float64", spark=spark)).df.count() == 0
    with pytest.raises(ValueError):
        tall * tc.vector([1.0, 2.0], spark=spark).T


def test_functions_of_chosen_cells(spark):
    """With ``where`` a function that has a value at zero takes the cells of a pattern, not the whole grid."""
    n = 1 << 40
    m = tc.Matrix(spark.createDataFrame([(0, n, 4), (n, 2, 1), (5, 5, 0)], "i bigint, j bigint, v int"), n + 1, n + 1, "int32")
    other = tc.Matrix(spark.createDataFrame([(0, n, True), (7, 7, True)], "i bigint, j bigint, v boolean"), n + 1, n + 1, "bit")
    got = {tuple(r)[:2]: r["v"] for r in tc.log(m, where=m).df.collect()}
    assert got == {(0, n): np.log(4), (n, 2): 0.0, (5, 5): -np.inf}
    assert {tuple(r) for r in tc.exp(m, where=other).df.collect()} == {(0, n, np.exp(4)), (7, 7, 1.0)}
    assert {tuple(r) for r in elementwise.bitwise_not(m, where=other).df.collect()} == {(0, n, -5), (7, 7, -1)}
    with pytest.raises(ValueError):
        tc.cos(m, where=tc.ones((2, 2), dtype="float64", spark=spark))


@pytest.mark.parametrize("name", ["logarithm", "integer_not"])
def test_no_query_of_stored_cells_makes_the_grid(spark, name):
    from tessera.plans import catalog

    plan = _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Range" not in plan and "Join" not in plan
