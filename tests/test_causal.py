import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera as tc
from tessera.operators import causal
from tessera.streaming.relation import accumulate, maintain_relation

N = tc.to_numpy


def precedes(st, p, q):
    if isinstance(st, tc.MinkowskiDiamond):
        return all(a < b for a, b in zip(p, q))
    dt = q[0] - p[0]
    if isinstance(st, tc.MinkowskiCylinder):
        dx = abs(q[1] - p[1])
        return dt > 0 and dt > min(dx, st.circumference - dx)
    return dt > 0 and dt * dt > sum((b - a) ** 2 for a, b in zip(p[1:], q[1:]))


@pytest.mark.parametrize("st", [tc.MinkowskiDiamond(2), tc.MinkowskiDiamond(4), tc.MinkowskiCylinder(2, 2.0, 1.0), tc.MinkowskiBox(3, 1.0, 1.0)])
@pytest.mark.parametrize("order", ["index", "time"])
def test_relation(spark, st, order):
    c = tc.CausalSet(60, spacetime=st, seed=3, order=order, spark=spark)
    x = c.coordinates()
    want = np.array([[i != j and (order == "time" or i < j) and precedes(st, x[i], x[j]) for j in range(60)] for i in range(60)])
    np.testing.assert_array_equal(N(c.C), want)
    small = causal.relation(c.points(), st.precedes, order, block=7)
    assert {tuple(r) for r in small.collect()} == set(zip(*map(list, np.nonzero(want))))


@pytest.mark.parametrize("order", ["index", "time"])
def test_relation_within_sets(spark, order):
    rng, st = np.random.default_rng(2), tc.MinkowskiBox(2, 1.0, 1.0)
    rows = [(int(i), None if i % 50 == 0 else "hot" if i % 3 else f"u{i % 7}", *map(float, rng.random(2))) for i in rng.permutation(120)]
    points = spark.createDataFrame(rows, "id bigint, u string, c0 double, c1 double")
    want = {(a[1], a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[0] != b[0] and (order == "time" or a[0] < b[0]) and precedes(st, a[2:], b[2:])}
    for block in (5, 2048):
        got = [tuple(r) for r in causal.relation(points, st.precedes, order, block=block, within="u").collect()]
        assert len(got) == len(want) and set(got) == want
    assert causal.relation(points.filter("false"), st.precedes, order, within="u").count() == 0


def test_points_follow_the_seed(spark):
    a, b, other = (tc.CausalSet(50, seed=s, spark=spark) for s in (12345, 12345, 7))
    np.testing.assert_array_equal(a.coordinates(), b.coordinates())
    assert not np.allclose(a.coordinates(), other.coordinates())
    np.testing.assert_array_equal(a.coordinates([49, 3, 3]), a.coordinates()[[49, 3, 3]])
    assert len(tc.CausalSet(density=100, seed=42, spark=spark)) == len(tc.CausalSet(density=100, seed=42, spark=spark))
    with pytest.raises(ValueError):
        tc.CausalSet(spark=spark)
    assert tc.CausalSet(density=10, spacetime=tc.MinkowskiBox(2, 2.0, 3.0), seed=1, spark=spark).spacetime.volume() == 6
    assert a.spacetime.get_boundary()[0].shape == (5, 2)


def test_links_and_paths(spark):
    c = tc.CausalSet(40, seed=5, spark=spark)
    m = N(c.C).astype(int)
    two = m @ m
    np.testing.assert_array_equal(N(c.path_counts()), two)
    link = N(c.links())
    np.testing.assert_array_equal(link, (m > 0) & (two == 0))
    reach = link.copy()
    for _ in range(40):
        reach = reach | ((reach.astype(int) @ link.astype(int)) > 0)
    np.testing.assert_array_equal(reach, m > 0)


@pytest.mark.parametrize("n,p,a", [(60, 0.5, 2.0), (10, 0.0, 1.0), (10, 1.0, 1.0)])
@pytest.mark.parametrize("method", ["columns", "series"])
def test_k(spark, n, p, a, method):
    c = tc.random_causal(n, p, 1, spark)
    m = N(c).astype(float)
    np.testing.assert_allclose(N(tc.compute_k(c, a, method)), m @ np.linalg.inv(a * np.eye(n) + m), atol=1e-6)


def test_fields(spark):
    c = tc.CausalSet(30, seed=2, spark=spark)
    np.testing.assert_allclose(N(tc.ScalarField(c).propagator()), 0.5 * N(c.C))
    f = tc.ScalarField(c, 1.0)
    assert f.coefficients() == (0.5, -1 / 30)
    np.testing.assert_allclose(N(f.propagator(1.0, -0.5)), 2 * N(tc.compute_k(c.C, 2.0)))
    k = N(f.propagator())
    np.testing.assert_allclose(N(f.pauli_jordan()), 1j * (k - k.T))
    four = tc.ScalarField(tc.CausalSet(10, spacetime=tc.MinkowskiDiamond(4), seed=2, spark=spark), 2.0)
    assert np.isclose(four.coefficients()[0], math.sqrt(10) / (2 * math.pi * math.sqrt(6)))
    with pytest.raises(NotImplementedError):
        tc.ScalarField(tc.CausalSet(10, spacetime=tc.MinkowskiDiamond(3), seed=2, spark=spark)).propagator()


def test_plot_data(spark):
    c = tc.CausalSet(30, seed=2, spark=spark)
    xy, edges = causal.hasse_plot_data(c)
    assert xy.shape == (30, 2) and len(edges) == N(c.links()).sum()
    assert causal.heatmap_data(c).shape == (30, 30)


def test_streamed_relation(spark, tmp_path):
    st = tc.MinkowskiDiamond(2)
    points = st.points(spark, 60, 9).orderBy(F.xxhash64("id"))
    for k in range(3):
        points.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = maintain_relation(stream, st.precedes, str(tmp_path / "out"), str(tmp_path / "ck"), block=16)
    q.awaitTermination()
    got = {(r["i"], r["j"]) for r in spark.read.parquet(str(tmp_path / "out/edges")).collect()}
    assert got == {tuple(r) for r in causal.relation(points, st.precedes, "time").collect()}


def test_streamed_sum(spark, tmp_path):
    for v in (1.0, 2.0):
        spark.createDataFrame([(0, 1, v), (1, 1, v)], "i bigint, j bigint, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "cells"))
    stream = spark.readStream.schema("i bigint, j bigint, v double").parquet(str(tmp_path / "cells"))
    accumulate(stream, "summed").awaitTermination()
    assert {tuple(r) for r in spark.table("summed").collect()} == {(0, 1, 3.0), (1, 1, 3.0)}
