"""Products by tiles: the results of the join, and no pair of cells in a shuffle."""

import numpy as np
import pytest

import tessera as tc
from tessera.operators import products, tiles
from tessera.operators.array import Matrix
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
N = tc.to_numpy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


PRODUCTS = ["spmm_part_supplier_gram", "batch_of_columns", "int_matmul", "int_float_matmul", "multiply_alias", "mixed_int_matmul", "bit_float_matmul", "mixed_float_matmul", "bitbit_count"]


@pytest.mark.parametrize("name", PRODUCTS)
def test_large_products_shuffle_no_pairs(spark, monkeypatch, name):
    want = catalog.QUERIES[name](spark, SF)
    monkeypatch.setattr(products, "FEW", 0)
    got = catalog.QUERIES[name](spark, SF)
    text = plan(got)
    assert "MapInArrow" in text and "Exchange" not in text[: text.index("MapInArrow")] and got.dtypes == want.dtypes
    assert rows(got) == rows(want)


#: Tiles of a usual size, and so small that tiles are put away, lists are cut and sums of single cells merged.
SIZES = [{}, {"WIDE": 3, "HELD": 2, "LIST": 2, "RUNS": 50, "CHUNK": 40}]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("t", ["float64", "float32", "int64", "int8", "uint8", "bit"])
def test_tiles(spark, monkeypatch, sizes, t):
    for k, v in sizes.items():
        monkeypatch.setattr(tiles, k, v)
    monkeypatch.setattr(products, "FEW", 0)
    rng = np.random.default_rng(3)
    for n, k, m in ((40, 12, 70), (90, 20, 7)):
        x, y = ((rng.random(s) < 0.4) * rng.integers(0, 3, s) for s in ((n, k), (k, m)))
        a, b = (tc.asarray(z.astype(bool if t == "bit" else t), dtype=t, spark=spark) for z in (x, y))
        got = a @ b
        assert tc.last_io_trace("matmul")["route"] == "tiles"
        np.testing.assert_array_equal(N(got), (x > 0).astype(int) @ (y > 0) if t == "bit" else x @ y)


@pytest.mark.parametrize("sizes", SIZES)
def test_tiles_of_odd_cells(spark, monkeypatch, sizes):
    """Nulls, NaN, infinity, sums that are zero, cells beyond the shape and negative indices come out as of the join."""
    for k, v in sizes.items():
        monkeypatch.setattr(tiles, k, v)
    nan, inf = float("nan"), float("inf")
    left = [(0, 0, None), (0, 1, 2.0), (None, 0, 3.0), (1, None, 4.0), (2, 2, nan), (3, 3, 1.0), (3, 4, -1.0), (4, 0, None), (-7, 1, inf), (1 << 40, 1, 1.0), (5, 3, inf), (5, 4, inf), (6, 0, None), (6, 1, 1.0)]
    right = [(0, 0, 1.0), (0, None, 2.0), (1, 0, 5.0), (2, 1, 1.0), (3, 2, 1.0), (4, 2, -1.0), (None, 1, 1.0), (1, -9, 1.0), (1, 1 << 50, 2.0)]
    a = Matrix(spark.createDataFrame(left, "i bigint, j bigint, v double"), 100, 5, "float64")
    b = Matrix(spark.createDataFrame(right, "i bigint, j bigint, v double"), 5, 9, "float64")
    want = sorted(map(str, (a @ b).df.collect()))
    monkeypatch.setattr(products, "FEW", 0)
    assert sorted(map(str, (a @ b).df.collect())) == want
    assert sorted(map(str, (b.T @ a.T).T.df.select("i", "j", "v").collect())) == want
    assert (a @ Matrix(b.df.filter("false"), 5, 9, "float64")).df.count() == 0


def test_tiles_of_large_integers(spark, monkeypatch):
    monkeypatch.setattr(products, "FEW", 0)
    top = 1 << 62
    a = tc.asarray(np.array([[top, top], [0, -top]]), dtype="int64", spark=spark)
    assert N(a @ tc.asarray(np.array([[1, 0], [-1, 1]]), dtype="int64", spark=spark)).tolist() == [[0, top], [top, -top]]
    with pytest.raises(Exception, match="does not fit"):
        (a @ tc.asarray(np.array([[1], [1]]), dtype="int64", spark=spark)).df.collect()
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        (tc.matrix([[1 << 20]], dtype="int32", spark=spark) @ tc.matrix([[1 << 20]], dtype="int32", spark=spark)).df.collect()
