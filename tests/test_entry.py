import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


FAST = ["path_counts", "hasse_links", "spmm_part_supplier_gram", "divide", "k_matrix", "lstsq_normal_eq", "bit_xor", "assign"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", FAST + sorted(k for k, f in catalog.QUERIES.items() if f.__module__.endswith("contracts")))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(catalog.ORACLE[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    assert got.astype(str).sort_values(order).values.tolist() == want.astype(str).sort_values(order).values.tolist()
