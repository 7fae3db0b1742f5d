import glob
import os

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(queries.oracle_sql()[name]).df()
    order = list(want.columns)
    got = queries.queries()[name](spark, SF).toPandas()[order]
    assert got.astype(str).sort_values(order).values.tolist() == want.astype(str).sort_values(order).values.tolist()


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in queries.queries()} == set(range(1, 11))
