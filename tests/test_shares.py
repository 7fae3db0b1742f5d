"""What a task is given does not grow with the table."""

import re

import pytest

import tessera as tc
from tessera.functions import frames
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df):
    """Numbers of tasks of the shuffles that do not take the session's, and keys of those that do."""
    own = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    shuffles = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", plan(df))
    return [int(n) for _, n in shuffles if n != own], [k for k, n in shuffles if n == own]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["hadamard", "add", "add_many", "path_counts", "hasse_links"])
def test_more_tasks_for_larger_tables(spark, monkeypatch, name):
    want = rows(catalog.QUERIES[name](spark, SF))
    found = []
    for share in (16_000, 4_000):
        monkeypatch.setattr(frames, "SHARE", share)
        df = catalog.QUERIES[name](spark, SF)
        fixed, others = dealt(df)
        assert fixed and all("user_id" in k for k in others)  # points of a user meet as Spark likes
        found.append(min(fixed))
    assert found[1] >= 3 * found[0] > 12
    monkeypatch.setattr(frames, "SHARE", 16_000)
    assert rows(catalog.QUERIES[name](spark, SF)) == want


def test_a_small_result_of_large_files_is_left_alone(spark, monkeypatch):
    monkeypatch.setattr(frames, "SHARE", 4_000)
    m = catalog.by_line(spark, SF)
    assert dealt((m + m).df)[0] == []


def test_blocks_are_saved_by_many_tasks(spark, monkeypatch, tmp_path):
    from tessera.operators import blocks

    monkeypatch.setattr(frames, "SHARE", 16_000)
    m = blocks.block_matrix([[catalog.quantities(spark, SF), catalog.lines(spark, SF)]])
    tc.save(m, tmp_path / "m")
    assert len(tc.inspect(tmp_path / "m", spark)["files"]) > 8
    got = tc.load(tmp_path / "m", spark)
    assert rows(got.df) == rows(m.df) and got.col_partitions == m.col_partitions
