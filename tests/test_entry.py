"""Registered queries of the lead engine against their oracle SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from prospectra.plans import catalogue, incremental, more  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con



@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    want = duck.execute(f"SELECT {columns} FROM ({catalogue.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
