"""Every query of the engine that has SQL gives the rows that DuckDB gives; the others return rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.plans import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}/*.parquet" if os.path.isdir(f"{DATA}/{name}") else f"{DATA}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(rows: list[dict]) -> list[tuple]:
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple((k, show(r[k])) for k in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert plain(got.to_pylist()) == plain([dict(zip(columns, r, strict=True)) for r in want.fetchall()])
    else:
        assert got.num_columns
