"""Every query of the base library against its SQL in DuckDB."""

import math
from pathlib import Path

import pytest

from tideline.plans.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")


def comparable(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = QUERIES[name](spark, sf_dir)
    rows = [tuple(comparable(r[c]) for c in sorted(out.columns)) for r in out.collect()]
    if name not in ORACLE:
        assert rows
        return
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    place = [columns.index(c) for c in sorted(columns)]
    want = [tuple(comparable(r[k]) for k in place) for r in cur.fetchall()]
    assert sorted(columns) == sorted(out.columns)
    assert sorted(rows, key=str) == sorted(want, key=str)
