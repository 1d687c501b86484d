"""The operators' queries that SQL can express, against DuckDB."""

import math
from pathlib import Path

import pytest
from tideline.llm.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    out = QUERIES[name](spark, sf_dir)
    columns = sorted(out.columns)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    want = sorted((tuple(clean(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=str)
    assert sorted((tuple(clean(r[c]) for c in columns) for r in out.collect()), key=str) == want
