"""The operators' queries that SQL can express, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from viewfold.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == want
