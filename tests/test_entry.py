"""The driver's contract: names, SQL for most queries, and agreement on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import plain

SF = "/root/testdata/sf0.001"
CORE = sorted({k for m in entry.MODULES if ".llm" not in m.__name__ for k in m.QUERIES})


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p4_found", "p5_found"} <= set(CORE)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in entry.oracle_sql():
        assert cols
        return
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    rel = con.sql(entry.oracle_sql()[name])
    names = [c.lower() for c in rel.columns]
    assert sorted(rel.columns) == cols
    assert got == sorted(tuple(plain(r[names.index(c.lower())]) for c in cols) for r in rel.fetchall())
