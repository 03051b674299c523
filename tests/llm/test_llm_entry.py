"""Queries of the subpackage on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandlog.llm import queries
from tools.compare import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in queries.ORACLE:
        con = duckdb.connect()
        con.sql("SET TimeZone='UTC'")
        for p in Path(SF).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
        rel = con.sql(queries.ORACLE[name])
        names = [c.lower() for c in rel.columns]
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    else:
        assert got


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_ids_of_all_documents(spark):
    tokenizers, tables = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(tables.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, SF).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_percentiles_are_close_and_units_lie_in_their_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ends = queries.p9_found(spark, SF).collect()
    assert len(ends) == len({(r.doc_id, r.end_pos) for r in ends}) and all(not texts[r.doc_id][r.end_pos - 1].isspace() for r in ends)
    for r in queries.p3_percentiles(spark, SF).collect():
        assert r.p50 <= r.p90 <= r.p99 <= r.p999
