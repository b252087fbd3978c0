import duckdb
import pytest

import gavel.queries as engine
from gavel.sources.providers import fnv

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", engine.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    got = engine.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in engine.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    result = con.execute(engine.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    columns = sorted(names)
    assert sorted(got.columns) == columns
    text = lambda names, rows: sorted("|".join(str(dict(zip(names, r))[c]) for c in columns) for r in rows)
    assert text(got.columns, got.collect()) == text(names, result.fetchall())


def test_prob_documents(spark):
    assert set(engine.QUERIES) - set(engine.ORACLE_SQL) == {"prob_documents"}
    got = {r.doc_id: r.p for r in engine.QUERIES["prob_documents"](spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d.doc_id: fnv(d.text.encode() + b"noulis it clear?") % 1_000_001 / 1_000_000 for d in docs}
