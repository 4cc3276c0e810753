"""The registered queries: against SQL where it can express them, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from tests.llm.conftest import DATA
from tidepanel.llm.queries import ORACLES, QUERIES
from tidepanel.session import saved

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


def test_names():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_pipeline_stages(spark, odd):
    docs = saved(odd.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars"), "stage-test")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = saved(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns
        texts = [r.text for r in out.collect()]
        if name == "language_id":
            assert len(texts) == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
        if name == "exact_dedup":
            low = [t.encode().lower() for t in texts]
            assert len(set(low)) == len(low) == len({r.text.encode().lower() for r in docs.collect()})
        if name == "simhash_dedup":
            assert len(texts) < n and "word" in texts
        docs, n = out, len(texts)
    pieces = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).collect() == []


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 100 and got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
