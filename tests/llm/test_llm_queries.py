"""The registered queries over the supplied tables, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corollary.llm import queries
from corollary.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    assert f"op{name[2:].split('_')[0]}_" in name and not queries.QUERIES[name](spark, SF).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_registered():
    found = entry.queries()
    assert {n for n in found if n.startswith("op")} == set(queries.QUERIES) and len(queries.QUERIES) == 10
    assert found["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]


def test_pipeline_stages(spark):
    """Each stage keeps the columns of documents, takes rows away and never adds any; the last one packs all that is left."""
    docs = table(spark, SF, "documents")
    ids, sizes = None, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = out.persist()
        sizes.append(out.count())
        now = {r[0] for r in out.select("doc_id").collect()}
        assert ids is None or now <= ids
        ids, docs = now, out
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1]
    assert docs.select("text").distinct().count() == docs.count()
    windows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for w in windows for p in w.pieces} == {r.doc_id for r in docs.collect() if r.text}
    assert sorted(r.window_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(w.window_id for w in windows)
