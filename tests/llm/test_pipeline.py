"""The stages by brute force on a small folder, and the registered queries."""

import duckdb
import pytest
from brookspan.llm import queries

import corpus_pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    wanted = duck.sql(queries.ORACLES[name])
    places = [wanted.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in places)) for r in wanted.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0  # the last count is the mix
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
