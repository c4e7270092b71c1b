"""The pipeline and the registered queries: SQL where there is some, and what each stage must keep."""

import pytest

import corpus_pipeline
from quillon.llm import jaccard_join, queries
from tests.llm.data import CLASH, docs, taken
from tests.llm.test_search_join import jaccard_brute
from tests.oracle import SMALL, assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_cover_their_table(spark, name):
    table = spark.read.parquet(f"{SMALL}/{'pages' if 'warc' in name else 'documents'}.parquet")
    out = queries.QUERIES[name](spark, SMALL)
    key = "page_id" if "warc" in name else "doc_id"
    ids = {r[0] for r in out.select(key).collect()}
    every = {r[0] for r in table.select(key).collect()}
    assert ids <= every
    if "mix" not in name and "license" not in name:  # these give rows for some documents only
        assert ids == every


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "mixing", "packing"]
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in d.collect()}
        d = corpus_pipeline.write_table(stage(spark, d, SMALL), name)
        assert d.columns == columns
        after = {r.doc_id: r.text for r in d.collect()}
        assert after.items() <= before.items() and after
        if name == "near_duplicates":
            pairs = jaccard_brute(list(before.items()), jaccard_join.THRESHOLD)
            parent = {i: i for i in before}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                a, b = sorted((find(a), find(b)))
                parent[b] = a
            assert set(after) == {i for i in before if find(i) == i}
    packed = taken(corpus_pipeline.STAGES[-1][1](spark, d, SMALL))
    assert sum(r[4] for r in packed) == sum(len(t.split()) for t in after.values())
    assert packed == taken(corpus_pipeline.run(spark, SMALL))


@pytest.mark.parametrize("clash", [False, True])
def test_stages_take_empty_tables_and_clashing_columns(spark, clash):
    d = docs(spark, [], clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SMALL)
        assert out.collect() == [] and out.columns == d.columns
    assert corpus_pipeline.STAGES[-1][1](spark, d, SMALL).collect() == []
    assert len(set(CLASH)) == len(CLASH)


def test_packing_reads_what_mixing_kept(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["bin_id", "doc_id", "piece", "start", "n_tokens"]
