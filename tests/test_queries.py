"""Every registered query of the reference's operators: against DuckDB where SQL can express it, else that it runs over its tables."""

import pytest

from quillon.plans import registry
from tests.oracle import SMALL, assert_same

registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SMALL), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["knn_all", "result_entropy_all", "info_gain_all", "relation_embeddings_all"])
def test_every_vector_asks(spark, name):
    ids = {r[0] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id").collect()}
    assert {r[0] for r in registry.QUERIES[name](spark, SMALL).select("query_id").collect()} == ids
