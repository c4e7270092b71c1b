"""The driver's tables, and the views of this domain over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (ns, id, field, text) in one namespace and field."""
    return load(spark, sf_dir, "documents").select(F.lit("default").alias("ns"), F.col("doc_id").alias("id"), F.lit("text").alias("field"), "text")


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as fielded documents: title and url."""
    pages = load(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return pages.select(F.lit("default").alias("ns"), F.col("page_id").alias("id"), F.explode(F.create_map(F.lit("title"), title, F.lit("url"), F.col("url"))).alias("field", "text"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("default").alias("ns"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.lit("default").alias("ns"), F.col("vec_id").alias("id"), "embedding", F.format_string('{"label":%d}', "label").alias("metadata"), "label")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as entities of one graph; a customer is valid from the first order on."""
    t = lambda n: load(spark, sf_dir, n)
    first = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("timestamp").alias("valid_from"))
    none = F.lit(None).cast("timestamp")
    conf = lambda c: (F.pmod(c, F.lit(10)) + 1) / F.lit(10.0)
    parts = [
        t("region").select((F.col("r_regionkey").cast("long")).alias("id"), F.col("r_name").alias("name"), F.lit("Region").alias("entity_type"), none.alias("valid_from"), F.lit(None).cast("double").alias("conf_overall")),
        t("nation").select((F.col("n_nationkey").cast("long") + 100).alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("entity_type"), none.alias("valid_from"), F.lit(None).cast("double").alias("conf_overall")),
        t("supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.col("s_name").alias("name"), F.lit("Supplier").alias("entity_type"), none.alias("valid_from"), conf(F.col("s_suppkey")).alias("conf_overall")),
        t("customer").join(first.hint("merge"), "c_custkey", "left").select((F.col("c_custkey") + 2_000_000_000).alias("id"), F.col("c_name").alias("name"), F.lit("Customer").alias("entity_type"), "valid_from", conf(F.col("c_custkey")).alias("conf_overall")),
        t("part").select((F.col("p_partkey") + 3_000_000_000).alias("id"), F.col("p_name").alias("name"), F.lit("Part").alias("entity_type"), none.alias("valid_from"), conf(F.col("p_size").cast("long")).alias("conf_overall")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    state = F.when(F.pmod("id", F.lit(17)) == 3, "retracted").otherwise("active")
    return out.select(F.lit("default").alias("ns"), "*", none.alias("valid_to"), state.alias("assertion_state"), F.format_string('{"external_refs":[{"source":"tpch","external_id":"%d"}]}', "id").alias("properties"))


ENTITIES_SQL = """
ent0 AS (
  SELECT r_regionkey::BIGINT AS id, r_name AS name, 'Region' AS entity_type, NULL::TIMESTAMP AS valid_from, NULL::DOUBLE AS conf_overall FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 100, n_name, 'Nation', NULL, NULL FROM nation
  UNION ALL SELECT s_suppkey + 1000000000, s_name, 'Supplier', NULL, (s_suppkey % 10 + 1) / 10.0::DOUBLE FROM supplier
  UNION ALL SELECT c_custkey + 2000000000, c_name, 'Customer', f, (c_custkey % 10 + 1) / 10.0::DOUBLE FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey
  UNION ALL SELECT p_partkey + 3000000000, p_name, 'Part', NULL, (p_size % 10 + 1) / 10.0::DOUBLE FROM part),
ent AS (SELECT *, NULL::TIMESTAMP AS valid_to, CASE WHEN id % 17 = 3 THEN 'retracted' ELSE 'active' END AS assertion_state FROM ent0)
"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges over entities(): geography, what customers bought (from the order's day to their next order's), and a causal graph over parts."""
    t = lambda n: load(spark, sf_dir, n)
    from pyspark.sql import Window

    none = F.lit(None).cast("timestamp")
    orders = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.lead(F.col("o_orderdate").cast("timestamp")).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("valid_to"))
    bought = t("lineitem").join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in ("CAUSES", "ENABLES", "TRIGGERS", "REQUIRES")])
    rows = [
        t("nation").select((F.col("n_nationkey").cast("long") + 1).alias("id"), (F.col("n_nationkey").cast("long") + 100).alias("from_id"), F.col("n_regionkey").cast("long").alias("to_id"), F.lit("PART_OF").alias("relation_type"), none.alias("valid_from"), none.alias("valid_to"), F.lit(None).cast("double").alias("causal_strength"), F.lit(None).cast("double").alias("conf_overall")),
        t("supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), (F.col("s_suppkey") + 1_000_000_000).alias("from_id"), (F.col("s_nationkey").cast("long") + 100).alias("to_id"), F.lit("LOCATED_IN").alias("relation_type"), none.alias("valid_from"), none.alias("valid_to"), F.lit(None).cast("double").alias("causal_strength"), F.lit(0.9).alias("conf_overall")),
        t("customer").select((F.col("c_custkey") + 2_000_000_000).alias("id"), (F.col("c_custkey") + 2_000_000_000).alias("from_id"), (F.col("c_nationkey").cast("long") + 100).alias("to_id"), F.lit("LOCATED_IN").alias("relation_type"), none.alias("valid_from"), none.alias("valid_to"), F.lit(None).cast("double").alias("causal_strength"), F.lit(0.8).alias("conf_overall")),
        bought.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 10_000_000_000).alias("id"), (F.col("o_custkey") + 2_000_000_000).alias("from_id"), (F.col("l_partkey") + 3_000_000_000).alias("to_id"), F.lit("BOUGHT").alias("relation_type"), "valid_from", "valid_to", F.lit(None).cast("double").alias("causal_strength"), (F.lit(1.0) - F.col("l_discount")).alias("conf_overall")),
        # part k leads to parts 2k and 2k + 1: a forest, of which parts divisible by 9 are cut off
        t("part").where(part > 1).select((part + 3_000_000_000).alias("id"), (F.floor(part / 2) + 3_000_000_000).alias("from_id"), (part + 3_000_000_000).alias("to_id"), F.element_at(kinds, (F.pmod(part, F.lit(4)) + 1).cast("int")).alias("relation_type"), none.alias("valid_from"), none.alias("valid_to"), F.when(F.pmod(part, F.lit(5)) > 0, F.col("p_size") / F.lit(50.0)).alias("causal_strength"), (F.lit(1.0) - F.pmod(part, F.lit(7)) / F.lit(10.0)).alias("conf_overall")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    state = F.when(F.pmod("to_id", F.lit(9)) == 3, "retracted").when(F.pmod("id", F.lit(23)) == 5, "superseded").otherwise("active")
    return out.select(F.lit("default").alias("ns"), "*", state.alias("assertion_state"))


RELATIONS_SQL = """
ord AS (SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders),
rel0 AS (
  SELECT n_nationkey::BIGINT + 1 AS id, n_nationkey::BIGINT + 100 AS from_id, n_regionkey::BIGINT AS to_id, 'PART_OF' AS relation_type, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to, NULL::DOUBLE AS causal_strength, NULL::DOUBLE AS conf_overall FROM nation
  UNION ALL SELECT s_suppkey + 1000000000, s_suppkey + 1000000000, s_nationkey::BIGINT + 100, 'LOCATED_IN', NULL, NULL, NULL, 0.9::DOUBLE FROM supplier
  UNION ALL SELECT c_custkey + 2000000000, c_custkey + 2000000000, c_nationkey::BIGINT + 100, 'LOCATED_IN', NULL, NULL, NULL, 0.8::DOUBLE FROM customer
  UNION ALL SELECT l_orderkey * 10 + l_linenumber + 10000000000, o_custkey + 2000000000, l_partkey + 3000000000, 'BOUGHT', valid_from, valid_to, NULL, 1.0::DOUBLE - l_discount FROM lineitem JOIN ord ON l_orderkey = o_orderkey
  UNION ALL SELECT p_partkey + 3000000000, p_partkey // 2 + 3000000000, p_partkey + 3000000000, (['CAUSES', 'ENABLES', 'TRIGGERS', 'REQUIRES'])[p_partkey % 4 + 1], NULL, NULL, CASE WHEN p_partkey % 5 > 0 THEN p_size / 50.0::DOUBLE END, 1.0::DOUBLE - (p_partkey % 7) / 10.0::DOUBLE FROM part WHERE p_partkey > 1),
rel AS (SELECT *, CASE WHEN to_id % 9 = 3 THEN 'retracted' WHEN id % 23 = 5 THEN 'superseded' ELSE 'active' END AS assertion_state FROM rel0)
"""
