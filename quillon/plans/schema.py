"""Queries over ontologies: aliases, validation, prompts, versions, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import ontology as ont
from quillon.plans.registry import query
from quillon.sources.tables import load

P = ont.Property
TRADE = ont.Ontology(
    "trade", "2",
    (
        ont.EntityType("Region"), ont.EntityType("Nation", "A country.", ("Country",)),
        ont.EntityType("Customer", " Who buys. ", ("Client", "Buyer"), (P("segment", required=True, allowed_values=("BUILDING", "MACHINERY", "HOUSEHOLD")), P("name", pattern="[02468]$"))),
        ont.EntityType("Part", None, ("Item", "Product"), (P("size", "number"), P("brand", required=True, pattern="^Brand#[0-9]$"), P("note", required=True)), (("[0-9]+ mm", "length"), ("SKU", None))),
    ),
    (
        ont.RelationType("LOCATED_IN", "Where it is.", ("Customer", "Supplier"), ("Nation",)),
        ont.RelationType("BOUGHT", None, ("Customer",), ("Part",), (P("quantity", "number", True), P("flag", allowed_values=("A", "N")))),
    ),
)

_ROWS_SQL = """
r AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'buyer' ELSE 'CLIENT' END AS entity_type, CASE WHEN c_acctbal < 5000 THEN c_mktsegment END AS segment, c_name AS name, NULL AS brand, NULL AS size, FALSE AS note FROM customer
  UNION ALL SELECT p_partkey + 1000000000, 'item', NULL, NULL, p_brand, p_size, p_size > 25 FROM part UNION ALL SELECT s_suppkey + 2000000000, 'Supplier', NULL, NULL, NULL, NULL, FALSE FROM supplier)
"""


def _rows(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    props = lambda *c: F.to_json(F.struct(*c))
    c = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "buyer").otherwise("CLIENT").alias("entity_type"), props(F.when(F.col("c_acctbal") < 5000, F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("name")).alias("properties"))
    p = t("part").select((F.col("p_partkey") + 1_000_000_000).alias("id"), F.lit("item").alias("entity_type"), props(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.when(F.col("p_size") > 25, "yes").alias("note")).alias("properties"))
    s = t("supplier").select((F.col("s_suppkey") + 2_000_000_000).alias("id"), F.lit("Supplier").alias("entity_type"), F.lit("{}").alias("properties"))
    return c.unionByName(p).unionByName(s)


@query(
    f"WITH {_ROWS_SQL} SELECT id, CASE WHEN lower(entity_type) IN ('client', 'buyer') THEN 'Customer' WHEN entity_type = 'item' THEN 'Part' END AS canonical, "
    "CASE WHEN entity_type = 'Supplier' THEN 'unknown entity type: Supplier' WHEN entity_type = 'item' THEN concat_ws('; ', CASE WHEN NOT regexp_matches(brand, '^Brand#[0-9]$') THEN 'property brand does not match pattern ^Brand#[0-9]$' END, CASE WHEN NOT note THEN 'missing required property note on Part' END) "
    "ELSE concat_ws('; ', CASE WHEN segment IS NULL THEN 'missing required property segment on Customer' WHEN segment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'property segment value not in allowed set: [BUILDING, MACHINERY, HOUSEHOLD]' END, CASE WHEN NOT regexp_matches(name, '[02468]$') THEN 'property name does not match pattern [02468]$' END) END AS errors FROM r"
)
def ontology_validate(spark, sf_dir):
    v = ont.validate_entities(_rows(spark, sf_dir), TRADE)
    return v.select("id", "canonical", F.array_join("errors", "; ").alias("errors"))


@query(
    "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'bought' AS t, 'customer' AS s, CASE WHEN l_tax > 0.04 THEN 'Item' ELSE 'PART' END AS o, l_quantity AS q, l_returnflag AS f FROM lineitem UNION ALL SELECT s_suppkey + 5000000000, 'LOCATED_IN', 'Vendor', 'Nation', NULL, NULL FROM supplier UNION ALL SELECT o_orderkey + 6000000000, 'PLACED', 'Customer', 'Order', NULL, NULL FROM orders) "
    "SELECT id, CASE t WHEN 'PLACED' THEN 'unknown relation type: PLACED' WHEN 'LOCATED_IN' THEN 'relation LOCATED_IN rejects source type Vendor' ELSE concat_ws('; ', CASE WHEN o = 'Item' THEN 'relation bought rejects target type Item' END, CASE WHEN q >= 40 THEN 'missing required property quantity on BOUGHT' END, CASE WHEN f NOT IN ('A', 'N') THEN 'property flag value not in allowed set: [A, N]' END) END AS errors FROM r"
)
def ontology_relations(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    b = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("bought").alias("relation_type"), F.lit("customer").alias("source_type"), F.when(F.col("l_tax") > 0.04, "Item").otherwise("PART").alias("target_type"), F.to_json(F.struct(F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("quantity"), F.col("l_returnflag").alias("flag"))).alias("properties"))
    s = t("supplier").select((F.col("s_suppkey") + 5_000_000_000).alias("id"), F.lit("LOCATED_IN").alias("relation_type"), F.lit("Vendor").alias("source_type"), F.lit("Nation").alias("target_type"), F.lit("{}").alias("properties"))
    o = t("orders").select((F.col("o_orderkey") + 6_000_000_000).alias("id"), F.lit("PLACED").alias("relation_type"), F.lit("Customer").alias("source_type"), F.lit("Order").alias("target_type"), F.lit(None).cast("string").alias("properties"))
    return ont.validate_relations(b.unionByName(s).unionByName(o), TRADE).select("id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT * FROM (VALUES ('Region', 'Entity type: Region'), ('Nation', 'Entity type: Nation' || chr(10) || 'Description: A country.' || chr(10) || 'Aliases: Country'), ('Customer', 'Entity type: Customer' || chr(10) || 'Description: Who buys.' || chr(10) || 'Aliases: Client, Buyer' || chr(10) || 'Properties: segment (string, required), name (string)'), ('Part', 'Entity type: Part' || chr(10) || 'Aliases: Item, Product' || chr(10) || 'Extraction patterns: [0-9]+ mm (length); SKU' || chr(10) || 'Properties: size (number), brand (string, required), note (string, required)'), ('LOCATED_IN', 'Relation type: LOCATED_IN' || chr(10) || 'Description: Where it is.' || chr(10) || 'Allowed source types: Customer, Supplier' || chr(10) || 'Allowed target types: Nation'), ('BOUGHT', 'Relation type: BOUGHT' || chr(10) || 'Allowed source types: Customer' || chr(10) || 'Allowed target types: Part' || chr(10) || 'Properties: quantity (number, required), flag (string)')) v(name, prompt)")
def ontology_prompts(spark, sf_dir):
    return ont.entity_prompts(spark, TRADE).unionByName(ont.relation_prompts(spark, TRADE)).select("name", "prompt")


@query("SELECT n_nationkey::INTEGER AS pos, CASE WHEN n_nationkey < 8 THEN 'Nation' WHEN n_nationkey < 16 THEN 'Customer' END AS name FROM nation WHERE n_nationkey < 16")
def ontology_scope(spark, sf_dir):
    kind = F.when(F.col("n_nationkey") < 8, "COUNTRY").when(F.col("n_nationkey") < 16, "buyer").otherwise("Planet")
    return ont.scoped_types(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), kind.alias("type")), TRADE)


@query("SELECT * FROM (VALUES ('trade', '1', false), ('trade', '2', true), ('other', '1', true)) v(name, version, active)")
def ontology_registry(spark, sf_dir):
    r = ont.Registry()
    for o in (ont.Ontology("trade", "1"), TRADE, ont.Ontology("other", "1")):
        r.register(o)
    return r.table(spark).select("name", "version", "active")


@query("SELECT n_nationkey AS id, n_nationkey < 10 AS equivalent FROM nation WHERE n_nationkey NOT BETWEEN 15 AND 19")
def ontology_alignment(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = load(spark, sf_dir, "nation").select(k.alias("id"), F.when(k < 5, "exactMatch").when(k < 10, "closeMatch").otherwise("broadMatch").alias("skos"), F.when(k.between(15, 19), "rejected").when(k < 3, "accepted").alias("status"))
    return ont.usable_alignments(rows).select("id", "equivalent")


@query("SELECT 'union' AS strategy, unnest(['Region', 'Nation', 'Customer', 'Part', 'Ship']) AS name UNION ALL SELECT 'intersection', unnest(['Region', 'Part'])")
def ontology_materialize(spark, sf_dir):
    other = ont.Ontology("sea", "1", (ont.EntityType("Part"), ont.EntityType("Ship"), ont.EntityType("Region"))).entity_types(spark)
    own = TRADE.entity_types(spark)
    both = [ont.materialize(own, other, s).select(F.lit(s).alias("strategy"), "name") for s in ("union", "intersection")]
    return both[0].unionByName(both[1])
