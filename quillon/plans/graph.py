"""Queries over the graph of regions, nations, suppliers, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import graph as g
from quillon.operators import graph_store as gs
from quillon.operators import traverse as tv
from quillon.plans.registry import query
from quillon.sources.tables import ENTITIES_SQL, RELATIONS_SQL, entities, load, relations

GRAPH = f"{ENTITIES_SQL}, {RELATIONS_SQL}"
LIVE = "assertion_state = 'active' AND (valid_from IS NULL OR {t} >= valid_from) AND (valid_to IS NULL OR {t} < valid_to)"
NOW = LIVE.format(t="now()::TIMESTAMP")
AT = "TIMESTAMP '1996-06-30 00:00:00'"
def moment():
    return F.lit("1996-06-30 00:00:00").cast("timestamp")
CAUSAL = "relation_type IN ('" + "','".join(g.CAUSAL_TYPES) + "')"


def _path(column: str):
    return F.array_join(F.col(column).cast("array<string>"), "-")


@query(f"WITH {GRAPH} SELECT id, name FROM ent WHERE entity_type = 'Supplier' AND contains(lower(name), '00000004') AND (conf_overall IS NULL OR conf_overall >= 0.3) ORDER BY name, id LIMIT 20")
def entity_search(spark, sf_dir):
    return gs.search_entities(entities(spark, sf_dir), "00000004", "Supplier", 0.3).select("id", "name")


@query(f"WITH {GRAPH} SELECT id, from_id, to_id FROM rel WHERE relation_type = 'LOCATED_IN' AND to_id = 107 AND conf_overall >= 0.5 AND {NOW}")
def relation_search(spark, sf_dir):
    return gs.find_relations(relations(spark, sf_dir), to_id=107, relation_type="LOCATED_IN", min_confidence=0.5).select("id", "from_id", "to_id")


@query(f"WITH {GRAPH} SELECT relation_type, count(*) AS n, count(*) FILTER ({CAUSAL}) AS causal, count(*) FILTER (coalesce(causal_strength, 1) >= 0.5) AS strong, min(CASE WHEN relation_type IN ('CAUSES', 'ENABLES') THEN 'mechanistic' WHEN relation_type IN ('TRIGGERS', 'REQUIRES') THEN 'dependency' END) AS family FROM rel GROUP BY 1")
def causal_families(spark, sf_dir):
    r = relations(spark, sf_dir)
    return r.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(g.is_causal()).alias("causal"), F.count_if(g.strength_passes(0.5)).alias("strong"), F.min(g.causal_family()).alias("family"))


@query(f"WITH {GRAPH} SELECT id, entity_type FROM ent WHERE {LIVE.format(t=AT)}")
def entities_as_of(spark, sf_dir):
    return gs.as_of(entities(spark, sf_dir), moment()).select("id", "entity_type")


@query(f"WITH {GRAPH} SELECT id, from_id, to_id FROM rel WHERE {LIVE.format(t=AT)}")
def relations_as_of(spark, sf_dir):
    return gs.as_of(relations(spark, sf_dir), moment()).select("id", "from_id", "to_id")


@query(f"WITH {GRAPH} SELECT relation_type, count(*) AS n FROM rel WHERE (valid_from IS NULL OR {AT} >= valid_from) AND (valid_to IS NULL OR {AT} < valid_to) GROUP BY 1")
def relations_bitemporal(spark, sf_dir):
    return gs.as_of(relations(spark, sf_dir), moment(), "bitemporal").groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders) SELECT event_id, o_orderkey FROM (SELECT event_id, user_id, TIMESTAMP '1996-01-01 00:00:00' + (ts - TIMESTAMP '2024-01-01 00:00:00') AS moment FROM events) e JOIN o ON o_custkey = user_id AND moment >= f AND (t IS NULL OR moment < t)")
def asof_join(spark, sf_dir):
    """Every event, moved to the time of the orders, with its user's order in force then."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))
    shift = F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00' + (ts - TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    events = load(spark, sf_dir, "events").select("event_id", "user_id", shift.alias("at"))
    return gs.as_of_join(events, orders, "user_id", "o_custkey", "at").select("event_id", F.col("r_o_orderkey").alias("o_orderkey"))


def _both(where: str) -> str:
    return f"e AS (SELECT from_id AS a, to_id AS b FROM rel WHERE {where} UNION ALL SELECT to_id, from_id FROM rel WHERE {where})"


@query(f"WITH {GRAPH}, {_both(NOW)}, s AS (SELECT id AS query_id, id FROM ent WHERE entity_type = 'Region'), l1 AS (SELECT DISTINCT query_id, b AS id FROM s JOIN e ON id = a WHERE b <> query_id), l2 AS (SELECT DISTINCT query_id, b AS id FROM l1 JOIN e ON id = a WHERE b <> query_id AND (query_id, b) NOT IN (SELECT (query_id, id) FROM l1)) SELECT query_id, id, 1 AS level FROM l1 WHERE id IN (SELECT id FROM ent) UNION ALL SELECT query_id, id, 2 FROM l2 WHERE id IN (SELECT id FROM ent)")
def neighbors_d2(spark, sf_dir):
    e = entities(spark, sf_dir)
    return tv.neighbors(e, relations(spark, sf_dir), e.where("entity_type = 'Region'").select(F.col("id").alias("query_id"), "id"), 2)


@query(f"WITH {GRAPH} SELECT DISTINCT from_id AS query_id, to_id AS id, 1 AS level FROM rel WHERE {NOW} AND from_id <> to_id AND from_id IN (SELECT id FROM ent WHERE entity_type = 'Customer') AND to_id IN (SELECT id FROM ent)")
def neighbors_out(spark, sf_dir):
    e = entities(spark, sf_dir)
    return tv.neighbors(e, relations(spark, sf_dir), e.where("entity_type = 'Customer'").select(F.col("id").alias("query_id"), "id"), 1, "out")


@query(f"WITH RECURSIVE {GRAPH}, live AS (SELECT id FROM ent WHERE {NOW}), e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM rel WHERE {NOW} AND from_id IN (SELECT id FROM live) AND to_id IN (SELECT id FROM live)), p AS (SELECT id AS s, id AS node, [id] AS path FROM live WHERE id BETWEEN 2000000000 AND 2999999999 UNION ALL SELECT s, b, list_append(path, b) FROM p JOIN e ON node = a WHERE len(path) < 4 AND b < 1000) SELECT s AS from_id, node AS to_id, array_to_string(path, '-') AS path FROM p WHERE node < 100")
def shortest_path(spark, sf_dir):
    """From every customer to every region."""
    e = entities(spark, sf_dir)
    ids = lambda kind, name: e.where(F.col("entity_type") == kind).select(F.col("id").alias(name))
    pairs = ids("Customer", "from_id").crossJoin(F.broadcast(ids("Region", "to_id")))  # regions: a fixed handful
    return tv.shortest_paths(e, relations(spark, sf_dir), pairs).select("from_id", "to_id", _path("path").alias("path"))


@query(f"WITH {GRAPH}, {_both(NOW)}, em AS MATERIALIZED (SELECT DISTINCT a, b FROM e), s AS MATERIALIZED (SELECT id FROM ent WHERE entity_type = 'Region'), n1 AS MATERIALIZED (SELECT id FROM s UNION SELECT b FROM s JOIN em ON id = a), n AS MATERIALIZED (SELECT id FROM n1 UNION SELECT b FROM n1 JOIN em ON id = a) SELECT 'entity' AS kind, id FROM n JOIN (SELECT DISTINCT id FROM ent) USING (id) UNION ALL SELECT 'relation', r.id FROM (SELECT id, from_id, to_id FROM rel WHERE {NOW}) r JOIN n x ON r.from_id = x.id JOIN n y ON r.to_id = y.id")
def subgraph(spark, sf_dir):
    e = entities(spark, sf_dir)
    seeds = e.where("entity_type = 'Region'").select(F.lit(0).alias("query_id"), "id")
    nodes, edges = tv.subgraph(e, relations(spark, sf_dir), seeds, 2)
    return nodes.select(F.lit("entity").alias("kind"), "id").unionByName(edges.select(F.lit("relation").alias("kind"), "id"))


def _chain(nodes: str = "confs") -> str:
    unit = "greatest(0::DOUBLE, least(1::DOUBLE, {}))"
    product = "list_product(list_transform(range(1, len(hops) + 1), lambda i: " + unit.format("hops[i]") + " * pow(0.9::DOUBLE, i - 1)))"
    return f"round(exp(list_avg(list_transform(strengths, lambda x: ln(greatest(x, 1e-9::DOUBLE))))), 6) AS chain_strength, round(least({product}, {unit.format('list_min(hops)')}, {unit.format(f'list_min({nodes})')}), 6) AS chain_confidence, (list_position(hops, list_min(hops)) - 1)::BIGINT AS ceiling_hop, len(links)::INTEGER AS hop_count"


_CE = f"ce AS (SELECT id AS edge, from_id, to_id, coalesce(causal_strength, 1) AS strength, coalesce(conf_overall, 1) AS hop FROM rel WHERE {CAUSAL} AND coalesce(causal_strength, 1) >= {{least}}), ec AS (SELECT id, coalesce(conf_overall, 1::DOUBLE) AS c FROM ent)"
_DOWN = "w AS (SELECT id AS query_id, [id] AS nodes, []::BIGINT[] AS links, []::DOUBLE[] AS strengths, []::DOUBLE[] AS hops, [c] AS confs FROM ec {seed} UNION ALL SELECT query_id, list_append(nodes, to_id), list_append(links, edge), list_append(strengths, strength), list_append(hops, hop), list_append(confs, c) FROM w JOIN ce ON nodes[-1] = from_id AND NOT list_contains(nodes, to_id) JOIN ec ON ec.id = to_id WHERE len(links) < {depth})"
_UP = "w AS (SELECT id AS query_id, [id] AS nodes, []::BIGINT[] AS links, []::DOUBLE[] AS strengths, []::DOUBLE[] AS hops, [c] AS confs FROM ec {seed} UNION ALL SELECT query_id, list_prepend(from_id, nodes), list_prepend(edge, links), list_prepend(strength, strengths), list_prepend(hop, hops), list_prepend(c, confs) FROM w JOIN ce ON nodes[1] = to_id AND NOT list_contains(nodes, from_id) JOIN ec ON ec.id = from_id WHERE len(links) < {depth})"
_PARTS = "WHERE id >= 3000000000"


@query(f"WITH RECURSIVE {GRAPH}, {_CE.format(least='0.1')}, {_DOWN.format(seed=_PARTS, depth=3)}, m AS (SELECT * FROM w WHERE len(links) > 0 AND (len(links) = 3 OR NOT EXISTS (SELECT 1 FROM ce WHERE from_id = nodes[-1] AND NOT list_contains(nodes, to_id)))) SELECT query_id, array_to_string(nodes, '-') AS nodes, {_chain()} FROM m")
def causal_descendants(spark, sf_dir):
    """Of every part, three hops deep."""
    e = entities(spark, sf_dir)
    r = tv.causal_descendants(e, relations(spark, sf_dir), e.where("entity_type = 'Part'").select(F.col("id").alias("query_id"), "id"), max_depth=3, min_strength=0.1)
    return _shown(r)


def _shown(r: DataFrame) -> DataFrame:
    return r.select("query_id", _path("nodes").alias("nodes"), F.round("chain_strength", 6).alias("chain_strength"), F.round("chain_confidence", 6).alias("chain_confidence"), F.col("ceiling_hop").cast("long").alias("ceiling_hop"), "hop_count")


@query(f"WITH RECURSIVE {GRAPH}, {_CE.format(least='0.1')}, {_UP.format(seed=_PARTS, depth=5)}, m AS (SELECT query_id, nodes[1:len(nodes) - 1] AS nodes, links, strengths, hops, confs[1:len(confs) - 1] AS confs FROM w WHERE len(links) > 0 AND (len(links) = 5 OR NOT EXISTS (SELECT 1 FROM ce WHERE to_id = nodes[1] AND NOT list_contains(nodes, from_id)))) SELECT query_id, array_to_string(nodes, '-') AS nodes, {_chain()} FROM m")
def causal_ancestors(spark, sf_dir):
    e = entities(spark, sf_dir)
    r = tv.causal_ancestors(e, relations(spark, sf_dir), e.where("entity_type = 'Part'").select(F.col("id").alias("query_id"), "id"), min_strength=0.1)
    return _shown(r)


@query(f"WITH RECURSIVE {GRAPH}, {_CE.format(least='0')}, {_DOWN.format(seed=_PARTS, depth=5)} SELECT p_partkey AS query_id, array_to_string(nodes, '-') AS nodes, {_chain()} FROM w JOIN part ON nodes[-1] = p_partkey + 3000000000 AND w.query_id = p_partkey // 4 + 3000000000 WHERE p_partkey >= 4")
def causal_paths(spark, sf_dir):
    """To every part from the one two steps above it."""
    key = F.col("p_partkey")
    pairs = load(spark, sf_dir, "part").where(key >= 4).select(key.alias("query_id"), (F.floor(key / 4) + 3_000_000_000).alias("from_id"), (key + 3_000_000_000).alias("to_id"))
    return _shown(tv.causal_paths(entities(spark, sf_dir), relations(spark, sf_dir), pairs))


@query("SELECT l_orderkey, n::INTEGER AS hops, round(round(least(prod, lo), 10), 6) AS chain_confidence, round(exp(ls / n), 6) AS chain_strength, round(pow(greatest(0::DOUBLE, least(1::DOUBLE, mean)), n) * pow(0.9::DOUBLE, n * (n - 1) / 2), 6) AS approximate FROM (SELECT l_orderkey, count(*) AS n, product((1 - l_discount) * pow(0.9::DOUBLE, r - 1)) AS prod, min(1 - l_discount) AS lo, sum(ln(greatest(1e-9::DOUBLE, 1 - l_tax))) AS ls, avg(1 - l_discount) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) GROUP BY 1)")
def chain_confidence(spark, sf_dir):
    """Every order's lines as a chain."""
    c = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (1 - F.col("l_discount")).alias("h"), (1 - F.col("l_tax")).alias("s")))).alias("c"))
    c = c.select("l_orderkey", F.transform("c", lambda x: x["h"]).alias("h"), F.transform("c", lambda x: x["s"]).alias("s"))
    mean = F.aggregate("h", F.lit(0.0), lambda a, x: a + x) / F.size("h")
    return c.select("l_orderkey", F.size("h").alias("hops"), F.round(F.round(g.chain_confidence("h", "h"), 10), 6).alias("chain_confidence"), F.round(g.chain_strength("s"), 6).alias("chain_strength"), F.round(g.approximate_chain_confidence(mean, F.size("h")), 6).alias("approximate"))


@query(f"WITH RECURSIVE {GRAPH}, p AS (SELECT id FROM ent WHERE entity_type = 'Part'), e AS (SELECT from_id, to_id FROM rel WHERE {CAUSAL} AND {NOW}), c AS (SELECT id, id AS component FROM p WHERE id NOT IN (SELECT to_id FROM e) UNION ALL SELECT to_id, component FROM c JOIN e ON from_id = c.id) SELECT id, component FROM c")
def components(spark, sf_dir):
    """Of the parts, by causal relations in force."""
    e = relations(spark, sf_dir).where(g.is_causal() & g.is_active()).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return tv.connected_components(entities(spark, sf_dir).where("entity_type = 'Part'").select("id"), e)


@query(f"WITH RECURSIVE {GRAPH}, live AS (SELECT id FROM ent WHERE {NOW}), r AS (SELECT from_id, to_id FROM rel WHERE {NOW} AND NOT starts_with(relation_type, '__')), e AS (SELECT from_id AS a, to_id AS b FROM r UNION SELECT to_id, from_id FROM r), node AS (SELECT id FROM live UNION SELECT a FROM e), cc(id, c) USING KEY (id) AS (SELECT id, id FROM node UNION SELECT e.a, min(n.c) FROM cc AS n JOIN e ON e.b = n.id JOIN recurring.cc AS o ON o.id = e.a WHERE n.c < o.c GROUP BY e.a), m AS (SELECT cc.id, c FROM cc JOIN live USING (id)), i AS (SELECT m.c, from_id, to_id FROM r JOIN m ON from_id = m.id WHERE to_id IN (SELECT id FROM live)), d AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM i UNION ALL SELECT to_id FROM i) GROUP BY 1), k AS (SELECT m.id, c, coalesce(degree, 0) AS degree FROM m LEFT JOIN d USING (id)), s AS (SELECT c, count(*) AS n, arg_max(id, (degree, id)) AS central_id FROM k GROUP BY 1), x AS (SELECT c, count(*) AS edges FROM i GROUP BY 1) SELECT c AS component, n, round(CASE WHEN n < 2 THEN 0 ELSE coalesce(edges, 0) / (n * (n - 1) / 2) END, 9) AS density, central_id FROM s LEFT JOIN x USING (c)")
def communities(spark, sf_dir):
    c = tv.detect_communities(entities(spark, sf_dir), relations(spark, sf_dir))
    return c.select("component", "n", F.round("density", 9).alias("density"), "central_id")


@query(f"WITH {GRAPH}, g AS (SELECT id FROM ent WHERE entity_type = 'Supplier' AND conf_overall <= 0.2) SELECT (SELECT count(*) FROM ent WHERE id NOT IN (SELECT id FROM g)) AS entities, (SELECT count(*) FROM rel WHERE from_id NOT IN (SELECT id FROM g) AND to_id NOT IN (SELECT id FROM g)) AS relations")
def delete_cascade(spark, sf_dir):
    e = entities(spark, sf_dir)
    left, rest = gs.delete_entities(e, relations(spark, sf_dir), e.where("entity_type = 'Supplier' AND conf_overall <= 0.2"))
    return left.agg(F.count(F.lit(1)).alias("entities")).crossJoin(rest.agg(F.count(F.lit(1)).alias("relations")))


@query("SELECT n_nationkey::BIGINT + 100 AS id, upper(n_name) || '!' AS name, '{\"a\":1,\"b\":[2],\"key\":' || n_nationkey || '}' AS properties FROM nation")
def entity_update(spark, sf_dir):
    e = entities(spark, sf_dir).where("entity_type = 'Nation'").withColumn("properties", F.lit('{"a":1,"key":"old"}'))
    changes = load(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("id"), F.concat(F.upper("n_name"), F.lit("!")).alias("name"), F.format_string('{"key":%d,"b":[2]}', "n_nationkey").alias("properties"))
    return gs.update(e, changes).select("id", "name", "properties")


@query(f"WITH {GRAPH} SELECT CASE WHEN relation_type = 'LOCATED_IN' THEN 'retracted' ELSE assertion_state END AS assertion_state, CASE WHEN relation_type = 'LOCATED_IN' THEN {AT} ELSE valid_to END IS NULL AS open, count(*) AS n FROM rel GROUP BY 1, 2")
def retract(spark, sf_dir):
    r = relations(spark, sf_dir)
    out = gs.retract(r, r.where("relation_type = 'LOCATED_IN'").select("id"), moment())
    return out.groupBy("assertion_state", F.col("valid_to").isNull().alias("open")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAPH} SELECT id, name, assertion_state, coalesce(superseded_by, 0) AS superseded_by, valid_from, valid_to FROM (SELECT id, name, 'superseded' AS assertion_state, id + 1000 AS superseded_by, valid_from, {AT} AS valid_to FROM ent WHERE entity_type = 'Nation' UNION ALL SELECT id + 1000, name || ' II', 'active', NULL, {AT}, NULL FROM ent WHERE entity_type = 'Nation' UNION ALL SELECT id, name, assertion_state, NULL, valid_from, NULL FROM ent WHERE entity_type = 'Region')")
def supersede(spark, sf_dir):
    e = entities(spark, sf_dir).where("entity_type IN ('Nation', 'Region')")
    changes = e.where("entity_type = 'Nation'").select("id", (F.col("id") + 1000).alias("new_id"), F.concat("name", F.lit(" II")).alias("name"))
    out = gs.supersede(e, changes, moment())
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("id", "name", "assertion_state", F.coalesce("superseded_by", F.lit(0)).alias("superseded_by"), ntz("valid_from"), ntz("valid_to"))


@query(f"WITH {GRAPH}, m AS (SELECT from_id AS f, to_id AS t, CASE WHEN from_id BETWEEN 112 AND 124 THEN from_id - 12 ELSE from_id END AS nf, CASE WHEN to_id BETWEEN 112 AND 124 THEN to_id - 12 ELSE to_id END AS nt FROM rel) SELECT count(*) FILTER (f <> nf OR t <> nt) AS repointed, count(*) FILTER (nf = nt AND nf BETWEEN 100 AND 112) AS self_loops_removed, 0::BIGINT AS duplicates_merged FROM m")
def retarget(spark, sf_dir):
    """The second half of the nations is merged into the first."""
    e = entities(spark, sf_dir).where("id BETWEEN 112 AND 124")
    _, stats = gs.retarget(relations(spark, sf_dir), e.select(F.col("id").alias("old_id"), (F.col("id") - 12).alias("new_id")))
    return stats


@query(f"WITH {GRAPH} SELECT id, 1 + (id % 2)::INTEGER AS refs FROM ent WHERE {NOW} AND entity_type = 'Supplier'")
def external_refs(spark, sf_dir):
    """Suppliers with odd ids get another reference, those with even ids one they have already."""
    e = entities(spark, sf_dir).where("entity_type = 'Supplier'")
    odd = F.pmod("id", F.lit(2)) == 1
    new = e.select("id", F.when(odd, "lei").otherwise("tpch").alias("source"), F.col("id").cast("string").alias("external_id"), F.lit(0.5).alias("confidence"))
    out = gs.add_external_ref(e, new).where(g.is_active())
    return out.select("id", F.size(gs.external_refs()).alias("refs"))


@query(f"WITH {GRAPH} SELECT id, name FROM ent WHERE id = 1000000005 AND {NOW}")
def external_ref_lookup(spark, sf_dir):
    return gs.find_by_external_ref(entities(spark, sf_dir), "tpch", "1000000005").select("id", "name")


@query(f"WITH {GRAPH}, log AS (SELECT 'create' AS operation, 'relation' AS record_type, id, valid_from AS moment FROM rel UNION ALL SELECT assertion_state, 'relation', id, valid_to FROM rel WHERE assertion_state <> 'active') SELECT operation, count(*) AS n, min(moment) AS first, max(moment) AS last FROM log WHERE moment >= TIMESTAMP '1995-01-01 00:00:00' AND moment <= TIMESTAMP '1996-12-31 00:00:00' GROUP BY 1")
def changelog(spark, sf_dir):
    t = lambda s: F.lit(s).cast("timestamp")
    log = gs.changelog_of(entities(spark, sf_dir), relations(spark, sf_dir))
    c = gs.changelog(log, t("1995-01-01"), t("1996-12-31"), "relation")
    return c.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.min("at").cast("timestamp_ntz").alias("first"), F.max("at").cast("timestamp_ntz").alias("last"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, round(greatest(0::DOUBLE, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 10) AS similarity FROM q, embeddings v WHERE list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 5) AS similarity, rank FROM r WHERE rank <= 10")
def relation_embeddings(spark, sf_dir):
    """Relations that carry the vectors as a property, asked by the vectors whose ids are divisible by 100."""
    v = load(spark, sf_dir, "embeddings")
    rel = v.select(F.lit("default").alias("ns"), F.col("vec_id").alias("id"), F.lit("{}").alias("properties"))
    rel = gs.upsert_relation_embedding(rel, v.select(F.col("vec_id").alias("id"), "embedding"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit("default").alias("ns"), "embedding")
    r = gs.relations_by_embedding(rel, q, 10, 0.2)
    return r.select("query_id", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings), s AS (SELECT query_id, vec_id AS id, round(greatest(0::DOUBLE, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 10) AS similarity FROM q, embeddings v WHERE list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 5) AS similarity, rank FROM r WHERE rank <= 10")
def relation_embeddings_all(spark, sf_dir):
    """relation_embeddings with every vector as a query."""
    v = load(spark, sf_dir, "embeddings")
    rel = v.select(F.lit("default").alias("ns"), F.col("vec_id").alias("id"), F.lit("{}").alias("properties"))
    rel = gs.upsert_relation_embedding(rel, v.select(F.col("vec_id").alias("id"), "embedding"))
    r = gs.relations_by_embedding(rel, v.select(F.col("vec_id").alias("query_id"), F.lit("default").alias("ns"), "embedding"), 10, 0.2)
    return r.select("query_id", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))
