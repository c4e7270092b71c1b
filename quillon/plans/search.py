"""Queries that search the graph by words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import graph_search as gsx
from quillon.plans.registry import query
from quillon.plans.schema import TRADE
from quillon.sources.tables import ENTITIES_SQL, RELATIONS_SQL, entities, load, relations

_ASK = "asks AS (SELECT n_nationkey::BIGINT AS query_id, CASE WHEN n_nationkey < 8 THEN n_name WHEN n_nationkey < 16 THEN 'why is ' || lower(n_name) || ' big' ELSE lower(n_name) END AS query FROM nation)"


def _asks(spark, sf_dir) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    return load(spark, sf_dir, "nation").select(k.cast("long").alias("query_id"), F.when(k < 8, name).when(k < 16, F.concat(F.lit("why is "), F.lower(name), F.lit(" big"))).otherwise(F.lower(name)).alias("query"))


_WORDS = "'" + "|".join(gsx.CAUSAL_WORDS) + "'"


@query(f"SELECT conv_id, turn, regexp_matches(lower(text), {_WORDS}) AS causal, regexp_matches(lower(text), '{'|'.join(gsx.ANCESTOR_WORDS)}') AS ancestors FROM conversations")
def causal_intent(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", gsx.has_causal_intent("text").alias("causal"), gsx.wants_ancestors("text").alias("ancestors"))


_SEEDS = f"""
{ENTITIES_SQL}, {_ASK},
w AS (SELECT query_id, unnest(list_prepend(query, regexp_split_to_array(query, ' '))) AS needle, unnest(range(1, len(regexp_split_to_array(query, ' ')) + 2)) AS step FROM asks),
hits AS (SELECT query_id, 0 AS step, name, id FROM asks JOIN ent ON name = query UNION ALL SELECT query_id, step, name, id FROM w JOIN ent ON contains(lower(name), lower(needle)) WHERE step = 1 OR strlen(needle) >= 3),
seeds AS (SELECT query_id, id FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step, name, id) = 1)
"""


@query(f"WITH {_SEEDS} SELECT * FROM seeds")
def seed_resolution(spark, sf_dir):
    return gsx.resolve_seeds(entities(spark, sf_dir), _asks(spark, sf_dir))


_LIVE = "assertion_state = 'active' AND (valid_from IS NULL OR now()::TIMESTAMP >= valid_from) AND (valid_to IS NULL OR now()::TIMESTAMP < valid_to)"


@query(
    f"WITH {_SEEDS}, {RELATIONS_SQL}, e AS (SELECT from_id AS a, to_id AS b FROM rel WHERE {_LIVE} UNION SELECT to_id, from_id FROM rel WHERE {_LIVE}), l1 AS (SELECT DISTINCT query_id, b AS id FROM seeds JOIN e ON id = a), l2 AS (SELECT DISTINCT query_id, b AS id FROM l1 JOIN e ON id = a), "
    "f AS (SELECT query_id, id FROM seeds UNION SELECT * FROM l1 UNION SELECT * FROM l2) SELECT query_id, count(*) AS n, round(avg(conf_overall), 6) AS avg_confidence, min(conf_overall) AS min_confidence FROM f JOIN ent USING (id) GROUP BY 1"
)
def local_search(spark, sf_dir):
    found, _, metrics = gsx.local_search(entities(spark, sf_dir), relations(spark, sf_dir), _asks(spark, sf_dir))
    n = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(metrics, "query_id").select("query_id", "n", F.round("avg_confidence", 6).alias("avg_confidence"), "min_confidence")


_COMMUNITIES = "k AS (SELECT array_to_string(list_sort(list(c_custkey)), ':') AS key, any_value('Customers of ' || n_name || ' in ' || c_mktsegment) AS summary FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, c_mktsegment)"


def _summaries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy("n_name", "c_mktsegment").agg(F.collect_list("c_custkey").alias("members"))
    return g.select("members"), g.select(gsx.community_key("members").alias("key"), F.concat(F.lit("Customers of "), "n_name", F.lit(" in "), "c_mktsegment").alias("summary"))


@query(f"WITH {_ASK}, {_COMMUNITIES}, s AS (SELECT query_id, summary, key, len(list_filter(regexp_split_to_array(query, ' '), lambda w: contains(lower(summary), lower(w))))::DOUBLE / len(regexp_split_to_array(query, ' ')) AS score FROM asks, k) SELECT query_id, summary, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= 10")
def global_search(spark, sf_dir):
    r = gsx.global_search(*_summaries(spark, sf_dir), _asks(spark, sf_dir))
    return r.select("query_id", "summary", F.round("score", 6).alias("score"))


@query("SELECT event_id, round(least(1::DOUBLE, greatest(0::DOUBLE, 0.7::DOUBLE * ln(1 + (event_type = 'click')::INTEGER) + 0.3::DOUBLE * greatest(value / 50 - 0.5::DOUBLE, 0::DOUBLE))), 6) AS gain FROM events")
def ingest_gain(spark, sf_dir):
    gain = gsx.information_gain((F.col("event_type") == "click").cast("int"), F.lit(0), F.col("value") / 50 - 0.5, F.lit(0))
    return load(spark, sf_dir, "events").select("event_id", F.round(gain, 6).alias("gain"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Customer' WHEN 'view' THEN 'Nation' END AS canonical, event_type IN ('click', 'view') AS known FROM events")
def normalized_types(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "BUYER").when(F.col("event_type") == "view", "nation").otherwise("Planet")
    rows = load(spark, sf_dir, "events").select("event_id", kind.alias("kind"))
    return gsx.normalize_types(rows, "kind", TRADE).select("event_id", "canonical", "known")
