"""Search in a graph: seeds by name, their surroundings and causes (local); summaries of communities (global); both together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import traverse
from quillon.operators.ontology import Ontology, resolve_aliases
from quillon.sources.workspace import write_table

CAUSAL_WORDS = "cause caused causes why because lead leads result resulted effect affect affects trigger triggers prevent prevents enable enables require requires".split()
ANCESTOR_WORDS = [*"why because cause caused root".split(), "what led"]
ENTITY_TYPES = "Person Organization Location Event Concept Product Technology Document".split()
RELATION_TYPES = "WORKS_FOR LOCATED_IN CREATED RELATED_TO PART_OF INFLUENCED PRECEDED FOLLOWED COLLABORATED_WITH MENTIONED_IN".split()


@dataclass(frozen=True)
class GraphSearchConfig:
    depth: int = 2
    causal: bool = True
    causal_depth: int = 5
    max_summaries: int = 10


def has_causal_intent(query: Column | str) -> Column:
    """Does the lower-cased query hold any of the words, inside others too?"""
    return F.lower(F.col(query) if isinstance(query, str) else query).rlike("|".join(CAUSAL_WORDS))


def wants_ancestors(query: Column | str) -> Column:
    return F.lower(F.col(query) if isinstance(query, str) else query).rlike("|".join(ANCESTOR_WORDS))


def resolve_seeds(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_id, query) to (query_id, id): one entity whose name is the query; else that holds it; else that holds the first of its words of at least three bytes that any name holds.

    Of several the first by name, then id. All queries' names and words are matched in one pass over the entities.
    """
    words = F.filter(F.split("query", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.octet_length(w) >= 3)
    ask = queries.select("query_id", F.posexplode(F.concat(F.array("query", "query"), words)).alias("step", "needle"))
    e = entities.select("id", "name")
    named = ask.where("step = 0").join(e.hint("merge"), F.col("needle") == F.col("name")).select("query_id", "step", "id", "name")
    held = ask.where("step > 0 AND needle <> ''").join(e, F.contains(F.lower("name"), F.lower("needle"))).select("query_id", "step", "id", "name")
    best = named.unionByName(held).groupBy("query_id").agg(F.min(F.struct("step", "name", "id"))["id"].alias("id"))
    return best


def confidence_metrics(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Mean and least confidence of what has one."""
    return rows.groupBy(by).agg(F.avg("conf_overall").alias("avg_confidence"), F.min("conf_overall").alias("min_confidence"))


def local_search(entities: DataFrame, relations: DataFrame, queries: DataFrame, config: GraphSearchConfig = GraphSearchConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries(query_id, query) to entities found (query_id, id, name, conf_overall, level; the seed at level 0), causal paths of queries that ask for causes, and confidence by query."""
    seeds = write_table(resolve_seeds(entities, queries), "seeds")
    near = traverse.neighbors(entities, relations, seeds, config.depth)
    found = seeds.withColumn("level", F.lit(0)).unionByName(near.select("query_id", "id", "level")).join(entities.select("id", "name", "conf_overall").hint("merge"), "id")
    asks = queries.where(has_causal_intent("query")) if config.causal else queries.where("false")
    back, forth = (seeds.join(asks.where(c).select("query_id"), "query_id", "left_semi") for c in (wants_ancestors("query"), ~wants_ancestors("query")))
    paths = traverse.causal_ancestors(entities, relations, back, config.causal_depth).withColumn("direction", F.lit("ancestors"))
    paths = paths.unionByName(traverse.causal_descendants(entities, relations, forth, config.causal_depth).withColumn("direction", F.lit("descendants")))
    return found, paths, confidence_metrics(found)


def relevance(query: Column | str, summary: Column | str) -> Column:
    """Share of the query's words that the summary holds, letters' case aside; 0 for no word."""
    q, s = (F.col(c) if isinstance(c, str) else c for c in (query, summary))
    words = F.filter(F.split(q, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    hit = F.size(F.filter(words, lambda w: F.contains(F.lower(s), F.lower(w))))
    return F.when(F.size(words) == 0, 0.0).otherwise(hit / F.size(words))


def community_key(members: Column | str) -> Column:
    return F.array_join(F.sort_array(F.col(members) if isinstance(members, str) else members).cast("array<string>"), ":")


def global_search(communities: DataFrame, summaries: DataFrame, queries: DataFrame, config: GraphSearchConfig = GraphSearchConfig()) -> DataFrame:
    """communities(members), summaries(key, summary), queries(query_id, query) to (query_id, key, summary, score, rank). Communities without a summary are passed over; a score of 0 is a result too."""
    have = communities.select(community_key("members").alias("key")).join(summaries, "key")
    scored = queries.crossJoin(have).select("query_id", "key", "summary", relevance("query", "summary").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= config.max_summaries)


def hybrid_contexts(found: DataFrame, summaries: DataFrame) -> DataFrame:
    """Contexts of a local search, then those of a global one: (query_id, kind, key, text, score)."""
    local = found.where("level > 0").select("query_id", F.lit("entity").alias("kind"), F.col("id").cast("string").alias("key"), F.col("name").alias("text"), F.col("conf_overall").alias("score"))
    return local.unionByName(summaries.select("query_id", F.lit("community").alias("kind"), "key", F.col("summary").alias("text"), "score"))


def information_gain(entities: Column, relations: Column, confidence_delta: Column, contradictions: Column, expansion: float = 0.7, confidence: float = 0.3, contradiction: float = 0.0) -> Column:
    raw = expansion * F.log1p((entities + relations).cast("double")) + confidence * F.greatest(confidence_delta, F.lit(0.0)) + contradiction * F.when(contradictions > 0, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def effective_types(spark: SparkSession, ontology: Ontology | None, kind: str = "entity") -> DataFrame:
    """(pos, name): the ontology's types, the defaults without one."""
    if ontology is not None:
        return (ontology.entity_types(spark) if kind == "entity" else ontology.relation_types(spark)).select("pos", "name")
    return spark.createDataFrame(list(enumerate(ENTITY_TYPES if kind == "entity" else RELATION_TYPES)), "pos int, name string")


def normalize_types(rows: DataFrame, column: str, ontology: Ontology | None) -> DataFrame:
    """rows with `canonical` and `known`; null and false without an ontology."""
    if ontology is None:
        return rows.withColumn("canonical", F.lit(None).cast("string")).withColumn("known", F.lit(False))
    return resolve_aliases(rows, column, ontology).withColumn("known", F.col("canonical").isNotNull())
