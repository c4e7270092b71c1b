"""The graph as two tables, entities and relations, and its changes as functions from tables to tables.

entities(ns, id, name, entity_type, properties, valid_from, valid_to, assertion_state, conf_overall[, system_from,
system_to, superseded_by]); relations likewise with from_id, to_id, relation_type, causal_strength. Changes touch the
rows that a table of keys or of new values names, by joins; what they return is the table after the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import graph as g
from quillon.operators.vectors import nearest_neighbors
from quillon.sources.errors import ConfigurationError

REF = "array<struct<source:string,external_id:string,confidence:double>>"


def create(table: DataFrame, new: DataFrame, first_id: int | None = None) -> DataFrame:
    """table with new's rows (all columns but id), which get the ids that follow the highest, in the order of their columns."""
    start = F.lit(first_id) if first_id is not None else None
    order = [c for c in new.columns if c != "id"]
    numbered = new.drop("id").withColumn("n", F.row_number().over(Window.orderBy(*order)))  # over the rows of one change, not the table
    if start is None:
        numbered = numbered.crossJoin(table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))
        numbered = numbered.withColumn("id", F.col("top") + F.col("n")).drop("top", "n")
    else:
        numbered = numbered.withColumn("id", start + F.col("n") - 1).drop("n")
    return table.unionByName(numbered, allowMissingColumns=True)


def merge_properties(old: Column, new: Column) -> Column:
    """JSON objects, key by key; new wins."""
    as_map = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>")
    a, b = as_map(old), as_map(new)
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))))


def update(table: DataFrame, changes: DataFrame, merge: bool = True) -> DataFrame:
    """changes(id, columns to set): nulls leave a column as it is; properties are merged."""
    named = [c for c in changes.columns if c != "id"]
    c = changes.select("id", F.lit(True).alias("_hit"), *[F.col(x).alias(f"_new_{x}") for x in named])
    j = table.join(c, "id", "left")
    value = lambda x: F.when(F.col(f"_new_{x}").isNotNull(), merge_properties(F.col(x), F.col(f"_new_{x}"))).otherwise(F.col(x)) if x == "properties" and merge else F.coalesce(f"_new_{x}", x)
    return j.select(*[(value(x) if x in named else F.col(x)).alias(x) for x in table.columns])


def delete_entities(entities: DataFrame, relations: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the entities that keys(id) names and all relations that touch them."""
    k = keys.select("id").distinct()
    left = relations.join(k.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(k.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return entities.join(k, "id", "left_anti"), left


def delete_relations(relations: DataFrame, keys: DataFrame) -> DataFrame:
    return relations.join(keys.select("id").distinct(), "id", "left_anti")


def _with(table: DataFrame, **kinds: str) -> DataFrame:
    for name, kind in kinds.items():
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast(kind))
    return table


def retract(table: DataFrame, keys: DataFrame, now: Column | None = None) -> DataFrame:
    """keys(id[, valid_to]): retracted, valid until valid_to or now, known until now."""
    now = F.current_timestamp() if now is None else now
    table = _with(table, system_to="timestamp")
    k = keys.select("id", F.lit(True).alias("_hit"), (F.col("valid_to") if "valid_to" in keys.columns else F.lit(None).cast("timestamp")).alias("_until"))
    j = table.join(k, "id", "left")
    new = {"assertion_state": F.lit("retracted"), "valid_to": F.coalesce("_until", now), "system_to": now}
    return j.select(*[(F.when(F.col("_hit"), new[x]).otherwise(F.col(x)) if x in new else F.col(x)).alias(x) for x in table.columns])


def supersede(table: DataFrame, changes: DataFrame, now: Column | None = None, keep_properties: bool = False) -> DataFrame:
    """changes(id, new_id, attributes): the old rows end now and point to new ones, which copy what a null doesn't override and have no confidence yet.

    Given properties replace the old ones of an entity; with keep_properties (relations) the old ones stay whatever is given.
    """
    now = F.current_timestamp() if now is None else now
    table = _with(table, system_from="timestamp", system_to="timestamp", superseded_by="long")
    named = [c for c in changes.columns if c not in ("id", "new_id") and not (keep_properties and c == "properties")]
    c = changes.select("id", "new_id", *[F.col(x).alias(f"_new_{x}") for x in named])
    j = table.join(c, "id", "left")
    old = {"assertion_state": F.lit("superseded"), "valid_to": now, "system_to": now, "superseded_by": F.col("new_id")}
    ended = j.select(*[(F.when(F.col("new_id").isNotNull(), old[x]).otherwise(F.col(x)) if x in old else F.col(x)).alias(x) for x in table.columns])
    fresh = {"id": F.col("new_id"), "assertion_state": F.lit("active"), "valid_from": now, "valid_to": F.lit(None).cast("timestamp"), "system_from": now, "system_to": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("long"), "conf_overall": F.lit(None).cast("double")}
    fresh |= {x: F.coalesce(f"_new_{x}", x) for x in named if x in table.columns and x not in fresh}
    new = j.where(F.col("new_id").isNotNull()).select(*[fresh.get(x, F.col(x)).alias(x) for x in table.columns])
    return ended.unionByName(new)


def retarget(relations: DataFrame, merges: DataFrame, merge_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """merges(old_id, new_id): relations of the old entity go to the new one; loops on a new entity, older ones too, are dropped.

    Second: (repointed, self_loops_removed, duplicates_merged). Duplicates are only merged (the least id stays) if asked.
    """
    m = lambda side: merges.select(F.col("old_id").alias(f"{side}_id"), F.col("new_id").alias(f"_{side}"))
    j = relations.join(m("from"), "from_id", "left").join(m("to"), "to_id", "left")
    moved = j.withColumn("_moved", F.col("_from").isNotNull() | F.col("_to").isNotNull()).withColumn("from_id", F.coalesce("_from", "from_id")).withColumn("to_id", F.coalesce("_to", "to_id"))
    target = merges.select(F.col("new_id").alias("from_id"), F.lit(True).alias("_target")).distinct()
    marked = moved.join(target, "from_id", "left").withColumn("_loop", (F.col("from_id") == F.col("to_id")) & F.coalesce("_target", F.lit(False)))
    first = Window.partitionBy("from_id", "to_id", "relation_type", "_loop").orderBy("id")
    marked = marked.withColumn("_again", (F.row_number().over(first) > 1) & ~F.col("_loop")) if merge_duplicates else marked.withColumn("_again", F.lit(False))
    stats = marked.agg(F.count_if("_moved").alias("repointed"), F.count_if("_loop").alias("self_loops_removed"), F.count_if("_again").alias("duplicates_merged"))
    return marked.where(~F.col("_loop") & ~F.col("_again")).select(*relations.columns), stats


def external_refs(properties: Column | str = "properties") -> Column:
    return F.from_json(F.get_json_object(properties, "$.external_refs"), REF)


def add_external_ref(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """refs(id, source, external_id, confidence): appended unless the entity has that source and id already."""
    new = refs.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("source", "external_id", "confidence"))).cast(REF).alias("_refs"))
    j = entities.join(new, "id", "left")
    old = F.coalesce(external_refs(), F.array().cast(REF))
    fresh = F.filter("_refs", lambda r: ~F.exists(old, lambda o: (o["source"] == r["source"]) & (o["external_id"] == r["external_id"])))
    merged = merge_properties(F.col("properties"), F.to_json(F.struct(F.concat(old, fresh).alias("external_refs"))))
    return j.withColumn("properties", F.when(F.col("_refs").isNotNull(), merged).otherwise(F.col("properties"))).drop("_refs")


def find_by_external_ref(entities: DataFrame, source: str, external_id: str | Column, active_only: bool = True) -> DataFrame:
    hit = F.exists(external_refs(), lambda r: (r["source"] == source) & (r["external_id"] == external_id))
    return entities.where(hit & g.is_active() if active_only else hit)


def upsert_relation_embedding(relations: DataFrame, vectors: DataFrame, key: str = "embedding") -> DataFrame:
    """vectors(id, embedding) written to the JSON property `key`."""
    v = vectors.select("id", F.to_json(F.create_map(F.lit(key), F.col("embedding").cast("array<double>"))).alias("_new"))
    j = relations.join(v, "id", "left")
    return j.withColumn("properties", F.when(F.col("_new").isNotNull(), merge_properties(F.col("properties"), F.col("_new"))).otherwise(F.col("properties"))).drop("_new")


def relations_by_embedding(relations: DataFrame, queries: DataFrame, limit: int = 20, min_similarity: float | None = None) -> DataFrame:
    """Nearest relations by the property "embedding"; relations without one are passed over."""
    v = relations.withColumn("embedding", F.from_json(F.get_json_object("properties", "$.embedding"), "array<float>")).where("embedding IS NOT NULL")
    return nearest_neighbors(v.select("ns", "id", "embedding"), queries, limit, min_similarity)


def search_entities(entities: DataFrame, query: str | Column | None = None, entity_type: str | None = None, min_confidence: float | None = None, limit: int | None = 20, active_only: bool = False) -> DataFrame:
    """By type, case-insensitive part of the name and confidence (a missing one passes), in the order of names, then ids."""
    ok = g.confidence_passes(min_confidence)
    if entity_type is not None:
        ok = ok & (F.col("entity_type") == entity_type)
    if query is not None:
        ok = ok & F.contains(F.lower("name"), F.lower(F.lit(query) if isinstance(query, str) else query))
    if active_only:
        ok = ok & g.is_active()
    found = entities.where(ok)
    return found if limit is None else found.orderBy("name", "id").limit(limit)


def find_relations(relations: DataFrame, from_id: int | None = None, to_id: int | None = None, relation_type: str | None = None, min_confidence: float | None = None, current_only: bool = True) -> DataFrame:
    """By ends, type and confidence; in the order of ids where that matters to the caller."""
    ok = g.confidence_passes(min_confidence)
    for name, value in (("from_id", from_id), ("to_id", to_id), ("relation_type", relation_type)):
        if value is not None:
            ok = ok & (F.col(name) == value)
    return relations.where(ok & g.is_active() if current_only else ok)


def as_of(table: DataFrame, t: Column, mode: str = "reference") -> DataFrame:
    """What was valid at t. reference: of what is still in state active; bitemporal: whatever became of it later."""
    return table.where(g.active_at(t, mode))


def as_of_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, ts: str) -> DataFrame:
    """left with right's rows of the same key that were valid at left's time: an equi-join with a range condition."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    at = F.col(ts)
    valid = (F.col("r_valid_from").isNull() | (at >= F.col("r_valid_from"))) & (F.col("r_valid_to").isNull() | (at < F.col("r_valid_to")))
    return left.join(r, (F.col(left_key) == F.col(f"r_{right_key}")) & valid)


def changelog_of(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(operation, record_type, record_id, at): what the tables' system and valid times say happened."""
    def events(t, kind):
        made = t.select(F.lit("create").alias("operation"), F.lit(kind).alias("record_type"), F.col("id").alias("record_id"), F.col("valid_from").alias("at"))
        ended = t.where(g.state() != "active").select(g.state().alias("operation"), F.lit(kind).alias("record_type"), F.col("id").alias("record_id"), F.col("valid_to").alias("at"))
        return made.unionByName(ended)

    return events(entities, "entity").unionByName(events(relations, "relation"))


def changelog(log: DataFrame, since: Column | None = None, until: Column | None = None, record_type: str | None = None) -> DataFrame:
    """Both bounds belong to the range."""
    ok = F.lit(True)
    for bound, test in ((since, lambda b: F.col("at") >= b), (until, lambda b: F.col("at") <= b)):
        if bound is not None:
            ok = ok & test(bound)
    if record_type is not None:
        if record_type not in ("entity", "relation"):
            raise ConfigurationError("record_type must be entity or relation")
        ok = ok & (F.col("record_type") == record_type)
    return log.where(ok)
