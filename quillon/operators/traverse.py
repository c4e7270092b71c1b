"""Graph traversal by levels: neighbours, shortest paths, subgraphs, causal paths, components and communities. Many questions are answered at once."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import graph as g
from quillon.sources.errors import ConfigurationError
from quillon.sources.workspace import drop_table, write_table


def _edges(relations: DataFrame, direction: str) -> DataFrame:
    """Active edges as (a, b), to be followed from a to b."""
    r = relations.where(g.is_active())
    forth, back = r.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), r.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    if direction not in ("out", "in", "both"):
        raise ConfigurationError("direction must be out, in or both")
    return forth if direction == "out" else back if direction == "in" else forth.unionByName(back)


def _far(df: DataFrame) -> DataFrame:
    """A side that may be of any size: joined by shuffles. The planner goes by the size of files, which may be a tenth of what it then sends through the driver."""
    return df.hint("merge")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """edges(a, b) and seeds(query_id, id) to (query_id, id, level): what a breadth-first search of so many levels meets, seeds at level 0."""
    visited = seeds.select("query_id", "id", F.lit(0).alias("level")).distinct()
    frontier, edges = visited, _far(write_table(edges, "edges"))
    for level in range(1, depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("a")).select("query_id", F.col("b").alias("id")).distinct()
        frontier = write_table(step.join(_far(visited), ["query_id", "id"], "left_anti").withColumn("level", F.lit(level)), "frontier")
        visited = visited.unionByName(frontier)
    return visited


def neighbors(entities: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """(query_id, id, level) of entities within `depth` active relations of the seed, whatever their own state; the seed itself isn't among them."""
    if depth < 1:
        raise ConfigurationError("depth must be at least 1")
    found = reach(_edges(relations, direction), seeds, depth).where("level > 0")
    return found.join(_far(entities.select("id")), "id", "left_semi")


def subgraph(entities: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Per query the entities within `depth` relations of any seed, and all active relations among them: (query_id, id), (query_id, id, from_id, to_id)."""
    ids = write_table(reach(_edges(relations, "both"), seeds, depth).select("query_id", "id"), "subgraph")
    live = relations.where(g.is_active()).select(F.col("id").alias("rel"), "from_id", "to_id")
    inside = live.join(_far(ids.select("query_id", F.col("id").alias("from_id"))), "from_id").join(_far(ids.select("query_id", F.col("id").alias("to_id"))), ["query_id", "to_id"])
    return ids.join(_far(entities.select("id")), "id", "left_semi"), inside.select("query_id", F.col("rel").alias("id"), "from_id", "to_id")


def shortest_paths(entities: DataFrame, relations: DataFrame, pairs: DataFrame, max_levels: int | None = None) -> DataFrame:
    """pairs(from_id, to_id) to (from_id, to_id, path): a least-hop directed path over active entities and relations, where there is one.

    Of several, the one whose every node has the least parent. From and to alike give a path of one. Searches that
    start at the same node are one search, among what any end is reached from; they end when nothing new is met, or after max_levels hops where that is given.
    """
    live = entities.where(g.is_active()).select("id")
    e = _edges(relations, "out").join(_far(live.withColumnRenamed("id", "a")), "a", "left_semi").join(_far(live.withColumnRenamed("id", "b")), "b", "left_semi").distinct()
    e = write_table(e, "edges")
    # what no end is reached from lies on no path: one search back from all ends together, then only edges between what it met
    useful = write_table(pairs.select(F.col("to_id").alias("node")).distinct(), "useful")
    frontier = useful
    for level in itertools.count(1) if max_levels is None else range(1, max_levels + 1):
        step = frontier.join(_far(e), F.col("node") == F.col("b")).select(F.col("a").alias("node")).distinct()
        frontier = write_table(step.join(_far(useful), "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        useful = useful.unionByName(frontier)
        if level % 16 == 0:
            useful = write_table(useful, "useful")
    old, e = e, write_table(e.join(_far(useful), F.col("b") == F.col("node"), "left_semi"), "edges")
    drop_table(old)
    visited = pairs.select(F.col("from_id").alias("s")).distinct().join(_far(live), F.col("s") == F.col("id"), "left_semi").join(_far(useful), F.col("s") == F.col("node"), "left_semi")
    visited = write_table(visited.select("s", F.col("s").alias("node"), F.array("s").alias("path")), "visited")
    frontier = visited
    for level in itertools.count(1) if max_levels is None else range(1, max_levels + 1):
        step = frontier.join(_far(e), F.col("node") == F.col("a")).groupBy("s", F.col("b").alias("node")).agg(F.min(F.struct("node", "path")).alias("best"))
        step = step.join(_far(visited), ["s", "node"], "left_anti").select("s", "node", F.concat("best.path", F.array("node")).alias("path"))
        frontier = write_table(step, "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if level % 16 == 0:  # else the plan grows with the depth
            visited = write_table(visited, "visited")
    return pairs.distinct().join(_far(visited), (F.col("from_id") == F.col("s")) & (F.col("to_id") == F.col("node"))).select("from_id", "to_id", "path")


def _causal_edges(relations: DataFrame, types, least: float | None, as_of: Column | None) -> DataFrame:
    """Without as_of, retracted relations are followed too."""
    r = relations.where(F.col("relation_type").isin(*(types or g.CAUSAL_TYPES)) & g.strength_passes(least))
    r = r if as_of is None else r.where(g.active_at(as_of))
    return r.select(F.col("id").alias("edge"), "from_id", "to_id", F.col("relation_type").alias("type"), F.coalesce("causal_strength", F.lit(1.0)).alias("strength"), F.coalesce("conf_overall", F.lit(1.0)).alias("hop"))


def _walk(entities: DataFrame, edges: DataFrame, start: DataFrame, depth: int, backwards: bool, branching: int | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Simple paths by level: those that nothing extends, or that are as long as allowed, and all. Paths grow at the end, or at the front if backwards."""
    here, there = ("to_id", "from_id") if backwards else ("from_id", "to_id")
    known = _far(write_table(entities.select(F.col("id").alias("next"), F.coalesce("conf_overall", F.lit(1.0)).alias("next_conf")), "known"))
    edges = _far(write_table(edges.withColumnRenamed(here, "at").withColumnRenamed(there, "next"), "edges"))
    add = (lambda a, x: F.concat(F.array(x), a)) if backwards else (lambda a, x: F.concat(a, F.array(x)))
    done, every, level = [], [start], start
    for n in range(depth + 1):
        if n == depth:
            done.append(level)
            break
        tip = F.element_at("nodes", 1 if backwards else -1)
        step = level.withColumn("tip", tip).join(edges, (F.col("tip") == F.col("at")) & ~F.array_contains("nodes", F.col("next")), "left")
        if branching is not None:
            step = step.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "nodes", "links").orderBy("edge"))).where(F.col("n") <= branching).drop("n")
        step = write_table(step, "paths")
        done.append(step.where("edge IS NULL").select(*level.columns))
        taken = step.where("edge IS NOT NULL").join(known, "next")
        level = taken.select("query_id", add(F.col("nodes"), F.col("next")).alias("nodes"), add(F.col("links"), F.col("edge")).alias("links"), add(F.col("types"), F.col("type")).alias("types"), add(F.col("strengths"), F.col("strength")).alias("strengths"), add(F.col("hops"), F.col("hop")).alias("hops"), add(F.col("confs"), F.col("next_conf")).alias("confs"))
        every.append(level)
    return done, every


def _seed(entities: DataFrame, seeds: DataFrame, as_of: Column | None) -> DataFrame:
    e = entities if as_of is None else entities.where(g.active_at(as_of))
    s = seeds.join(_far(e.select("id", F.coalesce("conf_overall", F.lit(1.0)).alias("c"))), "id")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return s.select("query_id", F.array("id").alias("nodes"), empty("bigint").alias("links"), empty("string").alias("types"), empty("double").alias("strengths"), empty("double").alias("hops"), F.array("c").alias("confs"))


def _measured(paths: list[DataFrame], complete: bool, most: int | None) -> DataFrame:
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p)
    out = out.withColumn("chain_strength", g.chain_strength("strengths")).withColumn("chain_confidence", g.chain_confidence("hops", "confs")).withColumn("ceiling_hop", g.confidence_ceiling_hop("hops"))
    out = out.select("query_id", F.col("nodes"), F.col("links").alias("edges"), "types", "chain_strength", "chain_confidence", "ceiling_hop", F.size("links").alias("hop_count"), F.lit(complete).alias("is_complete"))
    if most is None:
        return out
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("chain_strength", 10)), "edges")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def causal_descendants(entities: DataFrame, relations: DataFrame, seeds: DataFrame, max_depth: int = 5, max_paths: int | None = 50, min_strength: float | None = None, max_branching: int | None = None, types=None, as_of: Column | None = None) -> DataFrame:
    """seeds(query_id, id) to their causal paths: nodes (seed first), edges, types, chain_strength, chain_confidence, ceiling_hop, hop_count.

    Simple paths that nothing extends, or of max_depth hops. max_paths keeps the strongest of a query, then those with
    the least edges; max_branching the least edge ids at each node. A path all of whose extensions lead to entities that
    don't exist is not given.
    """
    done, _ = _walk(entities, _causal_edges(relations, types, min_strength, as_of), _seed(entities, seeds, as_of), max_depth, False, max_branching)
    return _measured([p.where(F.size("links") > 0) for p in done], False, max_paths)


def causal_ancestors(entities: DataFrame, relations: DataFrame, seeds: DataFrame, max_depth: int = 5, max_paths: int | None = 50, min_strength: float | None = None, max_branching: int | None = None, types=None, as_of: Column | None = None) -> DataFrame:
    """The mirror image: nodes from the remotest cause on, without the seed itself (so as many nodes as edges). The seed's own validity doesn't matter."""
    done, _ = _walk(entities, _causal_edges(relations, types, min_strength, as_of), _seed(entities, seeds, None), max_depth, True, max_branching)
    cut = [p.where(F.size("links") > 0).withColumn("nodes", F.slice("nodes", 1, F.size("nodes") - 1)).withColumn("confs", F.slice("confs", 1, F.size("confs") - 1)) for p in done]
    return _measured(cut, False, max_paths)


def causal_paths(entities: DataFrame, relations: DataFrame, pairs: DataFrame, max_depth: int = 5, max_paths: int | None = 50, types=None) -> DataFrame:
    """pairs(query_id, from_id, to_id) to all simple causal paths between them, strongest first; strength and time don't filter here."""
    seeds = pairs.join(_far(entities.select(F.col("id").alias("to_id"))), "to_id", "left_semi").select("query_id", F.col("from_id").alias("id"))
    _, every = _walk(entities, _causal_edges(relations, types, None, None), _seed(entities, seeds, None), max_depth, False, None)
    target = _far(pairs.select("query_id", "to_id"))
    # a path that has met its target ends there
    hits = [p.join(target, "query_id").where((F.element_at("nodes", -1) == F.col("to_id")) & (F.array_position("nodes", F.col("to_id")) == F.size("nodes"))).drop("to_id") for p in every]
    return _measured(hits, True, max_paths)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id) and undirected edges(a, b) to (id, component), the least id that is met. An edge to what is no node still joins.

    Alternating large-star and small-star rounds: each shuffles the edges twice, and their number falls with the
    logarithm of the nodes. Every round is a written table.
    """
    e = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(_far(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(_far(low), "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old, e = e, write_table(small, "components")
        drop_table(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(_far(e.select(F.col("u").alias("id"), F.col("v").alias("component"))), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def detect_communities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(component, members, n, density, central_id): components of active entities over active relations that aren't infrastructure.

    density counts parallel relations and may exceed 1; it is 0 for a single entity. central_id has the most relations,
    the highest id in a tie.
    """
    live = write_table(entities.where(g.is_active()).select("id"), "live")
    r = write_table(relations.where(g.is_active() & ~F.col("relation_type").startswith("__")).select("from_id", "to_id"), "relations")
    who = write_table(connected_components(live, r.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))), "members")
    inside = write_table(r.join(_far(who.select(F.col("id").alias("from_id"), "component")), "from_id").join(_far(live.withColumnRenamed("id", "to_id")), "to_id", "left_semi"), "inside")
    n_edges = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    degree = inside.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = who.join(_far(degree), "id", "left").groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("n"), F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "id"))["id"].alias("central_id"))
    possible = F.col("n") * (F.col("n") - 1) / 2
    return ranked.join(_far(n_edges), "component", "left").select("component", "members", "n", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("n_edges", F.lit(0)) / possible).alias("density"), "central_id")
