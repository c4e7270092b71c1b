"""Operators on small fixtures with values worked out by hand."""

import math
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import graph as g
from quillon.operators import agents, answers, bm25, cache, chunking, diffs, fusion, graph_search, hybrid, routing, traverse, tuning, vectors
from quillon.operators import graph_store as gs
from quillon.operators import ontology as ont
from quillon.sources.errors import ConfigurationError, NotConnectedError, NotFoundError, SerializationError
from quillon.sources.store import StoreConfig, build_store, probe


def one(df):
    return df.first()[0]


def expr(spark, c):
    return spark.range(1).select(c).first()[0]


# --- text ranking -----------------------------------------------------------------------------------------------------


def index(spark, rows, **config):
    return bm25.build_index(spark.createDataFrame([("default", *r) for r in rows], "ns string, id string, field string, text string"), bm25.Bm25Config(**config))


def ask(spark, text):
    return spark.createDataFrame([(1, "default", text)], "query_id int, ns string, query string")


def test_bm25_scores(spark):
    i = index(spark, [("high", "text", "rust rust rust rust systems rust"), ("low", "text", "rust scripting easy")])
    got = {r.id: r.score for r in bm25.search(i, ask(spark, "rust")).collect()}
    assert got == {"high": pytest.approx(0.3085442, abs=1e-6), "low": pytest.approx(0.2111092, abs=1e-6)}


def test_rare_terms_weigh_more(spark):
    i = index(spark, [("0", "text", "rust unique systems"), *((str(k), "text", f"rust doc{k}") for k in range(1, 5))])
    score = lambda q: {r.id: r.score for r in bm25.search(i, ask(spark, q)).collect()}["0"]
    assert score("unique") == pytest.approx(1.2067742, abs=1e-6)
    assert score("rust") == pytest.approx(0.0757437, abs=1e-6)


@pytest.mark.parametrize("limit, least, fields", [(3, None, None), (40, 0.5, None), (5, None, ["a"])])
def test_searches_are_joins_of_postings(spark, limit, least, fields):
    """Against field_scores(): several namespaces and fields, an id's rows apart and repeated, null ids and texts, few documents met by many queries."""
    rng = np.random.default_rng(limit)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, n) if x < 300)
    rows = [(("x", "y")[i % 2], i // 3, ("a", "b", "a")[i % 3] if i % 5 else "b", text(25) if i % 11 else None) for i in range(600)]
    rows += [("x", None, "a", "w1 w2"), ("x", None, "a", "w1 w3"), ("x", 900, "a", ""), ("z", 901, "a", "w1")]
    i = bm25.build_index(spark.createDataFrame(rows, "ns string, id long, field string, text string").repartition(3))
    q = spark.createDataFrame([(k, ("x", "y", "u")[k % 3], text(4 + k)) for k in range(12)] + [(20, "x", "the")], "query_id int, ns string, query string")
    parts: dict = {}
    for r in bm25.field_scores(i, q, fields).collect():
        parts.setdefault((r.query_id, r.id), []).append(r)
    want: dict = {}
    for (k, d), p in parts.items():
        score = round(sum(r.part for r in p), 10)
        if score > 0 and score >= (least or 0):
            want.setdefault(k, []).append((-score, d, tuple(sorted({r.term for r in p})), {f: sum(r.part for r in p if r.field == f) for f in {r.field for r in p}}))
    got: dict = {}
    for r in bm25.search(i, q, limit, least, fields).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id, tuple(r.matched_terms), r.field_scores))
    assert set(got) == set(want) and len(got) == 8
    for k, x in want.items():
        x = sorted(x, key=lambda y: y[:2])[:limit]
        assert [y[1:3] for y in got[k]] == [y[1:3] for y in x]
        for y, z in zip(got[k], x):
            assert abs(y[0] - z[0]) < 1e-9 and y[3] == pytest.approx(z[3])
    bare = bm25.search(i, q, limit, least, fields, details=False)
    assert bare.columns == ["query_id", "id", "score", "rank"] and sorted((r.query_id, r.id) for r in bare.collect()) == sorted((k, y[1]) for k in got for y in got[k])


def test_searches_shuffle_neither_postings_nor_scores(spark):
    """Postings of all texts were counted by shuffles, twice, and joined with queries, lengths and frequencies."""
    i = index(spark, [(str(k), "text", "rust and python") for k in range(9)])
    plan = bm25.search(i, ask(spark, "rust"), details=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate explode" not in plan


def test_fields_and_stop_words(spark):
    i = index(spark, [("a", "title", "rust programming"), ("a", "body", "python scripting")])
    assert bm25.search(i, ask(spark, "python"), fields=["title"]).count() == 0
    assert bm25.search(i, ask(spark, "python"), fields=["body"]).count() == 1
    assert set(bm25.search(i, ask(spark, "rust python")).first().field_scores) == {"title", "body"}
    for q in ("the", "", "of the"):
        assert bm25.search(i, ask(spark, q)).count() == 0
    with pytest.raises(ConfigurationError):
        bm25.Bm25Config(b=2)


def test_hybrid_of_three(spark):
    rows = [("rust", "rust systems programming language", [1.0, 0.0]), ("python", "python scripting easy language", [0.7, 0.7]), ("go", "go concurrency goroutines", [0.0, 1.0])]
    v = spark.createDataFrame([("default", i, e, "{}") for i, _, e in rows], "ns string, id string, embedding array<float>, metadata string")
    q = spark.createDataFrame([(1, "default", [1.0, 0.0])], "query_id int, ns string, embedding array<float>")
    got = {r.id: r for r in hybrid.hybrid_search(index(spark, [(i, "text", t) for i, t, _ in rows]), v, ask(spark, "rust"), q).collect()}
    assert got["rust"].bm25 == pytest.approx(0.9456601, abs=1e-6)
    assert [round(got[k].hybrid, 9) for k in ("rust", "python", "go")] == [0.016393443, 0.008064516, 0.007936508]
    assert [round(got[k].confidence, 6) for k in ("rust", "python", "go")] == [0.995459, 0.063623, 0.05]


def test_linear_and_normalisers(spark):
    side = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "query_id int, id string, score double")
    got = {r.id: r.hybrid for r in fusion.linear(side([("x", 0.8), ("y", 1.0)]), side([("x", 0.6)]), "none").collect()}
    assert got == {"x": pytest.approx(0.7), "y": pytest.approx(0.5)}
    got = {r.id: r.hybrid for r in fusion.linear(side([("a", 0.0), ("b", 10.0)]), side([("a", 3.0)])).collect()}
    assert got == {"a": 0.0, "b": 0.5}  # a single value normalises to 0


def test_vectors(spark):
    v = spark.createDataFrame([("default", str(i), [float(i), 0.0], '{"type":"doc"}' if i == 1 else "{}") for i in range(5)] + [("default", "far", [0.0, 1.0], "{}"), ("default", "odd", [1.0], "{}")], "ns string, id string, embedding array<float>, metadata string")
    q = spark.createDataFrame([(1, "default", [1.0, 0.0])], "query_id int, ns string, embedding array<float>")
    top = lambda **k: [r.id for r in vectors.nearest_neighbors(v, q, **k).orderBy("rank").collect()]
    assert top(limit=2) == ["1", "2"]
    assert top(min_similarity=0.9) == ["1", "2", "3", "4"]
    assert top(where=vectors.metadata_filter({"type": "doc"})) == ["1"]
    assert "odd" not in top()


# --- graph ------------------------------------------------------------------------------------------------------------

E = "ns string, id long, name string, entity_type string, valid_from timestamp, valid_to timestamp, assertion_state string, conf_overall double"
R = "ns string, id long, from_id long, to_id long, relation_type string, valid_from timestamp, valid_to timestamp, causal_strength double, conf_overall double, assertion_state string"


def graph(spark, edges, n=6, names=None, kinds="CAUSES"):
    e = spark.createDataFrame([("default", i, (names or {}).get(i, f"node{i}"), "T", None, None, "active", None) for i in range(1, n + 1)], E)
    r = spark.createDataFrame([("default", k, a, b, kinds if isinstance(kinds, str) else kinds[k], None, None, None, None, "active") for k, (a, b) in enumerate(edges)], R)
    return e, r


def seeds(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "query_id long, id long")


@pytest.mark.parametrize("limit, least", [(3, None), (7, 0.1), (40, -0.2), (1, 0.9)])
def test_nearest_are_those_of_brute_force(spark, monkeypatch, limit, least):
    """Ties, copies, zero and odd vectors, several dimensions and namespaces, in blocks of any size."""
    for name, n in (("BLOCK_ROWS", 40), ("QUERY_ROWS", 90), ("BLOCKS_AT_ONCE", 2), ("TILE_ROWS", 30), ("TAKEN", 500)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(limit)
    rows = []
    for i in range(400):
        dim = 8 if i % 10 else 5
        x = np.zeros(dim) if i % 50 == 3 else rng.normal(size=dim) * (1 if i % 7 else 1e6)
        rows.append(("a" if i % 3 else "b", i, [float(y) for y in (rows[-10][2] if i % 20 == 11 and len(rows[-10][2]) == dim else x)]))
    rows += [("a", 400, None), ("a", 401, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "ns string, id long, embedding array<double>")
    q = v.where("id % 4 = 0").select(F.col("id").alias("query_id"), "ns", "embedding")
    got = sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in vectors.nearest_neighbors(v, q, limit, least).collect())
    want = []
    for ns, k, x in rows:
        if k % 4 == 0 and x is not None:
            hits = []
            for other, i, y in rows:
                if other == ns and y is not None and len(x) == len(y) and not np.isnan(y[0]):
                    a, b = np.linalg.norm(x), np.linalg.norm(y)
                    raw = float(np.clip(np.dot(x, y) / (a * b), -1, 1)) if min(a, b) > 1e-9 else 0.0
                    if least is None or raw >= least:
                        hits.append((-round(max(raw, 0.0), 10), i))
            want += [(k, r + 1, i, -s) for r, (s, i) in enumerate(sorted(hits)[:limit])]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and len(got) > 50
    assert max(abs(x[3] - y[3]) for x, y in zip(got, sorted(want))) < 1e-9
    assert sum(x[2] != y[2] for x, y in zip(got, sorted(want))) <= len(got) // 50  # ties that the last bit decides


def test_few_pairs_are_computed_and_kept(monkeypatch):
    """Each block of vectors gave `limit` rows a query, all of which were sorted in double and shuffled."""
    rng = np.random.default_rng(2)
    best, taken = vectors._Best(vectors._unit(rng.normal(size=(50, 16))), 5, None), []
    take = best._take
    monkeypatch.setattr(best, "_take", lambda row, *rest: (taken.append(len(row)), take(row, *rest)))
    for k in range(20):
        best.meet(vectors._unit(rng.normal(size=(500, 16))), np.arange(500) + 500 * k)
    assert len(best.row) == 50 * 5 and sum(taken) < 50 * 10_000 / 100


def test_traversal(spark):
    e, r = graph(spark, [(1, 2), (1, 3), (3, 4)])
    assert sorted(x.id for x in traverse.neighbors(e, r, seeds(spark, 1), 1).collect()) == [2, 3]
    assert sorted(x.id for x in traverse.neighbors(e, r, seeds(spark, 4), 2, "in").collect()) == [1, 3]
    with pytest.raises(ConfigurationError):
        traverse.neighbors(e, r, seeds(spark, 1), 0)
    pairs = spark.createDataFrame([(1, 4), (4, 1), (2, 2)], "from_id long, to_id long")
    assert {(x.from_id, x.to_id): x.path for x in traverse.shortest_paths(e, r, pairs).collect()} == {(1, 4): [1, 3, 4], (2, 2): [2]}
    nodes, edges = traverse.subgraph(e, r, seeds(spark, 1), 2)
    assert (nodes.count(), edges.count()) == (4, 3)


def test_shortest_paths_have_no_bound(spark):
    e, r = graph(spark, [(i, i + 1) for i in range(1, 67)], n=67)
    pairs = spark.createDataFrame([(1, 67)], "from_id long, to_id long")
    assert [x.path for x in traverse.shortest_paths(e, r, pairs).collect()] == [list(range(1, 68))]
    assert traverse.shortest_paths(e, r, pairs, 2).collect() == []


def test_shortest_paths_search_only_what_leads_to_an_end(spark, monkeypatch):
    """Every search followed all that it met: here 2,000 nodes that no end is reached from."""
    e = spark.createDataFrame([(i, "active", None, None) for i in range(2100)], "id long, assertion_state string, valid_from timestamp, valid_to timestamp")
    ends = [(1, 2), (0, 1), (0, 3), (3, 2), (1, 4), *((1, i) for i in range(100, 2100))]
    r = spark.createDataFrame([(i, a, b, "active", None, None) for i, (a, b) in enumerate(ends)], "id long, from_id long, to_id long, assertion_state string, valid_from timestamp, valid_to timestamp")
    met, write = [], traverse.write_table

    def counted(df, name):
        out = write(df, name)
        met.append(out.count() if name == "frontier" else 0)
        return out

    monkeypatch.setattr(traverse, "write_table", counted)
    pairs = spark.createDataFrame([(0, 2), (1, 2), (4, 2), (2, 2), (0, 5000)], "from_id long, to_id long")
    assert sorted(tuple(x) for x in traverse.shortest_paths(e, r, pairs).collect()) == [(0, 2, [0, 1, 2]), (1, 2, [1, 2]), (2, 2, [2])]
    assert max(met) < 10


def test_walks_send_no_table_through_the_driver(spark):
    """Files under 10 MB were broadcast, however many rows they held."""
    e = spark.createDataFrame([(i, 1.0) for i in range(9)], "id long, conf_overall double")
    r = spark.createDataFrame([(i, i, i + 1, "CAUSES", 0.5, 0.5) for i in range(8)], "id long, from_id long, to_id long, relation_type string, causal_strength double, conf_overall double")
    pairs = spark.createDataFrame([(1, 0, 3)], "query_id long, from_id long, to_id long")
    out = traverse.causal_paths(e, r, pairs)
    assert [x.nodes for x in out.collect()] == [[0, 1, 2, 3]]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_causal_chains(spark):
    e, r = graph(spark, [(1, 2), (2, 3), (1, 4)], kinds=["CAUSES", "TRIGGERS", "LIKES"])
    down = traverse.causal_descendants(e, r, seeds(spark, 1)).collect()
    assert [x.nodes for x in down] == [[1, 2, 3]]
    assert traverse.causal_descendants(e, r, seeds(spark, 3)).count() == 0
    up = traverse.causal_ancestors(e, r, seeds(spark, 3)).collect()
    assert len(up) == 1 and 3 not in up[0].nodes and len(up[0].nodes) == len(up[0].edges)
    found = traverse.causal_paths(e, r, spark.createDataFrame([(1, 1, 3)], "query_id long, from_id long, to_id long")).collect()
    assert [x.nodes for x in found] == [[1, 2, 3]] and found[0].is_complete


def test_chain_arithmetic(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert expr(spark, g.chain_confidence(arr(0.9, 0.6), arr(1.0, 0.4, 1.0))) == pytest.approx(0.4)
    assert expr(spark, g.chain_strength(arr(0.25, 1.0))) == pytest.approx(0.5)
    assert expr(spark, g.confidence_ceiling_hop(arr(0.9, 0.2, 0.2))) == 1
    assert expr(spark, g.approximate_chain_confidence(F.lit(1.0), F.lit(3))) == pytest.approx(0.9**3)


def test_communities(spark):
    e, r = graph(spark, [(1, 2), (1, 3)], 4)
    got = {x.component: x for x in traverse.detect_communities(e, r).collect()}
    assert (got[1].members, got[1].central_id, got[1].density) == ([1, 2, 3], 1, pytest.approx(2 / 3))
    assert (got[4].members, got[4].density) == ([4], 0.0)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got = traverse.connected_components(spark.range(400), edges).collect()
    assert all(r.component == (0 if r.id <= 300 else r.id) for r in got)


def test_states_and_times(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(t("2020-01-01").alias("valid_from"), t("2021-01-01").alias("valid_to"), F.lit("superseded").alias("assertion_state"))
    assert not row.select(g.active_at(t("2020-06-01"))).first()[0]
    assert row.select(g.active_at(t("2020-06-01"), "bitemporal")).first()[0]
    assert not row.select(g.active_at(t("2021-01-01"), "bitemporal")).first()[0]
    e, r = graph(spark, [(1, 2), (2, 1), (2, 3)])
    left, rel = gs.delete_entities(e, r, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 5 and [x.id for x in rel.collect()] == [2]


# --- graph search -----------------------------------------------------------------------------------------------------


def test_graph_search(spark):
    e, r = graph(spark, [(1, 2), (2, 3), (3, 4)], names={1: "Rust Language", 2: "Memory", 3: "rust belt"})
    asks = spark.createDataFrame([(1, "Memory"), (2, "rust"), (3, "what is memory like"), (4, "zz no"), (5, "why memory")], "query_id int, query string")
    assert {x.query_id: x.id for x in graph_search.resolve_seeds(e, asks).collect()} == {1: 2, 2: 1, 3: 2, 5: 2}
    found, paths, _ = graph_search.local_search(e, r, asks)
    assert sorted(x.id for x in found.where("query_id = 1").collect()) == [1, 2, 3, 4]
    assert {(x.query_id, x.direction) for x in paths.collect()} == {(5, "ancestors")}
    assert expr(spark, graph_search.relevance(F.lit("rust systems"), F.lit("Rust systems programming"))) == 1
    assert expr(spark, graph_search.relevance(F.lit("rust python"), F.lit("rust programming"))) == 0.5
    assert expr(spark, graph_search.community_key(F.array(F.lit(3), F.lit(1)))) == "1:3"


# --- ontology ---------------------------------------------------------------------------------------------------------


def test_ontology_json_and_registry(spark):
    o = ont.Ontology("o", "1", (ont.EntityType("A", aliases=("x",), properties=(ont.Property("p", required=True, pattern="^[a-z"),)),), (ont.RelationType("R", sources=("A",)),))
    assert ont.Ontology.from_json(o.to_json()) == o
    with pytest.raises(SerializationError):
        ont.Ontology.from_json("{}")
    reg = ont.Registry()
    reg.register(o)
    reg.register(ont.Ontology("o", "2"), activate=False)
    assert reg.get("o").version == "1" and reg.versions("o") == ["1", "2"] and reg.names() == ["o"]
    reg.activate("o", "2")
    assert reg.get("o").version == "2" and reg.get("none") is None
    with pytest.raises(ConfigurationError):
        reg.register(ont.Ontology("p", ""))
    # a pattern that is no regular expression passes; a JSON null is there, a missing key isn't
    rows = spark.createDataFrame([("X", '{"p": null}'), ("a", '{"p": "Q"}'), ("a", "{}"), ("b", "{}"), ("A", None)], "entity_type string, properties string")
    got = [(r.canonical, r.errors) for r in ont.validate_entities(rows, o).collect()]
    missing = ["missing required property p on A"]
    assert got == [("A", []), ("A", []), ("A", missing), (None, ["unknown entity type: b"]), ("A", missing)]


# --- chunks and differences -------------------------------------------------------------------------------------------


def test_fixed_chunks(spark):
    d = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "é")], "id int, text string")
    got = [(r.id, r.content) for r in chunking.fixed_length(d, 6, 2).orderBy("id", "index").collect()]
    assert got == [(1, "abcdef"), (1, "efghij"), (1, "ij"), (4, "é")]
    with pytest.raises(ConfigurationError):
        chunking.fixed_length(d, 2, 2)


def test_token_chunks_keep_the_text(spark):
    text = "  één two\n\nthree   four five "
    got = chunking.token_count(spark.createDataFrame([(1, text)], "id int, text string"), 2, 1).orderBy("index").collect()
    assert [r.content for r in got] == ["één two", "two\n\nthree", "three   four", "four five", "five"]
    for r in got:
        assert text[r.start : r.end] == r.content == text.encode()[r.byte_start : r.byte_end].decode()


def test_sentence_chunks():
    text = "One two three. Four five! Six seven eight nine ten eleven? Twelve."
    assert [c[0] for c in chunking.sentence_chunks(text, 1, 5, 0)] == ["One two three. Four five!", "Six seven eight nine ten", "eleven?", "Twelve."]
    over = chunking.sentence_chunks("A b. C d e f.", 3, 5, 0)
    assert over == [("A b. C d e f.", 0, 13, True)]
    again = chunking.sentence_chunks("A b c. D e f. G h i.", 2, 6, 3)
    assert [c[0] for c in again] == ["A b c. D e f.", "D e f. G h i."]
    assert chunking.sentence_chunks(" \n ") == []


def test_parents_and_children():
    got = chunking.parent_child_chunks("a b c d e", 4, 2)
    assert [(c, p) for c, _, _, p in got] == [("a b c d", None), ("a b", 0), ("c d", 0), ("e", None), ("e", 3)]


def test_differences(spark):
    assert diffs.focused_pair("a b c d e", "a b X d e", 100, 1) == ("...b [[c]] d...", "...b [[X]] d...")
    assert diffs.focused_pair("same  text", "same text", 4) == ("same", "same")
    assert diffs.focused_pair("", "new words", 100) == ("", "[[new words]]")
    assert diffs.cut("aé", 2) == "a"
    assert diffs.changed("a b c d".split(), "b c x d".split()) == ((0, 0), (2, 2))
    assert diffs.boundary_sensitive("abc xyz", "abd xyz", 2) and not diffs.boundary_sensitive("aaaaXbbbb", "aaaaYbbbb", 2)
    units = spark.createDataFrame([("d", str(i), i, f"unit {i} text") for i in range(4)], "doc string, id string, position int, text string")
    new = units.withColumn("text", F.when(F.col("id") == "1", "other 1 text").otherwise(F.col("text")))
    got = diffs.stitched_pairs(units, new, spark.createDataFrame([("d", "1", "1"), ("d", "3", "3")], "doc string, previous_id string, current_id string")).orderBy("previous_id").collect()
    assert (got[0].stitched, got[0].previous_ids, got[1].stitched, got[1].current_ids) == (True, ["0", "1", "2"], False, ["3"])
    assert "[[other]]" in got[0].current_snippet


def test_edit_scripts_are_shortest():
    import random

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 7))] for _ in range(2))
        gone, came = diffs.changed(a, b)
        rest = lambda x, s: x[: s[0]] + x[s[1] + 1 :] if s else x
        # what lies outside the changed spans is common to both, in order
        head, tail = (gone or (len(a), 0))[0], len(a) - 1 - (gone or (0, -1))[1]
        assert (a == b) == (gone is None and came is None)
        assert len(rest(a, gone)) <= len(a) and head >= 0 and tail >= 0


# --- answers, routing, caches -----------------------------------------------------------------------------------------


def test_evaluation(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert expr(spark, answers.context_precision(a("abc", "x"), a("ab"))) == 0.5
    assert expr(spark, answers.context_precision(a(), a("ab"))) == 0
    assert expr(spark, answers.context_recall(a("abc"), a("ab", "zz"))) == 0.5
    assert expr(spark, answers.context_recall(a("abc"), a())) == 1
    o = spark.createDataFrame([("How is the Rust?", 0.2), ("rust", None), ("the", 0.1), ("", 0.1), ("fine", 0.9)], "query string, max_similarity double")
    assert [tuple(r) for r in answers.most_missed(answers.query_gaps(o)).collect()] == [("rust", 2, 0.2), ("the", 1, 0.1)]


def test_contexts(spark):
    c = spark.createDataFrame([(1, 1, "a", None, None), (1, 2, "a", 0.9, None), (1, 3, "b", 0.1, 0.9), (2, 1, "c", None, 0.2)], "query_id int, rank int, content string, score double, retrieval_score double")
    kept, audit = answers.run_filters(c, [("score", lambda d: answers.min_score(d, 0.5)), ("unique", answers.deduplicate)])
    assert [(r.query_id, r.rank) for r in kept.collect()] == [(1, 1)]
    assert sorted(map(tuple, audit.collect())) == [(1, 0, "score", 3, 2), (1, 1, "unique", 2, 1), (2, 0, "score", 1, 0), (2, 1, "unique", 0, 0)]


def test_routing(spark):
    assert expr(spark, routing.model_tier(F.lit("GPT-4.1-mini"))) == 2
    assert expr(spark, routing.model_tier(F.lit("gpt-4.1"))) == 4
    assert expr(spark, routing.estimated_cost(F.lit("x-nano"), F.lit(2000))) == pytest.approx(0.1)
    assert expr(spark, routing.estimated_cost(F.lit("x"), F.lit(0))) is None
    assert expr(spark, routing.heuristic_score(F.lit("compare compare"))) == pytest.approx(0.3 * 2 / 50 + 0.3 * 0.5 + 0.2 + 0.2)
    assert expr(spark, routing.gini(F.lit(1), F.lit(1))) == 0.5
    assert expr(spark, routing.split_gini(F.lit(2), F.lit(0), F.lit(0), F.lit(2))) == 0
    draws = {r.m: r.n for r in spark.range(4000).groupBy(routing.weighted_route("id", [("a", 1.0), ("b", 3.0)]).alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(draws["b"] - 3000) < 150


def test_forest_separates(spark):
    rows = spark.createDataFrame([([float(i), float(i % 3)], int(i >= 50)) for i in range(100)], "features array<double>, label int")
    model = routing.train_forest(rows, trees=10, depth=5)
    scored = routing.forest_score(spark.createDataFrame([([5.0, 1.0],), ([90.0, 1.0],), (None,)], "embedding array<double>"), model).collect()
    got = {None if r.embedding is None else r.embedding[0]: r.score for r in scored}
    assert got[5.0] > 0.8 and got[90.0] < 0.2 and got[None] is None
    best = routing.best_splits(rows).collect()
    assert (best[0].feature, best[0].threshold) == (0, 49.5)


def test_cache(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    c = spark.createDataFrame([("n", "a", b"1", None), ("n", "b", b"2", datetime(2024, 1, 1)), ("n", "c", b"3", datetime(2024, 1, 3))], "ns string, key string, value binary, expires_at timestamp")
    asked = spark.createDataFrame([("n", k) for k in "abcda"], "ns string, key string")
    log = cache.lookup(c, asked, now)
    assert {r.key: (r.hit, r.evicted) for r in log.collect()} == {"a": (True, False), "b": (False, True), "c": (True, False), "d": (False, False)}
    assert tuple(cache.stats(log).first()) == (3, 2, 1, 0.6)
    assert cache.stats(log.where("false")).first().hit_rate == 0
    assert cache.null_lookup(asked).where("hit").count() == 0
    assert cache.evict(c, now).count() == 2 and cache.clear(c).count() == 0


# --- agents, prompts, stores ------------------------------------------------------------------------------------------


def test_agent_loop():
    turns = iter([agents.Turn("", [("add", {"a": 1}), ("subtask", {"objective": "x"})], 5), agents.Turn("sub", [], 1), agents.Turn("done", [], 1)])
    answer, log = agents.solve("go", lambda _: next(turns), lambda n, a: f"{n}{a['a']}")
    assert answer == "done" and [m["text"] for m in log if m["role"] == "tool"] == ["add1", "sub"]
    assert agents.solve("go", lambda _: agents.Turn("", [("t", {})], 10), lambda n, a: "", max_tokens=15)[0] is None


def test_policy_and_budget(spark):
    calls = spark.createDataFrame([("s", 1, None, "write_file", "/a", None, True), ("s", 2, None, "read_file", "/a", None, True), ("s", 3, 9, "write_file", "/a", None, True), ("t", 4, None, "read_file", "/a", None, True), ("t", 5, None, "write_file", "/a", None, True), ("t", 6, None, "run_shell", None, " ls ", True), ("t", 7, None, "run_shell", None, "ls", True)], "session string, seq int, ended int, tool string, path string, command string, ok boolean")
    got = {r.seq: r.blocked for r in agents.policy(calls).collect()}
    assert got[1].startswith("write-before-read") and got[2] is None and got[3] is None and got[5].startswith("parallel") and got[6] is None and got[7] == "repeated run_shell blocked for ls"
    log = spark.createDataFrame([(1, i, "tool", f"r{i}", 30_000) for i in range(6)], "conv_id int, turn int, role string, text string, tokens int")
    assert [r.condensed for r in agents.condense(log).orderBy("turn").collect()] == [True, True, False, False, False, False]
    assert [r.exceeded for r in agents.token_budget(log, 60_000).orderBy("turn").collect()] == [False, False, True, True, True, True]


def test_prompt_search(spark):
    samples = spark.createDataFrame([(i, f"in{i}", "yes" if i else None) for i in range(6)], "sample_id int, input string, expected string")
    model = lambda full: F.when(full.contains("magic"), "yes").otherwise("no")
    writer = lambda ask: "magic prompt"
    best, score = tuning.mipro("plain", samples, model, writer, proposals=2, trials=3, minibatch=4)
    assert "magic" in best and score == 1
    best, score = tuning.gepa("plain", samples, model, writer, population=2, iterations=1)
    assert best == "magic prompt" and score == 1
    with pytest.raises(ConfigurationError):
        tuning.gepa("p", samples.where("false"), model, writer)
    assert tuning.noop("p") == ("p", None)
    none = tuning.score_prompts(spark.createDataFrame([(0, "p")], "prompt_id int, prompt string"), samples.where("expected IS NULL"), model)
    assert none.first().score == -math.inf


def test_store(spark, tmp_path):
    store = build_store(spark, StoreConfig(f"file://{tmp_path}/s"))
    store.write("t", spark.createDataFrame([("default", 1), ("other", 2)], "ns string, id int"))
    assert [r.id for r in store.scan("t").collect()] == [1] and store.scan("t", every_ns=True).count() == 2
    assert store.healthcheck("t").is_usable and not store.healthcheck("none").is_usable
    with pytest.raises(NotFoundError):
        store.scan("none")
    store.disconnect()
    with pytest.raises(NotConnectedError):
        store.scan("t")
    with pytest.raises(ConfigurationError):
        StoreConfig("")
    h = probe(lambda: None, 1)
    assert h.status == "healthy" and datetime.now(UTC) - h.checked_at < timedelta(minutes=1)


def test_entry_works_without_the_pipeline(tmp_path):
    """As the driver does: without the llm folder and corpus_pipeline.py all else must import."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr
