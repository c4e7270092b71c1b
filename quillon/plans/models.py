"""Queries over caches, routing, prompt search and agents' logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import count_tokens
from quillon.operators import agents, cache, routing, tuning
from quillon.plans.registry import query
from quillon.sources.tables import load

AT = "2024-01-03 00:00:00"
_TOKENS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> ''))"


def _events(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events")


@query("SELECT event_id, sha256(event_type || chr(0) || 'm' || user_id || chr(0) || props || chr(0) || 'x' || chr(0) || 'a=' || user_id || chr(0) || 'b=' || event_type || chr(0)) AS key FROM events")
def cache_key(spark, sf_dir):
    params = F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"))
    return _events(spark, sf_dir).select("event_id", cache.cache_key("event_type", F.concat(F.lit("m"), "user_id"), F.array("props", F.lit("x")), params).alias("key"))


_CACHE = """
puts AS (SELECT event_type AS ns, props AS key, event_id AS value, CASE WHEN value >= 20 THEN ts + INTERVAL 1 DAY END AS expires_at FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY event_type, props ORDER BY ts DESC, event_id DESC) = 1),
asked AS (SELECT CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS ns, props AS key FROM events WHERE event_type IN ('error', 'signup', 'click')),
found AS (SELECT asked.ns, asked.key, value, value IS NOT NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-03') AS hit, value IS NOT NULL AND coalesce(expires_at <= TIMESTAMP '2024-01-03', false) AS evicted FROM asked LEFT JOIN puts ON puts.ns = asked.ns AND puts.key = asked.key)
"""


def _lookups(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    puts = e.where(F.col("event_type").isin("click", "view")).groupBy(F.col("event_type").alias("ns"), F.col("props").alias("key")).agg(F.max(F.struct("ts", "event_id", "value")).alias("last"))
    until = F.when(F.col("last.value") >= 20, F.col("last.ts").cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    puts = puts.select("ns", "key", F.col("last.event_id").alias("value"), until.alias("expires_at"))
    asked = e.where(F.col("event_type").isin("error", "signup", "click")).select(F.when(F.col("event_type") == "error", "view").otherwise(F.col("event_type")).alias("ns"), F.col("props").alias("key"))
    return cache.lookup(cache.put(puts.where("false"), puts), asked, F.lit(AT).cast("timestamp"))


@query(f"WITH {_CACHE} SELECT ns, key, CASE WHEN hit THEN value END AS value, hit, evicted FROM found")
def cache_lookup(spark, sf_dir):
    return _lookups(spark, sf_dir).select("ns", "key", "value", "hit", "evicted")


@query(f"WITH {_CACHE} SELECT ns, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (evicted) AS evictions, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS hit_rate FROM found GROUP BY 1")
def cache_stats(spark, sf_dir):
    s = cache.stats(_lookups(spark, sf_dir), ["ns"])
    return s.select("ns", "hits", "misses", "evictions", F.round("hit_rate", 6).alias("hit_rate"))


# --- routing ---------------------------------------------------------------------------------------------------------

RULES = [("[0-9]", "numbers"), ("\\?", "questions"), ("^[A-M]", "early")]


def _talk(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "conversations")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN 'numbers' WHEN regexp_matches(text, '\\?') THEN 'questions' WHEN regexp_matches(text, '^[A-M]') THEN 'early' ELSE 'plain' END AS model FROM conversations")
def regex_route(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", routing.regex_route("text", RULES, "plain").alias("model"))


@query("SELECT conv_id, turn, (['a', 'b', 'c'])[(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 + 1] AS model FROM conversations")
def round_robin(spark, sf_dir):
    return routing.round_robin(_talk(spark, sf_dir), ["a", "b", "c"], "turn", "conv_id").select("conv_id", "turn", "model")


@query("WITH d AS (SELECT event_id, ('0x' || substr(sha256(event_id || '|7'), 1, 12))::BIGINT / 281474976710656::DOUBLE * 4 AS r FROM events) SELECT event_id, CASE WHEN r <= 1 THEN 'a' WHEN r <= 3.5::DOUBLE THEN 'b' ELSE 'c' END AS model FROM d")
def weighted_route(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", routing.weighted_route("event_id", [("a", 1.0), ("b", 2.5), ("c", 0.5)], 7).alias("model"))


_H = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_COMPLEX = "['" + "','".join(routing.COMPLEX_WORDS) + "']"


@query(
    f"WITH t AS (SELECT conv_id, turn, {_H} AS t FROM conversations), s AS (SELECT conv_id, turn, CASE WHEN len(t) = 0 THEN 0::DOUBLE ELSE least(1::DOUBLE, 0.3::DOUBLE * least(len(t) / 50, 1::DOUBLE) + 0.3::DOUBLE * len(list_distinct(t)) / len(t) + 0.2::DOUBLE * len(list_filter(t, lambda x: length(x) >= 7)) / len(t) + 0.2::DOUBLE * len(list_filter(t, lambda x: list_contains({_COMPLEX}, x))) / len(t)) END AS score FROM t) "
    "SELECT conv_id, turn, round(score, 6) AS score, CASE WHEN round(score, 10) >= 0.5::DOUBLE THEN 'large' ELSE 'small' END AS model, round(least(1::DOUBLE, abs(score - 0.5::DOUBLE) * 2), 6) AS confidence FROM s"
)
def heuristic_route(spark, sf_dir):
    t = _talk(spark, sf_dir).select("conv_id", "turn", routing.heuristic_score("text").alias("s"))
    model, _ = routing.decide(F.round("s", 10), 0.5, "large", "small")
    return t.select("conv_id", "turn", F.round("s", 6).alias("score"), model.alias("model"), F.round(routing.decide("s", 0.5, "large", "small")[1], 6).alias("confidence"))


@query(
    "WITH c AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE label < 2) GROUP BY 1, 2), m AS (SELECT list(x ORDER BY pos) FILTER (label = 1) AS c, list(x ORDER BY pos) FILTER (label = 0) AS s FROM c), "
    "k AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], c) AS c, list_cosine_similarity(embedding::DOUBLE[], s) AS s FROM embeddings, m) SELECT vec_id, round(CASE WHEN c + s <= 1.1920929e-7::DOUBLE THEN 0.5::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, c / (c + s))) END, 6) AS score FROM k"
)
def embedding_route(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    m = routing.mean_vector(e.where("label < 2"), "label").agg(F.max(F.when(F.col("label") == 1, F.col("centroid"))).alias("c"), F.max(F.when(F.col("label") == 0, F.col("centroid"))).alias("s"))
    j = e.crossJoin(F.broadcast(m))  # two vectors
    return j.select("vec_id", F.round(routing.embedding_score("embedding", F.col("c"), F.col("s")), 6).alias("score"))


_MODEL = "CASE role WHEN 'user' THEN 'gpt-4o' WHEN 'assistant' THEN 'some-opus' ELSE 'tiny-nano' END"
_PRICE = "CASE role WHEN 'user' THEN 0.5::DOUBLE WHEN 'assistant' THEN 1.25::DOUBLE ELSE 0.05::DOUBLE END"


def _costed(spark, sf_dir) -> DataFrame:
    model = F.when(F.col("role") == "user", "gpt-4o").when(F.col("role") == "assistant", "some-opus").otherwise("tiny-nano")
    t = _talk(spark, sf_dir).select("conv_id", "turn", model.alias("model"), count_tokens("text").alias("tokens"), routing.decide(routing.heuristic_score("text"), 0.5, "a", "b")[1].alias("confidence"))
    return t.withColumn("estimated_cost", routing.estimated_cost("model", "tokens"))


@query(f"SELECT conv_id, turn, {_MODEL} AS model, round({_TOKENS} / 1000 * {_PRICE}, 8) AS cost FROM conversations")
def model_cost(spark, sf_dir):
    return _costed(spark, sf_dir).select("conv_id", "turn", "model", F.round("estimated_cost", 8).alias("cost"))


@query(f"SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, round(avg(nullif({_TOKENS}, 0) / 1000 * {_PRICE}), 8) AS avg_cost FROM conversations GROUP BY 1")
def routing_summary(spark, sf_dir):
    s = routing.routing_summary(_costed(spark, sf_dir), ["conv_id"])
    return s.select("conv_id", "n", F.coalesce(F.col("models")["gpt-4o"], F.lit(0)).alias("n_user"), F.round("avg_cost", 8).alias("avg_cost"))


@query("SELECT l_linenumber, round(1 - (a * a + b * b), 6) AS gini FROM (SELECT l_linenumber, avg((l_returnflag = 'R')::INTEGER) AS a, avg((l_returnflag <> 'R')::INTEGER) AS b FROM lineitem GROUP BY 1)")
def gini_impurity(spark, sf_dir):
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    g = load(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(n(F.col("l_returnflag") == "R").alias("a"), n(F.col("l_returnflag") != "R").alias("b"))
    return g.select("l_linenumber", F.round(routing.gini("a", "b"), 6).alias("gini"))


@query("""
WITH c AS (SELECT pos::INTEGER AS feature, x, sum((label <> 0)::INTEGER)::DOUBLE AS b, sum((label = 0)::INTEGER)::DOUBLE AS a FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2),
r AS (SELECT feature, x, lead(x) OVER o AS nx, sum(a) OVER o AS la, sum(b) OVER o AS lb, sum(a) OVER w AS ta, sum(b) OVER w AS tb FROM c WINDOW w AS (PARTITION BY feature), o AS (PARTITION BY feature ORDER BY x)),
g AS (SELECT feature, (x + nx) / 2 AS threshold, 1 - (ta / (ta + tb)) ** 2 - (tb / (ta + tb)) ** 2 - (la + lb) / (ta + tb) * (1 - (la / (la + lb)) ** 2 - (lb / (la + lb)) ** 2) - (ta + tb - la - lb) / (ta + tb) * (1 - ((ta - la) / (ta + tb - la - lb)) ** 2 - ((tb - lb) / (ta + tb - la - lb)) ** 2) AS gain FROM r WHERE nx IS NOT NULL)
SELECT feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 10) DESC, threshold) AS n FROM g WHERE gain > 1.1920929e-7::DOUBLE) WHERE n = 1
""")
def best_splits(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"), (F.col("label") != 0).cast("int").alias("label"))
    return routing.best_splits(e).select("feature", F.round("threshold", 6).alias("threshold"), F.round("gain", 6).alias("gain"))


@query()
def forest_route(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    model = routing.train_forest(e.select("embedding", (F.col("label") != 0).cast("int").alias("label")), "embedding", trees=20, depth=10)
    scored = routing.forest_score(e, model)
    return scored.select("vec_id", F.round("score", 6).alias("score"), routing.decide("score", 0.5, "a", "b")[0].alias("model"))


# --- prompts and agents ----------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT text AS i, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations) SELECT prompt, avg(CASE WHEN e IS NOT NULL THEN contains(lower(i), w)::INTEGER END)::DOUBLE AS score FROM s, (VALUES ('find the', 'the'), ('find la', 'la'), ('find zzzz', 'zzzz')) p(prompt, w) GROUP BY 1")
def score_prompts(spark, sf_dir):
    """A stand-in for a model: it answers with the prompt's last word, if the input holds it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    samples = _talk(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.col("text").alias("input"), F.lead("text").over(w).alias("expected"))
    prompts = spark.createDataFrame([(0, "find the"), (1, "find la"), (2, "find zzzz")], "prompt_id int, prompt string")

    def model(full):
        first = F.split(full, "\n\n", 2)
        return F.contains(F.lower(first[1]), F.element_at(F.split(first[0], " "), -1)).cast("string")

    return tuning.score_prompts(prompts, samples, model, lambda out, e: F.when(e.isNotNull(), (out == "true").cast("double"))).select("prompt", "score")


@query()
def demo_sets(spark, sf_dir):
    samples = _talk(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.col("text").alias("input"), F.lit(None).cast("string").alias("expected"))
    return tuning.demo_sets(samples, 3, 5, 42).select("demo_set", "rank", "sample_id")


@query(f"SELECT conv_id, turn, used, greatest(0, 60 - used)::BIGINT AS remaining, used > 60 AS exceeded FROM (SELECT conv_id, turn, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM conversations)")
def token_budget(spark, sf_dir):
    t = _talk(spark, sf_dir).select("conv_id", "turn", count_tokens("text").alias("tokens"))
    return agents.token_budget(t, 60).select("conv_id", "turn", "used", "remaining", "exceeded")


@query(f"SELECT conv_id, turn, coalesce(role = 'assistant' AND total >= 60 AND back > 1, false) AS condensed FROM (SELECT *, sum({_TOKENS}) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) AS back FROM conversations)")
def condense_tools(spark, sf_dir):
    t = _talk(spark, sf_dir).select("conv_id", "turn", "role", "text", count_tokens("text").alias("tokens"))
    return agents.condense(t, 60, 1, tool_role="assistant").select("conv_id", "turn", "condensed")


@query("""
WITH c AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'read_file' WHEN 'signup' THEN 'read_image' WHEN 'purchase' THEN 'write_file' WHEN 'error' THEN 'apply_patch' ELSE 'run_shell' END AS tool, '/f' || props AS path, value >= 10 AS ok FROM events),
w AS (SELECT event_id, tool, path, coalesce(max((tool IN ('read_file', 'read_image') AND ok)::INTEGER) OVER f, 0) AS seen, coalesce(max((tool = 'run_shell' AND ok)::INTEGER) OVER s, 0) AS ran FROM c WINDOW f AS (PARTITION BY user_id, path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY user_id, path, tool = 'run_shell' ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN tool IN ('write_file', 'apply_patch') AND seen = 0 THEN 'write-before-read blocked for ' || path WHEN tool = 'run_shell' AND ran = 1 THEN 'repeated run_shell blocked for cat ' || path END AS blocked FROM w
""")
def agent_policy(spark, sf_dir):
    kind = F.col("event_type")
    tool = F.when(kind == "click", "read_file").when(kind == "signup", "read_image").when(kind == "purchase", "write_file").when(kind == "error", "apply_patch").otherwise("run_shell")
    path = F.concat(F.lit("/f"), "props")
    calls = _events(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.lit(None).cast("long").alias("ended"), tool.alias("tool"), path.alias("path"), F.concat(F.lit(" cat "), path).alias("command"), (F.col("value") >= 10).alias("ok"))
    return agents.policy(calls).select(F.col("seq").alias("event_id"), "blocked")
