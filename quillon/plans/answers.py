"""Queries over texts: chunks, context filters, evaluation, query gaps, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import GAP_STOP_WORDS
from quillon.operators import answers, chunking, diffs
from quillon.plans.registry import query
from quillon.sources.tables import load

SPACE = "[ \\t\\n\\f\\r]"
_TOKENS = f"len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> ''))"


def _texts(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query('SELECT doc_id AS id, i::INTEGER AS index, md5(substr(text, i * 900 + 1, 1000)) AS content, i * 900 AS start, least(i * 900 + 1000, length(text)) AS "end" FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 899) // 900)) AS i FROM documents)')
def fixed_chunks(spark, sf_dir):
    c = chunking.fixed_length(_texts(spark, sf_dir), 1000, 100)
    return c.select("id", "index", F.md5("content").alias("content"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"SELECT id, i::INTEGER AS index, i * 150 AS first, least(n - i * 150, 200) AS n_tokens FROM (SELECT id, n, unnest(range(0, (n + 149) // 150)) AS i FROM (SELECT doc_id AS id, {_TOKENS} AS n FROM documents))")
def token_windows(spark, sf_dir):
    return chunking.token_windows(_texts(spark, sf_dir), 200, 50)


@query(
    f"WITH p AS (SELECT doc_id AS id, regexp_extract_all(text, '[^ \\t\\n\\f\\r]+{SPACE}*') AS p, length(regexp_extract(text, '^{SPACE}*')) AS lead FROM documents), w AS (SELECT *, unnest(range(0, (len(p) + 199) // 200)) AS i FROM p) "
    f"SELECT id, i::INTEGER AS index, md5(regexp_replace(array_to_string(p[i * 200 + 1 : i * 200 + 200], ''), '{SPACE}+$', '')) AS content, lead + CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(p[1 : i * 200], '')) END AS start FROM w"
)
def token_chunks(spark, sf_dir):
    return chunking.token_count(_texts(spark, sf_dir), 200).select("id", "index", F.md5("content").alias("content"), "start")


@query()
def sentence_chunks(spark, sf_dir):
    return chunking.sentence_token(_texts(spark, sf_dir))


@query()
def parent_child_chunks(spark, sf_dir):
    return chunking.parent_child(_texts(spark, sf_dir))


def _contexts(spark, sf_dir) -> DataFrame:
    score = F.when(F.col("role") != "system", F.pmod(F.length("text"), F.lit(10)) / 10.0)
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("content"), score.alias("score"), F.lit(None).cast("double").alias("retrieval_score"))


FILTERS = [("min_score", lambda c: answers.min_score(c, 0.3)), ("deduplicate", answers.deduplicate), ("truncate", lambda c: answers.truncate(c, 3))]
_FILTERED = """
c AS (SELECT conv_id AS query_id, turn AS rank, text AS content, CASE WHEN role <> 'system' THEN (length(text) % 10) / 10.0::DOUBLE END AS score FROM conversations),
f1 AS (SELECT * FROM c WHERE score IS NULL OR score >= 0.3::DOUBLE), f2 AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY rank) = 1),
f3 AS (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3)
"""


@query(
    f"WITH {_FILTERED}, q AS (SELECT DISTINCT query_id FROM c), n AS (SELECT 0 AS s, query_id FROM c UNION ALL SELECT 1, query_id FROM f1 UNION ALL SELECT 2, query_id FROM f2 UNION ALL SELECT 3, query_id FROM f3), "
    "k AS (SELECT q.query_id, s.s, count(n.query_id) AS n FROM q CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS s) s LEFT JOIN n ON n.query_id = q.query_id AND n.s = s.s GROUP BY 1, 2) "
    "SELECT a.query_id, a.s AS step, (['min_score', 'deduplicate', 'truncate'])[a.s + 1] AS filter, a.n AS before, b.n AS after FROM k a JOIN k b ON a.query_id = b.query_id AND b.s = a.s + 1"
)
def audit_filters(spark, sf_dir):
    return answers.run_filters(_contexts(spark, sf_dir), FILTERS)[1]


@query(f"WITH {_FILTERED} SELECT query_id, sum({_TOKENS.replace('text', 'content')})::BIGINT AS token_count FROM f3 GROUP BY 1")
def filtered_contexts(spark, sf_dir):
    return answers.token_counts(answers.run_filters(_contexts(spark, sf_dir), FILTERS)[0])


def _samples(spark, sf_dir) -> DataFrame:
    """Clauses as what was retrieved, sentences as what is true."""
    c = load(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.split("text", ", ").alias("retrieved"), F.split("text", "\\. ").alias("truth"))


_SCORES = """
s AS (SELECT conv_id * 1000 + turn AS sample_id, string_split(text, ', ') AS r, string_split(text, '. ') AS t FROM conversations),
e AS (SELECT sample_id, len(list_filter(r, lambda x: len(list_filter(t, lambda y: contains(x, y) OR contains(y, x))) > 0)) / len(r) AS p, len(list_filter(t, lambda x: len(list_filter(r, lambda y: contains(x, y) OR contains(y, x))) > 0)) / len(t) AS c FROM s)
"""


def _scores(spark, sf_dir) -> DataFrame:
    return answers.evaluate(_samples(spark, sf_dir), {"context_precision": answers.context_precision(), "context_recall": answers.context_recall(), "faithfulness": answers.needs_judge()})


@query(f"WITH {_SCORES}, l AS (SELECT 'context_precision' AS metric, p AS v FROM e UNION ALL SELECT 'context_recall', c FROM e UNION ALL SELECT 'faithfulness', NULL FROM e) SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS stddev FROM l GROUP BY 1")
def eval_summary(spark, sf_dir):
    return answers.summarise(_scores(spark, sf_dir)).select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stddev")])


@query(f"WITH {_SCORES} SELECT sample_id, round((p + 2 * c) / 3, 6) AS overall FROM e")
def eval_overall(spark, sf_dir):
    return answers.overall_scores(_scores(spark, sf_dir), {"context_recall": 2.0}).select("sample_id", F.round("overall", 6).alias("overall"))


def observations(events: DataFrame) -> DataFrame:
    """Events as queries and how similar the best thing found was; errors found nothing."""
    return events.select(F.concat(F.lit("How to "), "event_type", F.lit(" the "), "props").alias("query"), F.when(F.col("event_type") != "error", F.col("value") / 50).alias("max_similarity"))


GAPS_SQL = (
    "WITH p AS (SELECT array_to_string(list_filter(regexp_split_to_array(lower('How to ' || event_type || ' the ' || props), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains(['" + "','".join(GAP_STOP_WORDS) + "'], t)), ' ') AS pattern, CASE WHEN event_type <> 'error' THEN value / 50 END AS s FROM events) "
    "SELECT pattern, count(*) AS misses, round(avg(s), 6) AS avg_similarity FROM p WHERE s IS NULL OR s < 0.45::DOUBLE GROUP BY 1"
)


@query(GAPS_SQL)
def query_gaps(spark, sf_dir):
    g = answers.query_gaps(observations(load(spark, sf_dir, "events")))
    return g.select("pattern", "misses", F.round("avg_similarity", 6).alias("avg_similarity"))


@query(f"SELECT pattern, misses FROM ({GAPS_SQL}) ORDER BY misses DESC, pattern LIMIT 10")
def most_missed(spark, sf_dir):
    return answers.most_missed(query_gaps(spark, sf_dir), 10).select("pattern", "misses")


@query()
def diff_snippets(spark, sf_dir):
    """Each turn against the one before it."""
    c = load(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", F.lag("text").over(w).alias("previous"), F.col("text").alias("current"))
    return diffs.focused_pairs(pairs).select("conv_id", "turn", "previous_snippet", "current_snippet")


@query()
def stitched_snippets(spark, sf_dir):
    """Each turn against its text without the first word, with its neighbours where that touches a border."""
    c = load(spark, sf_dir, "conversations")
    units = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), F.col("turn").alias("position"), "text")
    changed = units.withColumn("text", F.regexp_replace("text", "^[^ ]+ ", ""))
    pairs = units.select("doc", F.col("id").alias("previous_id"), F.col("id").alias("current_id"))
    return diffs.stitched_pairs(units, changed, pairs).select("doc", "previous_id", "previous_snippet", "current_snippet", "stitched", "previous_ids")
