"""What happens to retrieved contexts: filters with an audit, reranking, evaluation, and the queries that found too little."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import count_tokens, gap_pattern

MISS_THRESHOLD = 0.45


def effective_score() -> Column:
    return F.coalesce("score", "retrieval_score")


def min_score(contexts: DataFrame, least: float) -> DataFrame:
    """contexts(query_id, rank, content, score, retrieval_score, ...): without those under it; no score at all passes."""
    return contexts.where(effective_score().isNull() | (effective_score() >= least))


def deduplicate(contexts: DataFrame) -> DataFrame:
    """The first of equal contents of a query."""
    w = Window.partitionBy("query_id", "content").orderBy("rank")
    return contexts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def truncate(contexts: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    return contexts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def rerank(contexts: DataFrame, top_k: int, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The top_k contexts of each query, by `score` (which sets a score column) or as they are."""
    if score is not None:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
        contexts = score(contexts).withColumn("rank", F.row_number().over(w))
    return truncate(contexts, top_k)


def token_counts(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("query_id").agg(F.sum(count_tokens("content")).alias("token_count"))


def run_filters(contexts: DataFrame, filters: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """The contexts after all filters in order, and the audit (query_id, step, filter, before, after); a query that a filter empties stays in the audit."""
    every = contexts.select("query_id").distinct()
    count = lambda df: df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    sizes, now = [count(contexts)], contexts
    for _, f in filters:
        now = f(now)
        sizes.append(count(now))
    audit = None
    for i, (name, _) in enumerate(filters):
        step = every.join(sizes[i].withColumnRenamed("n", "before"), "query_id", "left").join(sizes[i + 1].withColumnRenamed("n", "after"), "query_id", "left")
        step = step.select("query_id", F.lit(i).alias("step"), F.lit(name).alias("filter"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
        audit = step if audit is None else audit.unionByName(step)
    return now, audit if audit is not None else every.select("query_id", F.lit(0).alias("step"), F.lit("").alias("filter"), F.lit(0).alias("before"), F.lit(0).alias("after")).where("false")


def _matches(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def context_precision(retrieved: Column | str = "retrieved", truth: Column | str = "truth") -> Column:
    """Share of retrieved texts that contain, or are contained in, a true one; 0 if nothing was retrieved."""
    r, t = (F.col(c) if isinstance(c, str) else c for c in (retrieved, truth))
    good = F.size(F.filter(r, lambda x: F.exists(t, lambda y: _matches(x, y))))
    return F.when(F.size(r) <= 0, 0.0).otherwise(good / F.size(r))


def context_recall(retrieved: Column | str = "retrieved", truth: Column | str = "truth") -> Column:
    """Share of true texts that are covered; 1 if there is none."""
    r, t = (F.col(c) if isinstance(c, str) else c for c in (retrieved, truth))
    found = F.size(F.filter(t, lambda x: F.exists(r, lambda y: _matches(x, y))))
    return F.when(F.size(t) <= 0, 1.0).otherwise(found / F.size(t))


def needs_judge() -> Column:
    """Faithfulness and relevance of an answer have no value until a judge is given."""
    return F.lit(None).cast("double")


def evaluate(samples: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """samples(sample_id, ...) as (sample_id, metric, score)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("score")) for k, v in metrics.items()])
    return samples.select("sample_id", F.inline(pairs))


def overall_scores(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(sample_id, overall): the weighted mean of the scores that aren't null, weight 1 where none is given; null if nothing has weight."""
    w = F.lit(1.0)
    for k, v in (weights or {}).items():
        w = F.when(F.col("metric") == k, F.lit(float(v))).otherwise(w)
    known = F.col("score").isNotNull()
    g = scores.groupBy("sample_id").agg(F.sum(F.when(known, F.col("score") * w)).alias("s"), F.sum(F.when(known, w)).alias("w"))
    return g.select("sample_id", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias("overall"))


def summarise(scores: DataFrame) -> DataFrame:
    """(metric, n, mean, median, stddev): of the scores that aren't null, the deviation of a whole population."""
    return scores.groupBy("metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.stddev_pop("score").alias("stddev"))


def missed(observations: DataFrame, threshold: float = MISS_THRESHOLD) -> DataFrame:
    """observations(query, max_similarity, ...) that found nothing similar enough (or nothing), with their pattern; empty queries are left out. Works on streams too."""
    p = observations.withColumn("pattern", gap_pattern("query"))
    return p.where(F.col("pattern").isNotNull() & (F.col("max_similarity").isNull() | (F.col("max_similarity") < threshold)))


def query_gaps(observations: DataFrame, threshold: float = MISS_THRESHOLD) -> DataFrame:
    """(pattern, misses, avg_similarity) of all patterns; ranks are most_missed()'s."""
    return missed(observations, threshold).groupBy("pattern").agg(F.count(F.lit(1)).alias("misses"), F.avg("max_similarity").alias("avg_similarity"))


def most_missed(gaps: DataFrame, limit: int = 10) -> DataFrame:
    return gaps.orderBy(F.desc("misses"), "pattern").limit(limit)
