"""Rank fusion: two ranked lists a query, joined into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.errors import ConfigurationError

#: Ranges and deviations under this count as none.
FLAT = 1.1920929e-7


def _ranked(side: DataFrame, name: str) -> DataFrame:
    """(query_id, id, <name>, <name>_rank) of side(query_id, id, score[, rank])."""
    if "rank" not in side.columns:
        side = side.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return side.select("query_id", "id", F.col("score").alias(name), F.col("rank").alias(f"{name}_rank"))


def min_max(x: Column, by: Window) -> Column:
    low, high = F.min(x).over(by), F.max(x).over(by)
    return F.when(x.isNull(), None).when(high - low < FLAT, 0.0).otherwise((x - low) / (high - low))


def z_score(x: Column, by: Window) -> Column:
    mean, dev = F.avg(x).over(by), F.stddev_pop(x).over(by)
    return F.when(x.isNull(), None).when(dev < FLAT, 0.0).otherwise((x - mean) / dev)


def rrf(bm25: DataFrame, vector: DataFrame, k: float = 60.0, bm25_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """(query_id, id, bm25, vector, hybrid): weight / (k + rank), summed over the lists that have the id; ranks count from 1."""
    both = _ranked(bm25, "bm25").join(_ranked(vector, "vector"), ["query_id", "id"], "full")
    part = lambda rank, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    return both.select("query_id", "id", "bm25", "vector", (part("bm25_rank", bm25_weight) + part("vector_rank", vector_weight)).alias("hybrid"))


def linear(bm25: DataFrame, vector: DataFrame, normalisation: str = "min_max", bm25_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """(query_id, id, bm25, vector, hybrid): the weighted sum of normalised scores; a list that lacks the id adds 0."""
    how = {"min_max": min_max, "z_score": z_score, "none": lambda x, by: x}
    if normalisation not in how:
        raise ConfigurationError(f"normalisation must be one of {sorted(how)}")
    by = Window.partitionBy("query_id")
    left = _ranked(bm25, "bm25").withColumn("b", how[normalisation](F.col("bm25"), by))
    right = _ranked(vector, "vector").withColumn("v", how[normalisation](F.col("vector"), by))
    both = left.join(right, ["query_id", "id"], "full")
    return both.select("query_id", "id", "bm25", "vector", (F.coalesce(F.lit(bm25_weight) * F.col("b"), F.lit(0.0)) + F.coalesce(F.lit(vector_weight) * F.col("v"), F.lit(0.0))).alias("hybrid"))


def top(fused: DataFrame, limit: int = 20) -> DataFrame:
    """The best of each query by score to 10 places, then id, with their rank."""
    fused = fused.withColumn("hybrid", F.round("hybrid", 10))
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def confidence(ranked: DataFrame, label: str = "rrf") -> DataFrame:
    """ranked(query_id, rank, bm25, vector, hybrid) with percentile, margin, agreement, confidence and fusion_path, over what was returned."""
    by = Window.partitionBy("query_id")
    low, high = F.min("hybrid").over(by), F.max("hybrid").over(by)
    width = F.when(high - low < FLAT, 1.0).otherwise(high - low)
    percentile = (F.col("hybrid") - low) / width
    following = F.lead("hybrid").over(by.orderBy("rank"))
    out = ranked.withColumn("percentile", percentile)
    margin = F.when(following.isNull(), F.col("percentile")).otherwise((F.col("hybrid") - following) / width)
    out = out.withColumn("margin", margin).withColumn("agreement", F.when(F.col("bm25").isNotNull() & F.col("vector").isNotNull(), 1.0).otherwise(0.5))
    out = out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("percentile") * 0.6 + F.col("margin") * 0.3 + F.col("agreement") * 0.1)))
    return out.withColumn("fusion_path", F.format_string(f"{label} [confidence=%.3f]", "confidence"))
