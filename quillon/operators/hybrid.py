"""Hybrid search: BM25 and vector candidates, fused, cut, with confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import bm25, fusion, vectors
from quillon.sources.errors import ConfigurationError


@dataclass(frozen=True)
class HybridConfig:
    method: str = "rrf"
    normalisation: str = "min_max"
    bm25_weight: float = 0.5
    vector_weight: float = 0.5
    rrf_k: float = 60.0
    bm25_candidates: int = 200
    vector_candidates: int = 200
    min_similarity: float | None = None

    def __post_init__(self):
        if self.method not in ("rrf", "linear"):
            raise ConfigurationError("method must be rrf or linear")
        if not (0 <= self.bm25_weight <= 1 and 0 <= self.vector_weight <= 1) or self.rrf_k <= 0 or self.bm25_candidates < 1 or self.vector_candidates < 1:
            raise ConfigurationError("weights must be in [0, 1], rrf_k and the numbers of candidates positive")


def hybrid_search(index: bm25.Bm25Index, vector_table: DataFrame, queries: DataFrame, query_vectors: DataFrame, config: HybridConfig = HybridConfig(), limit: int = 20, with_confidence: bool = True) -> DataFrame:
    """queries(query_id, ns, query) and query_vectors(query_id, ns, embedding) to ranked (query_id, id, bm25, vector, hybrid, ...)."""
    lexical = bm25.search(index, queries, config.bm25_candidates, details=False).select("query_id", "id", "score", "rank")
    semantic = vectors.nearest_neighbors(vector_table, query_vectors, config.vector_candidates, config.min_similarity).select("query_id", "id", F.col("similarity").alias("score"), "rank")
    if config.method == "rrf":
        fused = fusion.rrf(lexical, semantic, config.rrf_k, config.bm25_weight, config.vector_weight)
    else:
        fused = fusion.linear(lexical, semantic, config.normalisation, config.bm25_weight, config.vector_weight)
    best = fusion.top(fused, limit)
    return fusion.confidence(best, config.method) if with_confidence else best
