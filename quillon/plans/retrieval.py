"""Queries over text and vectors: tokens, BM25, nearest neighbours, fusion, hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text, vectors as vec
from quillon.operators import bm25, fusion, hybrid, vectors
from quillon.plans.registry import query
from quillon.sources import tables

STOP = "['" + "','".join(text.STOP_WORDS) + "']"
TOKENS = f"list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9]+'), lambda t: length(t) BETWEEN 2 AND 50 AND NOT list_contains({STOP}, t))"
BM25_CTE = f"""
docs AS (SELECT doc_id AS id, 'text' AS field, text FROM documents),
tok AS (SELECT id, field, unnest({TOKENS.format("text")}) AS term FROM docs), tf AS (SELECT id, field, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT id, field, len({TOKENS.format("text")}) AS len FROM docs), corpus AS (SELECT field, count(*) AS n, avg(len)::DOUBLE AS avgdl FROM len GROUP BY 1),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark),
parts AS (SELECT query_id, id, field, term, greatest(0::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS part
  FROM q JOIN tf USING (term) JOIN df USING (field, term) JOIN len USING (id, field) JOIN corpus USING (field)),
scored AS (SELECT query_id, id, round(sum(part), 10) AS score, list_sort(list(DISTINCT term)) AS matched_terms FROM parts GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0)
"""
PAGES_CTE = BM25_CTE.replace("SELECT doc_id AS id, 'text' AS field, text FROM documents", "SELECT page_id AS id, 'title' AS field, regexp_extract(html, '<title>([^<]*)</title>', 1) AS text FROM pages UNION ALL SELECT page_id, 'url', url FROM pages")
SIM = "greatest(0::DOUBLE, least(1::DOUBLE, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
KNN_CTE = f"""
sims AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({SIM}, 10) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims)
"""


#: The same with those as queries whose ids are divisible by 100, and with every vector.
KNN_100_CTE = KNN_CTE.replace("q.vec_id IN (SELECT item_id FROM benchmark)", "q.vec_id % 100 = 0")
KNN_ALL_CTE = KNN_CTE.replace(" WHERE q.vec_id IN (SELECT item_id FROM benchmark)", "")


def _index(spark, sf_dir):
    return bm25.build_index(tables.text_documents(spark, sf_dir))


def _vector_queries(spark, sf_dir) -> DataFrame:
    """For hybrid search, which asks with a text and a vector: the vectors whose ids are those of the benchmark's items."""
    items = tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return tables.vectors(spark, sf_dir).join(items, "id", "left_semi").select(F.col("id").alias("query_id"), "ns", "embedding")


def _hundredths(spark, sf_dir) -> DataFrame:
    """The query set of vector searches: every vector whose id is divisible by 100, against all vectors."""
    return tables.vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), "ns", "embedding")


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n_spaced FROM (SELECT doc_id, text, {TOKENS.format('text')} AS t FROM documents)")
def tokenize_stats(spark, sf_dir):
    d = tables.load(spark, sf_dir, "documents").select("doc_id", "text", text.tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), text.count_tokens("text").alias("n_spaced"))


_STEM = "CASE " + " ".join(f"WHEN length(t) > {len(s)} AND ends_with(t, '{s}') THEN left(t, length(t) - {len(s)})" for s in text.SUFFIXES) + " ELSE t END"


@query(f"WITH t AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM documents), s AS (SELECT {_STEM} AS term FROM t WHERE length(t) BETWEEN 2 AND 50) SELECT term, count(*) AS n FROM s WHERE NOT list_contains({STOP}, term) GROUP BY 1")
def stemmed_terms(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select(F.explode(text.tokenize("text", stem=True)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BM25_CTE} SELECT field, n, avgdl, (SELECT sum(len)::BIGINT FROM len) AS total, (SELECT count(*) FROM df) AS n_terms FROM corpus")
def bm25_corpus_stats(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.corpus.join(i.frequencies.groupBy("field").agg(F.count(F.lit(1)).alias("n_terms")), "field").select("field", "n", "avgdl", "total", "n_terms")


@query(f"WITH {BM25_CTE} SELECT term, df, round(greatest(0::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)), 6) AS idf FROM df JOIN corpus USING (field)")
def bm25_idf(spark, sf_dir):
    i = _index(spark, sf_dir)
    j = i.frequencies.join(F.broadcast(i.corpus), ["ns", "field"])  # a row a field
    return j.select("term", "df", F.round(bm25.idf(F.col("n").cast("double"), F.col("df").cast("double")), 6).alias("idf"))


@query(f"WITH {BM25_CTE} SELECT query_id, id, round(score, 6) AS score, array_to_string(matched_terms, ' ') AS matched_terms, rank FROM ranked WHERE rank <= 20")
def bm25_search(spark, sf_dir):
    r = bm25.search(_index(spark, sf_dir), tables.benchmark_queries(spark, sf_dir))
    return r.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join("matched_terms", " ").alias("matched_terms"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25_CTE} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20 AND score >= 20")
def bm25_min_score(spark, sf_dir):
    r = bm25.search(_index(spark, sf_dir), tables.benchmark_queries(spark, sf_dir), min_score=20.0, details=False)
    return r.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PAGES_CTE}, f AS (SELECT query_id, id, field, sum(part) AS s FROM parts GROUP BY 1, 2, 3) SELECT query_id, id, round(score, 6) AS score, rank, round((SELECT s FROM f WHERE f.query_id = r.query_id AND f.id = r.id AND field = 'title'), 6) AS title_score, round((SELECT s FROM f WHERE f.query_id = r.query_id AND f.id = r.id AND field = 'url'), 6) AS url_score FROM ranked r WHERE rank <= 20")
def bm25_multi_field(spark, sf_dir):
    r = bm25.search(bm25.build_index(tables.page_documents(spark, sf_dir)), tables.benchmark_queries(spark, sf_dir))
    return r.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), *[F.round(F.element_at("field_scores", F.lit(f)), 6).alias(f"{f}_score") for f in ("title", "url")])


@query(f"WITH {PAGES_CTE.replace('FROM q JOIN tf USING (term)', 'FROM q JOIN (SELECT * FROM tf WHERE field = ' + chr(39) + 'title' + chr(39) + ') tf USING (term)')} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20")
def bm25_field_restricted(spark, sf_dir):
    r = bm25.search(bm25.build_index(tables.page_documents(spark, sf_dir)), tables.benchmark_queries(spark, sf_dir), fields=["title"])
    return r.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25_CTE.replace('FROM documents)', 'FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, ' + chr(39) + 'text' + chr(39) + ', text FROM benchmark)', 1)} SELECT field, n, avgdl, (SELECT sum(df)::BIGINT FROM df) AS postings, (SELECT count(*) FROM df) AS n_terms FROM corpus")
def bm25_upsert(spark, sf_dir):
    """The benchmark's texts take the place of the documents with their ids; what results is what indexing anew gives."""
    new = tables.load(spark, sf_dir, "benchmark").select(F.lit("default").alias("ns"), F.col("item_id").alias("id"), F.lit("text").alias("field"), "text")
    i = _index(spark, sf_dir).upsert(new)
    f = i.frequencies.groupBy("field").agg(F.sum("df").alias("postings"), F.count(F.lit(1)).alias("n_terms"))
    return i.corpus.join(f, "field").select("field", "n", "avgdl", "postings", "n_terms")


@query(f"WITH {BM25_CTE.replace('FROM documents)', 'FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark))', 1)} SELECT n, avgdl FROM corpus")
def bm25_remove(spark, sf_dir):
    gone = tables.load(spark, sf_dir, "benchmark").select(F.lit("default").alias("ns"), F.col("item_id").alias("id"))
    return _index(spark, sf_dir).remove(gone).corpus.select("n", "avgdl")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))), 6) AS unit_sum FROM embeddings")
def vec_norms(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return v.select(F.col("id").alias("vec_id"), F.round(vec.l2_norm("embedding"), 6).alias("norm"), F.round(F.aggregate(vec.normalize("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


@query("WITH c AS (SELECT label, list(m ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], m), 6) + 0 AS similarity, round(1 - list_cosine_similarity(embedding::DOUBLE[], m), 6) + 0 AS distance FROM embeddings JOIN c USING (label)")
def vec_cosine(spark, sf_dir):
    """Each vector against the centroid of its label."""
    v = tables.vectors(spark, sf_dir)
    j = v.join(vectors.centroids(v, "label"), "label")
    return j.select(F.col("id").alias("vec_id"), F.round(vec.cosine_similarity("embedding", "centroid"), 6).alias("similarity"), F.round(vec.cosine_distance("embedding", "centroid"), 6).alias("distance"))


_CENTROID = "m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM m)"


@query(f"WITH {_CENTROID} SELECT label, (pos - 1)::INTEGER AS pos, round(x, 6) AS x FROM c")
def vec_centroid(spark, sf_dir):
    return vectors.centroids(tables.vectors(spark, sf_dir), "label").select("label", F.posexplode(F.transform("centroid", lambda x: F.round(x, 6))).alias("pos", "x"))


@query(f"WITH {_CENTROID}, l AS (SELECT label, list(x ORDER BY pos) AS c FROM c GROUP BY 1) SELECT label, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE avg(1 - list_cosine_similarity(embedding::DOUBLE[], c)) END, 6) AS variance FROM embeddings JOIN l USING (label) GROUP BY 1")
def vec_variance(spark, sf_dir):
    return vectors.variance(tables.vectors(spark, sf_dir), "label").select("label", "n", F.round("variance", 6).alias("variance"))


@query(f"WITH {KNN_100_CTE} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM near WHERE rank <= 20")
def knn(spark, sf_dir):
    r = vectors.nearest_neighbors(tables.vectors(spark, sf_dir), _hundredths(spark, sf_dir))
    return r.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _all_near(spark, sf_dir) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    return vectors.nearest_neighbors(v, v.select(F.col("id").alias("query_id"), "ns", "embedding"))


@query(f"WITH {KNN_ALL_CTE} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM near WHERE rank <= 20")
def knn_all(spark, sf_dir):
    """knn with every vector as a query."""
    return _all_near(spark, sf_dir).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({SIM}, 10) AS similarity FROM embeddings q, embeddings v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5")
def knn_batch(spark, sf_dir):
    """Every vector asks."""
    v = tables.vectors(spark, sf_dir)
    r = vectors.nearest_neighbors(v, v.select(F.col("id").alias("query_id"), "ns", "embedding"), limit=5)
    return r.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({SIM}, 10) AS similarity FROM embeddings q, embeddings v WHERE v.label = 3 AND list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 20")
def knn_filtered(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    r = vectors.nearest_neighbors(v, v.select(F.col("id").alias("query_id"), "ns", "embedding"), min_similarity=0.1, where=vectors.metadata_filter({"label": 3}))
    return r.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE label = 7 GROUP BY 1")
def vec_metadata_filter(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return v.where(vectors.metadata_filter({"label": 7})).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT item_id AS id, text FROM benchmark), b AS (SELECT vec_id AS id, label FROM embeddings) SELECT (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM n)) + (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM b JOIN n USING (id)) AS replaced")
def vec_upsert(spark, sf_dir):
    v = tables.vectors(spark, sf_dir).drop("label")
    new = tables.load(spark, sf_dir, "benchmark").select(F.lit("default").alias("ns"), F.col("item_id").alias("id"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding"), F.lit('{"new":true}').alias("metadata"))
    out = vectors.upsert(v, new, dimension=64)
    return out.agg(F.count(F.lit(1)).alias("n")).crossJoin(v.join(new.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("replaced")))


@query("SELECT count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)")
def vec_delete(spark, sf_dir):
    gone = tables.load(spark, sf_dir, "benchmark").select(F.lit("default").alias("ns"), F.col("item_id").alias("id"))
    return vectors.count(vectors.delete(tables.vectors(spark, sf_dir), gone), "default")


@query("WITH f AS (SELECT * FROM embeddings WHERE label = 2), p AS (SELECT vec_id FROM f WHERE vec_id > 100 ORDER BY 1 LIMIT 10) SELECT vec_id AS id, (SELECT count(*) FROM f) AS total, CASE WHEN (SELECT count(*) FROM f WHERE vec_id > 100) > 10 THEN (SELECT max(vec_id) FROM p) END AS next_cursor FROM p")
def keyset_page(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return vectors.list_page(v, "default", 10, 100, vectors.metadata_filter({"label": 2})).select("id", "total", "next_cursor")


@query(f"WITH {KNN_100_CTE}, s AS (SELECT query_id, similarity AS s FROM near WHERE rank <= 20), t AS (SELECT query_id, s, sum(s) OVER (PARTITION BY query_id) AS t FROM s) SELECT query_id, count(*) AS n, round(avg(-ln(greatest(1e-9::DOUBLE, least(1::DOUBLE, s)))), 6) + 0 AS mean_surprisal, round(sum(CASE WHEN t >= 1e-9 AND s > 0 THEN -s / t * ln(s / t) ELSE 0 END), 6) AS entropy FROM t GROUP BY 1")
def result_entropy(spark, sf_dir):
    r = vectors.nearest_neighbors(tables.vectors(spark, sf_dir), _hundredths(spark, sf_dir))
    return vectors.result_statistics(r).select("query_id", "n", F.round("mean_surprisal", 6).alias("mean_surprisal"), F.round("entropy", 6).alias("entropy"))


@query(f"WITH {KNN_100_CTE}, s AS (SELECT query_id, similarity AS s FROM near WHERE rank <= 20), t AS (SELECT query_id, s, sum(s) OVER (PARTITION BY query_id) AS t FROM s), h AS (SELECT query_id, count(*) AS n, sum(CASE WHEN t >= 1e-9 AND s > 0 THEN -s / t * ln(s / t) ELSE 0 END) AS h FROM t GROUP BY 1) SELECT query_id, round(greatest(0::DOUBLE, least(1::DOUBLE, h * greatest(0::DOUBLE, least(2::DOUBLE, ln(1 + n) / ln(1 + greatest(500, 1)::DOUBLE))))), 6) AS gain FROM h")
def info_gain(spark, sf_dir):
    r = vectors.nearest_neighbors(tables.vectors(spark, sf_dir), _hundredths(spark, sf_dir))
    return vectors.result_statistics(r).select("query_id", F.round(vec.expected_information_gain("entropy", "n", F.lit(500)), 6).alias("gain"))


_STATS_ALL = f"WITH {KNN_ALL_CTE}, s AS (SELECT query_id, similarity AS s FROM near WHERE rank <= 20), t AS (SELECT query_id, s, sum(s) OVER (PARTITION BY query_id) AS t FROM s), h AS (SELECT query_id, count(*) AS n, avg(-ln(greatest(1e-9::DOUBLE, least(1::DOUBLE, s)))) AS m, sum(CASE WHEN t >= 1e-9 AND s > 0 THEN -s / t * ln(s / t) ELSE 0 END) AS h FROM t GROUP BY 1)"


@query(f"{_STATS_ALL} SELECT query_id, n, round(m, 6) + 0 AS mean_surprisal, round(h, 6) AS entropy FROM h")
def result_entropy_all(spark, sf_dir):
    """result_entropy with every vector as a query."""
    return vectors.result_statistics(_all_near(spark, sf_dir)).select("query_id", "n", F.round("mean_surprisal", 6).alias("mean_surprisal"), F.round("entropy", 6).alias("entropy"))


@query(f"{_STATS_ALL} SELECT query_id, round(greatest(0::DOUBLE, least(1::DOUBLE, h * greatest(0::DOUBLE, least(2::DOUBLE, ln(1 + n) / ln(1 + greatest(500, 1)::DOUBLE))))), 6) AS gain FROM h")
def info_gain_all(spark, sf_dir):
    """info_gain with every vector as a query."""
    return vectors.result_statistics(_all_near(spark, sf_dir)).select("query_id", F.round(vec.expected_information_gain("entropy", "n", F.lit(500)), 6).alias("gain"))


_LISTS = f"{BM25_CTE}, {KNN_CTE}, b AS (SELECT query_id, id, score, rank FROM ranked WHERE rank <= 200), v AS (SELECT query_id, id, similarity, rank FROM near WHERE rank <= 200)"
_RRF = f"{_LISTS}, f AS (SELECT query_id, id, b.score AS bm25, v.similarity AS vector, round(coalesce(0.5::DOUBLE / (60 + b.rank), 0) + coalesce(0.5::DOUBLE / (60 + v.rank), 0), 10) AS hybrid FROM b FULL JOIN v USING (query_id, id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, id) AS rank FROM f), top AS (SELECT * FROM r WHERE rank <= 20)"


def _lists(spark, sf_dir):
    b = bm25.search(_index(spark, sf_dir), tables.benchmark_queries(spark, sf_dir), limit=200, details=False).select("query_id", "id", "score", "rank")
    v = vectors.nearest_neighbors(tables.vectors(spark, sf_dir), _vector_queries(spark, sf_dir), limit=200).select("query_id", "id", F.col("similarity").alias("score"), "rank")
    return b, v


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select("query_id", "id", F.col("rank").cast("long").alias("rank"), *[F.round(n, 6).alias(n) for n in names])


@query(f"WITH {_RRF} SELECT query_id, id, rank, round(bm25, 6) AS bm25, round(vector, 6) AS vector, round(hybrid, 6) AS hybrid FROM top")
def rrf_hybrid(spark, sf_dir):
    return _rounded(fusion.top(fusion.rrf(*_lists(spark, sf_dir))), "bm25", "vector", "hybrid")


def _linear_sql(b: str, v: str) -> str:
    return f"WITH {_LISTS}, nb AS (SELECT query_id, id, {b} AS x FROM b), nv AS (SELECT query_id, id, {v} AS x FROM v), f AS (SELECT query_id, id, round(coalesce(0.5::DOUBLE * nb.x, 0) + coalesce(0.5::DOUBLE * nv.x, 0), 10) AS hybrid FROM nb FULL JOIN nv USING (query_id, id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, id) AS rank FROM f) SELECT query_id, id, rank, round(hybrid, 6) + 0 AS hybrid FROM r WHERE rank <= 20"


_W = "OVER (PARTITION BY query_id)"
_MM = f"CASE WHEN max({{0}}) {_W} - min({{0}}) {_W} < 1.1920929e-7 THEN 0 ELSE ({{0}} - min({{0}}) {_W}) / (max({{0}}) {_W} - min({{0}}) {_W}) END"
_ZS = f"CASE WHEN stddev_pop({{0}}) {_W} < 1.1920929e-7 THEN 0 ELSE ({{0}} - avg({{0}}) {_W}) / stddev_pop({{0}}) {_W} END"


@query(_linear_sql(_MM.format("score"), _MM.format("similarity")))
def linear_minmax(spark, sf_dir):
    return _rounded(fusion.top(fusion.linear(*_lists(spark, sf_dir))), "hybrid")


@query(_linear_sql(_ZS.format("score"), _ZS.format("similarity")))
def linear_zscore(spark, sf_dir):
    return _rounded(fusion.top(fusion.linear(*_lists(spark, sf_dir), normalisation="z_score")), "hybrid")


@query(_linear_sql("score", "similarity"))
def linear_none(spark, sf_dir):
    return _rounded(fusion.top(fusion.linear(*_lists(spark, sf_dir), normalisation="none")), "hybrid")


@query(f"WITH {_RRF}, c AS (SELECT *, min(hybrid) {_W} AS lo, max(hybrid) {_W} AS hi, lead(hybrid) OVER (PARTITION BY query_id ORDER BY rank) AS nx FROM top), p AS (SELECT *, CASE WHEN hi - lo < 1.1920929e-7 THEN 1 ELSE hi - lo END AS w FROM c), m AS (SELECT query_id, id, rank, (hybrid - lo) / w AS percentile, CASE WHEN nx IS NULL THEN (hybrid - lo) / w ELSE (hybrid - nx) / w END AS margin, CASE WHEN bm25 IS NOT NULL AND vector IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS agreement, hybrid FROM p) SELECT query_id, id, rank, round(hybrid, 6) AS hybrid, round(percentile, 6) AS percentile, round(margin, 6) AS margin, agreement, round(greatest(0::DOUBLE, least(1::DOUBLE, 0.6::DOUBLE * percentile + 0.3::DOUBLE * margin + 0.1::DOUBLE * agreement)), 6) AS confidence FROM m")
def hybrid_search(spark, sf_dir):
    """The flagship: every benchmark item by text and by vector, fused, with confidence."""
    r = hybrid.hybrid_search(_index(spark, sf_dir), tables.vectors(spark, sf_dir), tables.benchmark_queries(spark, sf_dir), _vector_queries(spark, sf_dir))
    return _rounded(r, "hybrid", "percentile", "margin", "agreement", "confidence")
