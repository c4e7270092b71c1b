"""Which model a request goes to: rules, rotation, weights, embeddings, a forest; and what routing cost."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine_similarity, l2_norm
from quillon.sources.errors import ConfigurationError

#: Below this a norm or a sum of similarities counts as nothing.
FLAT = 1.1920929e-7
COMPLEX_WORDS = "compare analyze explain evaluate architecture tradeoff ambiguity causality derive implement refactor optimize critique synthesize".split()
PRICES = {1: 0.05, 2: 0.15, 3: 0.5, 4: 1.25, 5: 2.0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_route(content: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """The model of the first rule (pattern, model) that the content matches."""
    out = F.lit(default)
    for pattern, model in reversed(rules):
        out = F.when(_col(content).rlike(pattern), model).otherwise(out)
    return out


def round_robin(requests: DataFrame, models: list[str], order: str, by: str | None = None) -> DataFrame:
    """requests with `model`, in turn by `order`; turns are counted within `by`, if given, so that no task has all rows."""
    if not models:
        raise ConfigurationError("there must be a model")
    w = Window.partitionBy(*([by] if by else [])).orderBy(order)
    turn = F.pmod(F.row_number().over(w) - 1, F.lit(len(models)))
    return requests.withColumn("model", F.element_at(F.array(*map(F.lit, models)), turn + 1))


def weighted_route(key: Column | str, weights: list[tuple[str, float]], seed: int = 0) -> Column:
    """A model drawn with the given weights by a hash of the key and the seed: the same key gives the same draw in every run."""
    total = sum(w for _, w in weights)
    if total <= 0 or any(w < 0 for _, w in weights):
        raise ConfigurationError("some weight must be positive and none negative")
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", _col(key).cast("string"), F.lit(str(seed))), 256), 1, 12), 16, 10)
    target = bits.cast("double") / float(1 << 48) * total
    out, reach = F.lit(weights[-1][0]), total
    for model, w in reversed(weights):
        out = F.when(target <= reach, model).otherwise(out)
        reach -= w
    return out


def mean_vector(vectors: DataFrame, by: str) -> DataFrame:
    """(by, centroid): the plain mean, not a unit vector."""
    cells = vectors.select(by, F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def embedding_score(embedding: Column | str, complex_: Column, simple: Column) -> Column:
    """How much nearer the vector is to the complex centroid: c / (c + s) in [0, 1]; one half where that says nothing."""

    def cos(c: Column) -> Column:
        flat = (l2_norm(embedding) < FLAT) | (l2_norm(c) < FLAT) | (F.size(_col(embedding)) != F.size(c))
        return F.when(flat, 0.0).otherwise(cosine_similarity(embedding, c, strict=False))

    c, s = cos(complex_), cos(simple)
    known = complex_.isNotNull() & simple.isNotNull() & (F.size(complex_) > 0) & (F.size(simple) > 0)
    return F.when(~known | (c + s <= FLAT), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / (c + s))))


def heuristic_score(content: Column | str) -> Column:
    """Complexity of a text by its length, variety, long words and telling words."""
    t = F.filter(F.split(F.lower(_col(content)), "[^a-z0-9]+"), lambda x: x != "")
    n = F.size(t).cast("double")
    share = lambda keep: F.size(F.filter(t, keep)) / n
    raw = 0.3 * F.least(n / 50, F.lit(1.0)) + 0.3 * (F.size(F.array_distinct(t)) / n) + 0.2 * share(lambda x: F.length(x) >= 7) + 0.2 * share(lambda x: x.isin(COMPLEX_WORDS))
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def decide(score: Column | str, threshold: float, model_a: str, model_b: str) -> tuple[Column, Column]:
    """The model (a from the threshold on) and how sure that is."""
    s = _col(score)
    return F.when(s >= threshold, model_a).otherwise(model_b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(s - threshold) * 2))


def gini(a: Column | str, b: Column | str) -> Column:
    n = _col(a) + _col(b)
    pa, pb = _col(a) / n, _col(b) / n
    return F.when(n == 0, 0.0).otherwise(1 - (pa * pa + pb * pb))


def split_gini(left_a, left_b, right_a, right_b) -> Column:
    n1, n2 = _col(left_a) + _col(left_b), _col(right_a) + _col(right_b)
    return F.when(n1 + n2 == 0, 0.0).otherwise(n1 / (n1 + n2) * gini(left_a, left_b) + n2 / (n1 + n2) * gini(right_a, right_b))


def best_splits(samples: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """samples(features, label 0/1) to (feature, threshold, gain): each feature's best threshold, midway between values; only gains above 0.

    Every distinct value is a candidate: counts by value, then running totals over them.
    """
    cells = samples.select(F.posexplode(features).alias("feature", "x"), F.col(label).cast("long").alias("y"))
    c = cells.groupBy("feature", "x").agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b"))
    order, all_ = Window.partitionBy("feature").orderBy("x"), Window.partitionBy("feature")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.select("feature", "x", F.lead("x").over(order).alias("next"), F.sum("a").over(run).alias("la"), F.sum("b").over(run).alias("lb"), F.sum("a").over(all_).alias("ta"), F.sum("b").over(all_).alias("tb"))
    c = c.where("next IS NOT NULL").withColumn("gain", gini("ta", "tb") - split_gini("la", "lb", F.col("ta") - F.col("la"), F.col("tb") - F.col("lb")))
    best = c.where(F.col("gain") > FLAT).withColumn("threshold", (F.col("x") + F.col("next")) / 2)
    top = Window.partitionBy("feature").orderBy(F.desc(F.round("gain", 10)), "threshold")
    return best.withColumn("_n", F.row_number().over(top)).where("_n = 1").select("feature", "threshold", "gain")


def train_forest(samples: DataFrame, features: str = "features", label: str = "label", trees: int = 100, depth: int = 20, seed: int = 420) -> RandomForestClassificationModel:
    """Gini trees on bootstrap samples with about sqrt(d) features a split; label 0 means model a."""
    data = samples.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))
    return RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, impurity="gini", featureSubsetStrategy="sqrt", bootstrap=True).fit(data)


def forest_score(requests: DataFrame, model: RandomForestClassificationModel, features: str = "embedding") -> DataFrame:
    """requests with `score`: the forest's probability of model a. A null embedding has none."""
    some = requests.where(F.col(features).isNotNull()).withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    m = model.copy().setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
    scored = m.transform(some).withColumn("score", vector_to_array("_p")[0]).drop("_x", "_p", "_r", "_y")
    return scored.unionByName(requests.where(F.col(features).isNull()).withColumn("score", F.lit(None).cast("double")))


def model_tier(model: Column | str) -> Column:
    """1 (smallest) to 4 by what the name holds."""
    has = lambda s: F.lower(_col(model)).contains(s)
    large = has("opus") | has("gpt-5") | has("o3") | (has("gpt-4.1") & ~has("mini"))
    return F.when(has("nano"), 1).when(large, 4).when(has("sonnet") | has("gpt-4o"), 3).otherwise(2)


def price_per_1k(tier: Column) -> Column:
    out = F.lit(PRICES[2])
    for k, v in PRICES.items():
        out = F.when(tier == k, v).otherwise(out)
    return out


def estimated_cost(model: Column | str, tokens: Column | str) -> Column:
    """Null for no token."""
    return F.when(_col(tokens) > 0, _col(tokens) / 1000 * price_per_1k(model_tier(model)))


def routing_summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """records(model, confidence, estimated_cost) to n, avg_confidence, avg_cost (of what isn't null) and the models' counts."""
    by = by or []
    per = records.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc"), F.sum("estimated_cost").alias("k"), F.count("estimated_cost").alias("nk"))
    mean = lambda s, n: F.when(F.sum(n) > 0, F.sum(s) / F.sum(n))
    return per.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("models"), mean("c", "nc").alias("avg_confidence"), mean("k", "nk").alias("avg_cost"))
