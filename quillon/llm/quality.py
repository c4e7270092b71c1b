"""Document quality by hierarchical empirical Bayes: a classifier's evidence on the text, joined to what is known of its path, host and the corpus."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import keep_joined, write_table
from quillon.sources.workspace import drop_table

#: Features of a text, each an integer bin; RE2 and Java read the patterns alike, and all divisions are of integers.
FEATURES: dict[str, str] = {
    "symbols": "least(20, (50 * regexp_count(_text, '[*#$%&!|<>{}=~^]')) div length(_text))",
    "capitals": "least(20, (25 * regexp_count(_text, '[A-Z]')) div length(_text))",
    "digits": "least(20, (50 * regexp_count(_text, '[0-9]')) div length(_text))",
    "word_length": "least(20, length(_text) div size(_all))",
    "variety": "greatest(0, least(20, cast(floor(40 * ln(1 + size(_distinct)) / ln(1 + size(_all))) as bigint) - 20))",  # of logarithms, as long texts repeat more
    "size": "least(20, cast(floor(log2(1 + size(_all))) as bigint))",
    "repeats": "least(20, (20 * size(filter(_all, (w, i) -> i > 0 AND w = _all[i - 1]))) div size(_all))",
    "lines": "least(20, cast(floor(2 * log2(1 + size(_lines) - size(array_distinct(_lines)))) as bigint))",
}
#: Buckets of hashed words; pseudo-documents of a bucket, parted between the labels like the documents.
BUCKETS, WORD_SMOOTH = 4096, 10.0
#: Laplace count of a bin and label; a site's prior weighs as many documents at least and at most.
SMOOTH, LEAST_WEIGHT, MOST_WEIGHT = 1.0, 2.0, 10_000.0
THRESHOLD = 0.5


def features(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """The given columns, the text's bins (_symbols and so on; 0 each for a null or empty text), and _words, the buckets of its distinct words."""
    split = docs.select(*columns, F.nullif("text", F.lit("")).alias("_text")).select("*", F.expr(r"split(_text, '[ \\t\\n]+')").alias("_all"), F.expr(r"split(_text, '\\n')").alias("_lines"))
    split = split.select("*", F.array_distinct("_all").alias("_distinct"))
    bins = [F.when(F.col("_text").isNull(), 0).otherwise(F.expr(e).cast("int")).alias(f"_{k}") for k, e in FEATURES.items()]
    words = F.expr("coalesce(array_distinct(transform(_distinct, w -> cast(conv(substr(md5(w), 1, 3), 16, 10) as smallint))), cast(array() as array<smallint>))")
    return split.select(*[c for c in split.columns if c not in ("_text", "_all", "_lines", "_distinct")], *bins, words.alias("_words"))


def site() -> list[Column]:
    """Host and path: of a source that is a URL its host, and the host with the first part of its path; else the source, and the source with the language."""
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang"))
    host = F.regexp_extract(source, "^[a-z]+://([^/?#]+)", 1)
    first = F.regexp_extract(source, "^[a-z]+://[^/?#]+/([^/?#]+)", 1)
    return [F.when(host != "", host).otherwise(source).alias("_host"), F.when(host != "", F.concat(host, F.lit("/"), first)).otherwise(F.concat(source, F.lit("/"), lang)).alias("_path")]


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _weight(table: DataFrame, parent: Column) -> float:
    """How many documents the parent's rate counts for, by the method of moments: small if the groups differ more than their sizes explain."""
    rate, n = F.col("good") / F.col("n"), F.col("n")
    r = table.agg(F.sum(n * (rate - parent) * (rate - parent)).alias("spread"), F.sum(parent * (1 - parent)).alias("noise"), F.sum(n).alias("n"), F.sum(n * parent * (1 - parent)).alias("scale")).first()
    if not r["n"]:
        return MOST_WEIGHT
    between = (r["spread"] - r["noise"]) / r["n"]
    return MOST_WEIGHT if between <= 0 else min(MOST_WEIGHT, max(LEAST_WEIGHT, r["scale"] / r["n"] / between - 1))


def _word_ratios(table: DataFrame) -> dict[int | None, list[int]]:
    """By fold of labelled ids (None: both): of every bucket, thousandths of the log likelihood ratio that a good document has it."""
    counts = table.where("_label IS NOT NULL").select("_fold", "_label", F.explode(F.concat("_words", F.array(F.lit(-1).cast("smallint")))).alias("b")).groupBy("_fold", "_label", "b").count().collect()  # at most 4 * BUCKETS; -1 stands for the document itself
    out = {}
    for fold in (0, 1, None):
        n = {(b, y): 0 for b in range(-1, BUCKETS) for y in (0, 1)}
        for f, y, b, k in counts:
            n[b, y] += k * (fold is None or f == fold)
        good, bad = n[-1, 1], n[-1, 0]
        share = good / max(1, good + bad)
        out[fold] = [round(1000 * (log((n[b, 1] + WORD_SMOOTH * share) / good) - log((n[b, 0] + WORD_SMOOTH * (1 - share)) / bad))) if good and bad else 0 for b in range(BUCKETS)]
    return out


def fit(docs: DataFrame, labels: DataFrame, extra: list[str] | None = None) -> tuple[Column, DataFrame, DataFrame]:
    """The evidence of a text's bins (log likelihood ratio), the prior of every path (_path, _host, _prior), and each document's bins (_id, _host, _path, extra and others).

    All counts cover all documents and all labels. The classifier is naive Bayes in two steps: hashed words give each
    text the mean ratio of its words, one more bin beside the counts; then the bins' ratios add up. A labelled text's
    words are judged by ratios of the other half of the labels (parted by a hash of the id), so that no text vouches for itself.
    Every document then counts towards its path and host with its label or, lacking one, its posterior under the corpus'
    rate; path rates shrink towards their host's, host rates towards the corpus', by weights taken from how much sites
    differ, which lie between LEAST_WEIGHT and MOST_WEIGHT documents.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    table = features(docs, [F.col("doc_id").cast("long").alias("_id"), *site(), *(docs[c] for c in extra or [])])
    wide = table = write_table(table.join(known, "_id", "left").withColumn("_fold", F.expr("conv(substr(md5(cast(_id as string)), 1, 1), 16, 10) % 2").cast("int")), "quality")
    ratios = {f: F.expr(f"from_json('{r}', 'array<int>')") for f, r in _word_ratios(table).items()}  # folded to one literal each
    ratio = F.when(F.col("_label").isNull(), ratios[None]).when(F.col("_fold") == 0, ratios[1]).otherwise(ratios[0])
    total = F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.get(F.col("_ratio"), w))
    n = F.size("_words").cast("long")
    bin_ = F.least(F.lit(20), F.greatest(F.lit(0), F.expr("(_sum + 10000 * _n) div (200 * _n)") - 40))  # fifths of the mean, from -2 to 2
    table = table.withColumn("_ratio", ratio).withColumn("_sum", total).withColumn("_n", n).withColumn("_vocabulary", F.when(F.col("_n") == 0, 10).otherwise(bin_).cast("int")).drop("_ratio", "_sum", "_n", "_words")
    table = write_table(table, "bins")
    drop_table(wide)  # the words of all texts; later stages shouldn't find them on disk
    every = [*FEATURES, "vocabulary"]
    stack = ", ".join(f"'{k}', _{k}" for k in every)
    counts = {(r[0], r[1], r[2]): r[3] for r in table.where("_label IS NOT NULL").select("_label", F.expr(f"stack({len(every)}, {stack}) AS (f, bin)")).groupBy("f", "bin", "_label").count().collect()}  # at most 21 bins a feature
    total = {y: sum(n for (f, _, z), n in counts.items() if z == y and f == "symbols") for y in (0, 1)}
    evidence = F.lit(0.0)
    for k in every:
        ratio = [log((counts.get((k, b, 1), 0) + SMOOTH) / (total[1] + 21 * SMOOTH)) - log((counts.get((k, b, 0), 0) + SMOOTH) / (total[0] + 21 * SMOOTH)) for b in range(21)]
        evidence = evidence + F.element_at(F.expr(f"array({', '.join(f'{x!r}D' for x in ratio)})"), F.col(f"_{k}") + 1)
    base = (total[1] + 1) / (total[0] + total[1] + 2)
    good = F.coalesce(F.col("_label").cast("double"), _sigmoid(F.lit(log(base / (1 - base))) + evidence))
    paths = write_table(table.select("_host", "_path", good.alias("good")).groupBy("_host", "_path").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    rate = paths.agg(F.sum("good"), F.sum("n")).first()
    rate = (rate[0] + 1) / (rate[1] + 2) if rate[1] else base
    hosts = paths.groupBy("_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    w = _weight(hosts, F.lit(rate))
    hosts = hosts.select("_host", ((F.col("good") + w * rate) / (F.col("n") + w)).alias("_host_rate"))
    paths = paths.join(hosts, "_host")
    w = _weight(paths, F.col("_host_rate"))
    return evidence, paths.select("_path", "_host", ((F.col("good") + w * F.col("_host_rate")) / (F.col("n") + w)).alias("_prior")), table


def _posterior(scored: DataFrame, priors: DataFrame) -> DataFrame:
    scored = scored.join(priors, ["_path", "_host"], "left")
    return scored.withColumn("_posterior", _sigmoid(F.ln(F.col("_prior") / (1 - F.col("_prior"))) + F.col("_evidence")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: (doc_id, host, path, evidence, prior, posterior, accepted); accepted: posterior >= threshold, a tie included.

    Null and empty texts have all features 0 and no words, and are judged like other texts of that kind. Texts of any
    length count whole. Null source and language count as empty names; a null id has no label. A document labelled more
    than once has the majority's label, good in a tie. Each repeated row is judged and counted. Other columns are
    ignored. Without any labels the evidence is 0 and every prior near one half; an empty table gives no rows.
    """
    evidence, priors, table = fit(docs, labels)
    r = _posterior(table.withColumn("_evidence", evidence), priors)
    return r.select(F.col("_id").alias("doc_id"), F.col("_host").alias("host"), F.col("_path").alias("path"), F.round("_evidence", 6).alias("evidence"), F.round("_prior", 6).alias("prior"), F.round("_posterior", 6).alias("posterior"), (F.col("_posterior") >= threshold).alias("accepted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they were, that quality() accepts. Row by row: ids play no part in it. Only bins and row numbers are joined, not texts."""

    def accepted(d: DataFrame) -> DataFrame:
        evidence, priors, table = fit(d, labels, ["_file", "_place"])
        return _posterior(table.withColumn("_evidence", evidence), priors).where(F.col("_posterior") >= threshold)

    return keep_joined(docs, ["doc_id", "text", "source", "lang"], accepted)


def _sql() -> str:
    words, lines = "wl", "string_split(text, chr(10))"
    count = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    bins = {
        "symbols": f"least(20, (50 * {count('[*#$%&!|<>{}=~^]')}) // length(text))", "capitals": f"least(20, (25 * {count('[A-Z]')}) // length(text))", "digits": f"least(20, (50 * {count('[0-9]')}) // length(text))",
        "word_length": f"least(20, length(text) // len({words}))", "variety": f"greatest(0, least(20, floor(40 * ln(1 + len(list_distinct({words}))) / ln(1 + len({words})))::BIGINT - 20))",
        "size": f"least(20, floor(log2(1 + len({words})))::BIGINT)", "repeats": f"least(20, (20 * len(list_filter(range(1, len({words})), lambda i: {words}[i] = {words}[i + 1]))) // len({words}))", "lines": f"least(20, floor(2 * log2(1 + len({lines}) - len(list_distinct({lines}))))::BIGINT)",
    }
    every = [*FEATURES, "vocabulary"]
    stacked = " UNION ALL ".join(f"SELECT '{k}' AS f, {k} AS bin, label FROM feat" for k in every)
    evidence = " + ".join(f"(SELECT ratio FROM llr WHERE llr.f = '{k}' AND llr.bin = feat.{k})" for k in every)
    weight = lambda parent, table: f"(SELECT CASE WHEN b <= 0 THEN {MOST_WEIGHT}::DOUBLE ELSE least({MOST_WEIGHT}::DOUBLE, greatest({LEAST_WEIGHT}::DOUBLE, s / b - 1)) END FROM (SELECT (sum(n * (good / n - {parent}) * (good / n - {parent})) - sum({parent} * (1 - {parent}))) / sum(n) AS b, sum(n * {parent} * (1 - {parent})) / sum(n) AS s FROM {table}))"
    return f"""
WITH d AS MATERIALIZED (SELECT *, regexp_split_to_array(text, '[ \\t\\n]+') AS wl FROM documents),
lab AS (SELECT doc_id, (avg(quality) >= 0.5)::INTEGER AS label FROM labels GROUP BY 1),
feat0 AS (SELECT row_number() OVER () AS r, d.doc_id, source AS host, source || '/' || lang AS path, label, CASE WHEN label IS NOT NULL THEN 1 - ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 1))::INTEGER % 2 ELSE 2 END AS fold, {", ".join(f"CASE WHEN length(text) > 0 THEN {e} ELSE 0 END AS {k}" for k, e in bins.items())},
  CASE WHEN length(text) > 0 THEN list_distinct(list_transform(list_distinct({words}), lambda w: ('0x' || substr(md5(w), 1, 3))::INTEGER)) ELSE [] END AS ws FROM d LEFT JOIN lab USING (doc_id)),
ex AS (SELECT r, ('0x' || substr(md5(doc_id::VARCHAR), 1, 1))::INTEGER % 2 AS parity, label, fold, unnest(ws) AS b FROM feat0),
folds AS (SELECT * FROM (VALUES (0), (1), (2)) AS v(fold)),
nd AS (SELECT folds.fold, count(*) FILTER (label = 1)::DOUBLE AS g, count(*) FILTER (label = 0)::DOUBLE AS b FROM folds JOIN feat0 f ON label IS NOT NULL AND (folds.fold = 2 OR ('0x' || substr(md5(f.doc_id::VARCHAR), 1, 1))::INTEGER % 2 = folds.fold) GROUP BY 1),
wc AS (SELECT folds.fold, ex.b, count(*) FILTER (label = 1)::DOUBLE AS g1, count(*) FILTER (label = 0)::DOUBLE AS b1 FROM folds JOIN ex ON label IS NOT NULL AND (folds.fold = 2 OR parity = folds.fold) GROUP BY 1, 2),
wr AS (SELECT fold, wc.b, round(1000 * (ln((g1 + {WORD_SMOOTH}::DOUBLE * (g / (g + nd.b))) / g) - ln((b1 + {WORD_SMOOTH}::DOUBLE * (1 - g / (g + nd.b))) / nd.b)))::BIGINT AS ratio FROM wc JOIN nd USING (fold) WHERE g > 0 AND nd.b > 0),
ws AS (SELECT r, sum(coalesce(ratio, 0))::BIGINT AS total, count(*) AS n FROM ex LEFT JOIN wr USING (fold, b) GROUP BY 1),
feat AS (SELECT feat0.*, CASE WHEN n IS NULL THEN 10 ELSE least(20, greatest(0, (total + 10000 * n) // (200 * n) - 40)) END AS vocabulary FROM feat0 LEFT JOIN ws USING (r)),
st AS ({stacked}), tot AS (SELECT count(*) FILTER (label = 1)::DOUBLE AS g, count(*) FILTER (label = 0)::DOUBLE AS b FROM feat),
llr AS (SELECT f, bin, ln((count(*) FILTER (label = 1) + 1.0::DOUBLE) / (any_value(g) + 21)) - ln((count(*) FILTER (label = 0) + 1.0::DOUBLE) / (any_value(b) + 21)) AS ratio FROM st, tot GROUP BY 1, 2),
ev AS (SELECT doc_id, host, path, label, {evidence} AS e FROM feat),
base AS (SELECT ln((g + 1) / (b + 1)) AS l FROM tot),
soft AS (SELECT *, coalesce(label::DOUBLE, 1 / (1 + exp(-(l + e)))) AS good FROM ev, base),
paths AS (SELECT host, path, sum(good) AS good, count(*)::DOUBLE AS n FROM soft GROUP BY 1, 2),
corpus AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS r FROM paths),
hosts0 AS (SELECT host, sum(good) AS good, sum(n) AS n, any_value(r) AS r FROM paths, corpus GROUP BY 1),
hw AS (SELECT {weight("r", "hosts0")} AS w),
hosts AS (SELECT host, (good + w * r) / (n + w) AS q FROM hosts0, hw),
paths0 AS (SELECT paths.*, q FROM paths JOIN hosts USING (host)),
pw AS (SELECT {weight("q", "paths0")} AS w),
priors AS (SELECT host, path, (good + w * q) / (n + w) AS prior FROM paths0, pw),
fin AS (SELECT doc_id, host, path, e, prior, 1 / (1 + exp(-(ln(prior / (1 - prior)) + e))) AS post FROM ev JOIN priors USING (host, path))
SELECT doc_id, host, path, round(e, 6) AS evidence, round(prior, 6) AS prior, round(post, 6) AS posterior, post >= {THRESHOLD}::DOUBLE AS accepted FROM fin
"""


SQL = _sql()
