"""Streams over the events and documents files, run over what there is, and the same windows as batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.answers import GAPS_SQL, observations
from quillon.plans.registry import query
from quillon.plans.retrieval import TOKENS
from quillon.session import ship
from quillon.sources.tables import load
from quillon.sources.workspace import shared_dir
from quillon.streaming import streams


def _stream(spark, sf_dir, name: str) -> DataFrame:
    return streams.read_table_stream(spark, f"{sf_dir}/{name}.parquet")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    base = f"{shared_dir(stream.sparkSession)}/quillon-stream-{uuid.uuid4().hex}"
    return streams.run_available(stream, f"{base}/rows", f"{base}/log", mode)


def _events(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _zoneless(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2, 3")
def tumbling_events(spark, sf_dir):
    return _zoneless(streams.event_windows(_events(spark, sf_dir), "1 hour").withColumn("value", F.round("value", 6)))


@query("SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2")
def sliding_events(spark, sf_dir):
    return _zoneless(streams.event_windows(_events(spark, sf_dir), "2 hours", "1 hour").select("start", "event_type", "n"))


@query("WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, s")
def session_events(spark, sf_dir):
    return _zoneless(streams.user_sessions(_events(spark, sf_dir), "30 minutes"))


@query(GAPS_SQL)
def stream_gaps(spark, sf_dir):
    g = _run(streams.gap_counts(observations(_stream(spark, sf_dir, "events"))), "complete")
    return g.select("pattern", "misses", F.round("avg_similarity", 6).alias("avg_similarity"))


@query(f"SELECT 'text' AS field, term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents) GROUP BY 2")
def stream_term_frequencies(spark, sf_dir):
    return _run(streams.term_frequencies(_stream(spark, sf_dir, "documents").select(F.lit("text").alias("field"), "text")), "complete")


@query(f"SELECT 'text' AS field, count(*) AS n, sum(len({TOKENS.format('text')}))::BIGINT AS total FROM documents")
def stream_field_lengths(spark, sf_dir):
    return _run(streams.field_lengths(_stream(spark, sf_dir, "documents").select(F.lit("text").alias("field"), "text")), "complete")


@query("SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS avg_confidence FROM events GROUP BY 1")
def stream_routing(spark, sf_dir):
    r = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("confidence"), F.lit(None).cast("double").alias("estimated_cost"))
    return _run(streams.routing_counts(r), "complete").select("model", "n", F.round("avg_confidence", 6).alias("avg_confidence"))


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def stream_dedup(spark, sf_dir):
    """Events of one user, kind and properties count once; the delay is longer than the table's days."""
    e = streams.watermarked(_stream(spark, sf_dir, "events"), delay="3650 days")
    return _run(streams.distinct_events(e, ["user_id", "event_type", "props"]).select("user_id", "event_type", "props"), "append")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS operation, count(*) AS n FROM events GROUP BY 1, 2")
def stream_changelog(spark, sf_dir):
    e = streams.watermarked(_stream(spark, sf_dir, "events")).select(F.col("ts").alias("system_from"), F.col("event_type").alias("operation"))
    return _zoneless(_run(streams.changelog_counts(e), "complete"))


@query("""
WITH o AS (SELECT props AS key, event_id, event_type IN ('purchase', 'signup') AS put, value, epoch_us(ts) // 1000 AS moment FROM events),
l AS (SELECT *, max(CASE WHEN put THEN event_id END) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o),
j AS (SELECT l.*, p.value AS held, p.moment + 3600000 AS until FROM l LEFT JOIN o p ON p.event_id = last WHERE NOT l.put),
d AS (SELECT *, last IS NOT NULL AND until <= moment AS dead FROM j)
SELECT key, event_id AS seq, last IS NOT NULL AND NOT dead AS hit, dead AND count(*) FILTER (dead) OVER (PARTITION BY key, last ORDER BY event_id) = 1 AS evicted FROM d
""")
def stream_cache(spark, sf_dir):
    """Purchases and signups put, all else gets; an entry lives an hour."""
    ship(spark)
    e = _stream(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("purchase", "signup"), "put").otherwise("get")
    ops = e.select(F.col("props").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return _run(streams.cache_with_ttl(ops, 3_600_000), "append").select("key", "seq", "hit", "evicted")
