"""A key-value cache as a table, and its statistics as an aggregation of what was asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.errors import ConfigurationError

NUL = "\0"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cache_key(op: Column | str, model: Column | str, inputs: Column | str, params: Column | str) -> Column:
    """Hex SHA-256 over the operation, the model, the inputs in order and the parameters by name, each ended by a zero byte."""
    pairs = F.transform(F.array_sort(F.map_entries(_col(params))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    every = F.concat(F.array(_col(op), _col(model)), _col(inputs), pairs)
    return F.sha2(F.concat(F.array_join(every, NUL), F.lit(NUL)), 256)


def expires(now: Column, ttl_seconds: float | None) -> Column:
    """When an entry of that age limit ends; none or zero: never."""
    if ttl_seconds is not None and ttl_seconds < 0:
        raise ConfigurationError("a time to live can't be negative")
    return F.lit(None).cast("timestamp") if not ttl_seconds else now + F.make_dt_interval(secs=F.lit(float(ttl_seconds)))


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache(ns, key, value, expires_at) with new's entries in place of those of the same (ns, key)."""
    return cache.join(new.select("ns", "key"), ["ns", "key"], "left_anti").unionByName(new)


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys, ["ns", "key"], "left_anti")


def clear(cache: DataFrame, ns: str | None = None) -> DataFrame:
    return cache.where(F.lit(False) if ns is None else F.col("ns") != ns)


def evict(cache: DataFrame, now: Column) -> DataFrame:
    """Without the entries that have expired."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def lookup(cache: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """requests(ns, key, ...) with value, hit and evicted. An expired entry is a miss, and evicted; exists() is the hit column."""
    c = cache.select("ns", "key", F.col("value").alias("_value"), F.col("expires_at").alias("_expires"), F.lit(True).alias("_there"))
    j = requests.join(c, ["ns", "key"], "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    dead = there & F.coalesce(F.col("_expires") <= at, F.lit(False))
    return j.withColumn("hit", there & ~dead).withColumn("evicted", dead).withColumn("value", F.when(F.col("hit"), F.col("_value"))).drop("_value", "_expires", "_there")


def null_lookup(requests: DataFrame) -> DataFrame:
    """The cache that holds nothing: every request is a miss."""
    return requests.select("*", F.lit(None).cast("binary").alias("value"), F.lit(False).alias("hit"), F.lit(False).alias("evicted"))


def stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """log(hit, evicted, ...) to hits, misses, evictions and hit_rate by the given columns; 0 where nothing was asked. Partial logs merge by summing."""
    sums = log.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("hits", F.col("hit")), ("misses", ~F.col("hit")), ("evictions", F.col("evicted")))])
    asked = F.col("hits") + F.col("misses")
    return sums.withColumn("hit_rate", F.when(asked == 0, 0.0).otherwise(F.col("hits") / asked))
