"""What the stores keep up to date as they go, as Structured Streaming queries: each takes a stream (or a table) and gives one of the same kind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions.text import tokenize
from quillon.operators.answers import MISS_THRESHOLD, missed


def watermarked(stream: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """With the column as a UTC timestamp (a zone-less one is taken as UTC) and late rows bounded."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def event_windows(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, value) of tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", "event_type", "n", "value")


def user_sessions(events: DataFrame, gap: str) -> DataFrame:
    """(start, end, user_id, n): a session ends when nothing comes for `gap`."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "user_id", "n")


def distinct_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first of rows with equal keys, within the watermark on a stream."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def gap_counts(observations: DataFrame, threshold: float = MISS_THRESHOLD) -> DataFrame:
    """Running (pattern, misses, avg_similarity): partial sums a pattern are all the state."""
    return missed(observations, threshold).groupBy("pattern").agg(F.count(F.lit(1)).alias("misses"), F.avg("max_similarity").alias("avg_similarity"))


def routing_counts(records: DataFrame) -> DataFrame:
    """Running (model, n, avg_confidence, avg_cost)."""
    return records.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg("estimated_cost").alias("avg_cost"))


def term_frequencies(documents: DataFrame) -> DataFrame:
    """Running document frequencies (field, term, df) of a stream of new documents(field, text)."""
    return documents.select("field", F.explode(F.array_distinct(tokenize("text"))).alias("term")).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_lengths(documents: DataFrame) -> DataFrame:
    """Running (field, n, total): with term_frequencies, all that scores need of the corpus."""
    return documents.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(tokenize("text"))).alias("total"))


def changelog_counts(changes: DataFrame, size: str = "1 day") -> DataFrame:
    """(start, operation, n) of a stream of changes(system_from, operation)."""
    return changes.groupBy(F.window("system_from", size).alias("w"), "operation").agg(F.count(F.lit(1)).alias("n")).select("w.start", "operation", "n")


def cache_with_ttl(operations: DataFrame, ttl_ms: int) -> DataFrame:
    """operations(key, seq, op put/get, value, at_ms) to one row a get, (key, seq, hit, evicted, value). State is an entry a key, dropped when it has expired."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.op == "put":
                held = (row.value, row.at_ms + ttl_ms if ttl_ms else -1)
                continue
            dead = held is not None and 0 <= held[1] <= row.at_ms
            out.append((key[0], row.seq, held is not None and not dead, dead, None if held is None or dead else held[0]))
            held = None if dead else held
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
        yield pd.DataFrame(out, columns=["key", "seq", "hit", "evicted", "value"])

    return operations.groupBy("key").applyInPandasWithState(step, "key string, seq long, hit boolean, evicted boolean, value double", "value double, expires long", "append", GroupStateTimeout.NoTimeout)


def read_table_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream of its files, with the schema it has now."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch)
    single = [f.rpartition("/")[2] for f in table.inputFiles()] == [name]
    return source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is, into a Parquet folder, and reads it. Modes that change rows keep each batch's rows under its number; the last of a key counts."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(target)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.option("basePath", target).parquet(target)
    if mode == "complete":
        return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")
    return every.groupBy(*(keys or [])).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r")).select("r.*")
