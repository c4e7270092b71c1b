"""Shared pieces: rows of files kept by row number, batching of texts, memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.workspace import fs_uri, table_path, write_table

#: Characters that one NumPy pass handles at once; bounds a Python worker's memory, never what is processed.
CHUNK_CHARS = 1_000_000


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Hands freed memory back to the system; else an idle Python worker keeps its largest task's until it ends."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def lean(run):
    """A mapInArrow function that hands its memory back when its task ends."""

    def freed(batches):
        for out in run(batches):
            yield out
        give_back()

    return freed


def _places(docs: DataFrame) -> list | None:
    """Each row's file and place in it, where docs is read from files (through selections and filters too); None where it isn't."""
    try:
        meta = docs.metadataColumn("_metadata")
        columns = [F.xxhash64(meta["file_path"]).alias("_file"), meta["row_index"].alias("_place")]
        docs.select(*columns).schema
        return columns
    except AnalysisException:
        return None


def rereadable(df: DataFrame) -> bool:
    """Does df only select from one table of files? Then its partitions hold the same rows in the same order whenever it is read, with same_splits()."""

    def plain(plan) -> bool:
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return plan.nodeName() == "LogicalRelation" if not children else plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and all(map(plain, children))

    return plain(df._jdf.queryExecution().analyzed())


@contextlib.contextmanager
def same_splits(spark: SparkSession):
    """Files are cut alike inside, even where executors come and go: the number of cores decides else."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def keep_joined(docs: DataFrame, keys: list[str], join) -> DataFrame:
    """The rows of docs that `join`, a semi or anti join by the key columns, keeps; all columns as they were.

    Texts aren't shuffled: only (keys, file, row number) are joined, the numbers that stay are written by file, and the
    tasks that read a file look its numbers up. What doesn't come from files is written to the shared folder first.
    """
    columns = _places(docs)
    if columns is None:
        docs = write_table(docs, "docs")
        columns = _places(docs)
    file, row = columns
    kept = join(docs.select(*keys, file, row))
    buckets = max(1, min(10_000, len(docs.inputFiles())))
    path = table_path(docs.sparkSession, "places")
    kept.select(F.pmod("_file", F.lit(buckets)).alias("_bucket"), "_file", "_place").repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    n, uri = len(docs.columns), fs_uri(path)

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        held, places = None, None
        for batch in batches:
            files, at = batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            ok = np.zeros(len(files), bool)
            for f in np.unique(files).tolist():
                if f != held:
                    folder = f"{root}/_bucket={f % buckets}"
                    there = fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory
                    held, places = f, np.sort(pyarrow.parquet.read_table(folder, columns=["_place"], filters=[("_file", "==", f)], filesystem=fs, partitioning=None)["_place"].to_numpy()) if there else np.empty(0, np.int64)
                own = np.flatnonzero(files == f)
                if len(places):
                    ok[own] = places[np.minimum(np.searchsorted(places, at[own]), len(places) - 1)] == at[own]
            yield batch.select(list(range(n))).filter(pa.array(ok))

    own = [docs[f"`{c}`"] for c in docs.columns]
    return docs.select(*own, file.alias("_file_of_row"), row.alias("_place_of_row")).mapInArrow(lean(run), docs.schema)


def chunks(texts: list, limit: int = CHUNK_CHARS, most: int = 60_000):
    """Index ranges whose texts together hold about `limit` characters; one text may exceed it alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and (size + n > limit or i - begin >= most):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def text_chunks(column: pa.Array, limit: int = CHUNK_CHARS, most: int = 60_000):
    """chunks() of an Arrow column as (begin, end, texts), by bytes; only one chunk's texts are Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (size + n > limit or i - begin >= most):
            yield begin, i, column.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes), column.slice(begin).to_pylist()


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
