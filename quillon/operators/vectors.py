"""The vector table: keyed changes, pages, exact nearest neighbours and statistics of embeddings."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.best import Best, true
from quillon.functions.vectors import EPSILON, clamp_similarity, cosine_distance, normalize, surprisal
from quillon.session import ship
from quillon.sources.errors import ConfigurationError
from quillon.sources.workspace import fs_uri, write_table

#: Vectors that a written row holds, queries of a task, rows of vectors met at once, queries of a product, pairs computed in double at once: they bound memory, never what is compared.
BLOCK_ROWS, QUERY_ROWS, BLOCKS_AT_ONCE, TILE_ROWS, TAKEN = 1024, 4096, 4, 512, 200_000


def upsert(base: DataFrame, new: DataFrame, dimension: int | None = None) -> DataFrame:
    """base(ns, id, embedding, metadata) with new's rows in place of those of the same (ns, id). With a dimension set, a vector of another raises."""
    if dimension is not None:
        fits = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"DimensionMismatch: expected {dimension}")).cast("array<float>"))
        new = new.withColumn("embedding", fits)
    return base.join(new.select("ns", "id"), ["ns", "id"], "left_anti").unionByName(new)


def delete(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.join(keys, ["ns", "id"], "left_anti")


def delete_namespace(base: DataFrame, ns: str) -> DataFrame:
    return base.where(F.col("ns") != ns)


def count(base: DataFrame, ns: str | None = None) -> DataFrame:
    return (base if ns is None else base.where(F.col("ns") == ns)).agg(F.count(F.lit(1)).alias("n"))


def metadata_filter(wanted: dict, column: str = "metadata") -> Column:
    """All keys equal, by JSON value: the number 1 isn't the string "1", and a missing key equals nothing."""
    ok = F.lit(True)
    doc = F.parse_json(column)
    for k, v in wanted.items():
        path = "$['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
        if v is None:
            # try_variant_get gives null for JSON null and for a missing key alike: look for the key itself
            ok = ok & F.array_contains(F.json_object_keys(column), k) & F.is_variant_null(F.variant_get(doc, path, "variant"))
        else:
            ok = ok & F.coalesce(F.to_json(F.variant_get(doc, path, "variant")) == F.to_json(F.parse_json(F.lit(json.dumps(v, ensure_ascii=False)))), F.lit(False))
    return ok


def list_page(base: DataFrame, ns: str, limit: int = 100, cursor=None, where: Column | None = None) -> DataFrame:
    """A page in the order of ids: (id, metadata, total, next_cursor). Starts after the cursor, whether or not it still exists; total counts all that the filter passes."""
    if limit < 1:
        raise ConfigurationError("limit must be positive")
    rows = base.where(F.col("ns") == ns)
    rows = rows if where is None else rows.where(where)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    after = rows if cursor is None else rows.where(F.col("id") > cursor)
    page = after.orderBy("id").limit(limit + 1).withColumn("n", F.row_number().over(Window.orderBy("id"))).withColumn("more", F.max("n").over(Window.partitionBy()) > limit)
    last = F.max(F.when(F.col("n") == limit, F.col("id"))).over(Window.partitionBy())
    return page.withColumn("next_cursor", F.when(F.col("more"), last)).where(F.col("n") <= limit).crossJoin(F.broadcast(total)).select("id", "metadata", "total", "next_cursor")


def _blocks(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Written (ns, dim, keys, matrix): up to BLOCK_ROWS vectors of one dimension a row."""
    single = dict(df.dtypes)["embedding"] == "array<float>"

    def run(batches):
        for batch in batches:
            ns, keys, vectors = (batch.column(i) for i in range(3))
            names = np.array(ns.to_pylist(), object)
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            rows: list[list] = [[], [], [], []]
            for name in dict.fromkeys(x for x in names.tolist() if x is not None):
                for d in np.unique(sizes[(names == name) & (sizes >= 0)]).tolist():
                    every = np.flatnonzero((names == name) & (sizes == d))
                    for begin in range(0, len(every), BLOCK_ROWS):
                        at = pa.array(every[begin : begin + BLOCK_ROWS])
                        m = vectors.take(at).flatten().to_numpy(zero_copy_only=False)
                        for store, v in zip(rows, (name, d, keys.take(at).to_pylist(), m.astype(np.float32 if single else np.float64).tobytes())):
                            store.append(v)
            kinds = (pa.string(), pa.int32(), pa.list_(batch.column(1).type), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=["ns", "dim", "keys", "matrix"])

    element = "float" if single else "double"
    blocks = ship_of(df).select("ns", key, F.col("embedding").cast(f"array<{element}>")).mapInArrow(run, f"ns string, dim int, keys array<{kind}>, matrix binary")
    out = write_table(blocks, "vectors")
    out.kind = np.float32 if single else np.float64
    return out


def ship_of(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df


def _groups(table: DataFrame) -> list[tuple]:
    """(file, row group, rows) of a written table."""
    fs, root = pyarrow.fs.FileSystem.from_uri(fs_uri(table.written_to))
    files = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(root)) if x.path.endswith(".parquet"))
    return [(f, i, m.row_group(i).num_rows) for f in files for m in [pyarrow.parquet.read_metadata(f, filesystem=fs)] for i in range(m.num_row_groups)]


def _askers(table: DataFrame) -> list[tuple]:
    """Blocks of queries that are asked together, (ns, dim, [(file, row group, row)]): up to QUERY_ROWS queries."""
    fs, _ = pyarrow.fs.FileSystem.from_uri(fs_uri(table.written_to))
    out: list[tuple] = []
    at: dict = {}
    for f, i, _ in _groups(table):
        t = pyarrow.parquet.ParquetFile(f, filesystem=fs).read_row_group(i, columns=["ns", "dim", "keys"])
        for row, (ns, dim, n) in enumerate(zip(t["ns"].to_pylist(), t["dim"].to_pylist(), pc.list_value_length(t["keys"]).to_pylist())):
            if (ns, dim) not in at or at[ns, dim][1] + n > QUERY_ROWS:
                out.append((ns, dim, []))
                at[ns, dim] = [out[-1][2], 0]
            at[ns, dim][0].append((f, i, row))
            at[ns, dim][1] += n
    return out


def _parts(table: DataFrame, most: int) -> list[list[tuple]]:
    """The table's rows in up to `most` parts of one size: [(file, row group, begin, end)]."""
    groups = _groups(table)
    rows = sum(g[2] for g in groups)
    edges = [rows * k // min(most, rows) for k in range(min(most, rows) + 1)] if rows else [0]
    starts = np.cumsum([0] + [g[2] for g in groups])
    return [[(f, i, int(max(a, s) - s), int(min(b, s + n) - s)) for (f, i, n), s in zip(groups, starts) if s < b and s + n > a] for a, b in zip(edges, edges[1:])]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.where(norm < EPSILON, 0.0, m / np.where(norm < EPSILON, 1.0, norm))


class _Best(Best):
    """The best of a block of queries so far: similarity to 10 places, then id."""

    def __init__(self, queries: np.ndarray, limit: int, min_similarity: float | None):
        super().__init__(len(queries), limit, 0.0 if min_similarity is None else max(0.0, min(1.0, min_similarity)) - 1e-10)
        self.q, self.min = queries, min_similarity
        self.single = queries.astype(np.float32)
        #: what single precision may be off by: unit vectors, so at most (dim + 2) roundings of 2 ** -24; twice that
        self.off = (queries.shape[1] + 8) * 2.0**-23

    def meet(self, v: np.ndarray, ids: np.ndarray) -> None:
        """All queries against vectors v, in single precision first; what may count is computed in double."""
        w, found = v.astype(np.float32), []
        for begin in range(0, len(self.q), TILE_ROWS):
            rough = self.single[begin : begin + TILE_ROWS] @ w.T
            least = self.least[begin : begin + len(rough)] - self.off
            if len(v) > self.limit and not self.full[begin : begin + len(rough)].all():  # the limit-th best of these comes first
                kth = np.partition(rough, len(v) - self.limit, axis=1)[:, len(v) - self.limit]
                least = np.fmax(least, np.where(kth > 2 * self.off, kth - 2 * self.off, -1.0))
            if self.min is None or self.min <= self.off:
                least = np.where(least <= self.off, -np.inf, least)  # negative ones count as 0 and tie
            row, at = np.divmod(true(rough >= least.astype(np.float32)[:, None]), len(v))
            found.append((row + begin, at))
            if sum(len(x) for _, x in found) > TAKEN or begin + TILE_ROWS >= len(self.q):
                self._take(*map(np.concatenate, zip(*found)), v, ids)
                found = []

    def _take(self, row: np.ndarray, at: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        for a in range(0, len(row), TAKEN):
            r, x = row[a : a + TAKEN], at[a : a + TAKEN]
            raw = np.clip(np.einsum("ij,ij->i", self.q[r], v[x]), -1, 1)
            ok = raw == raw if self.min is None else raw >= self.min
            self.merge(r[ok], np.round(np.clip(raw[ok], 0, 1), 10), ids[x[ok]])


def nearest_neighbors(vectors: DataFrame, queries: DataFrame, limit: int = 20, min_similarity: float | None = None, where: Column | None = None, include_vectors: bool = False) -> DataFrame:
    """vectors(ns, id, embedding, ...) and queries(query_id, ns, embedding) to (query_id, id, similarity, rank[, embedding]).

    Exact. The filter comes before any arithmetic; min_similarity holds for the raw cosine, ranks for the clamped one to
    10 places, then id. Vectors of another length than the query's are passed over. Both sides are written as matrices;
    a task reads thousands of queries and, a few MB at a time, all vectors, or where queries are few a part of them, and
    gives `limit` rows a query. Every pair is computed in single precision; only those that may be among the best, by
    what single precision may be off by, are computed again and ranked in double.
    """
    spark = vectors.sparkSession
    v = vectors if where is None else vectors.where(where)
    kind_v, kind_q = dict(v.dtypes)["id"], dict(queries.dtypes)["query_id"]
    left, right = _blocks(v, "id", kind_v), _blocks(queries, "query_id", kind_q)
    asked, tasks = _askers(right), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = _parts(left, -(-tasks // max(1, len(asked))))
    uri, in_v, in_q = fs_uri(left.written_to), left.kind, right.kind

    def run(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(uri)
        row_group = lambda f, i: pyarrow.parquet.ParquetFile(f, filesystem=fs).read_row_group(i)
        for task in (x for batch in batches for x in batch.column(0).to_pylist()):
            ns, dim, own = asked[task // len(parts)]
            taken = pa.concat_tables([row_group(f, i).slice(row, 1) for f, i, row in own])
            best = _Best(_unit(np.concatenate([np.frombuffer(m, in_q).reshape(-1, dim) for m in taken["matrix"].to_pylist()])), limit, min_similarity)
            qkeys = pa.concat_arrays([c.flatten() for c in taken["keys"].chunks])
            for f, i, begin, end in parts[task % len(parts)]:
                t = row_group(f, i).slice(begin, end - begin)
                t = t.filter(pc.and_(pc.equal(t["ns"], ns), pc.equal(t["dim"], dim)))
                for k in range(0, t.num_rows, BLOCKS_AT_ONCE):
                    some = t.slice(k, BLOCKS_AT_ONCE)
                    m = np.concatenate([np.frombuffer(x, in_v).reshape(-1, dim) for x in some["matrix"].to_pylist()])
                    best.meet(_unit(m), np.array([x for keys in some["keys"].to_pylist() for x in keys]))
            if len(best.row):
                key = qkeys.take(pa.array(best.row))
                yield pa.RecordBatch.from_arrays([key, pa.array(best.id.tolist(), t["keys"].type.value_type), pa.array(best.score)], names=["query_id", "id", "similarity"])

    units = len(asked) * len(parts)
    hits = spark.range(0, units, 1, max(1, units)).mapInArrow(run, f"query_id {kind_q}, id {kind_v}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return hits.join(v.select("id", "embedding"), "id") if include_vectors else hits


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, centroid): the normalised mean of each group's vectors. Vectors of different lengths in a group raise."""
    size = F.max(F.size("embedding")).over(Window.partitionBy(by)) == F.min(F.size("embedding")).over(Window.partitionBy(by))
    checked = vectors.withColumn("embedding", F.when(size, F.col("embedding")).otherwise(F.raise_error(F.lit("DimensionMismatch")).cast("array<float>")))
    cells = checked.select(by, F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
    mean = cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    return mean.select(by, normalize("mean").alias("centroid"))


def variance(vectors: DataFrame, by: str) -> DataFrame:
    """(by, n, variance): the mean cosine distance to the centroid; 0 for fewer than two vectors."""
    joined = vectors.join(centroids(vectors, by), by)
    out = joined.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(cosine_distance("embedding", "centroid")).alias("v"))
    return out.select(by, "n", F.when(F.col("n") < 2, 0.0).otherwise(F.col("v")).alias("variance"))


def result_statistics(results: DataFrame, score: str = "similarity") -> DataFrame:
    """results(query_id, score) to (query_id, n, mean_surprisal, entropy): entropy over the scores' shares, shares of 0 skipped, 0 for a sum next to nothing."""
    total = F.sum(score).over(Window.partitionBy("query_id"))
    p = F.col(score) / F.col("total")
    parts = results.select("query_id", F.col(score), total.alias("total")).select("query_id", surprisal(clamp_similarity(score)).alias("s"), F.when((F.col("total") >= EPSILON) & (p > 0), -p * F.ln(p)).otherwise(0.0).alias("h"))
    return parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean_surprisal"), F.sum("h").alias("entropy"))
