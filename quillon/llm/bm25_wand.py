"""Exact BM25 top-k: a stored inverted index per shard with block maxima, block-max pruning inside a shard, exact merge under global statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import chunks, give_back, lean, to_batch, write_table
from quillon.llm.words import words

STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()
#: Documents of a shard at most (a partition's documents beyond that open another), tokens that a shard gathers before it is closed, documents of a block, queries that one pass over the index serves.
SHARD_DOCS, SHARD_TOKENS, BLOCK_DOCS, PASS_QUERIES = 65_536, 3_000_000, 64, 5_000

#: One row a term and shard; a shard's own row has no term, df documents, their ids in docs and their lengths in tfs.
INDEX = "shard long, term long, df int, docs binary, tfs binary, blocks binary"
_BLOCK = np.dtype([("block", "<i4"), ("n", "<i4"), ("tf", "<i4"), ("len", "<i4")])
_HITS = pa.schema([("q", pa.int32()), ("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' index terms and the text each is in: lower-cased runs of [a-z0-9], 2 to 50 long, without stop words."""
    h, size, off = words(texts, "ascii")
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    ok = (size >= 2) & (size <= 50)
    h, doc = h[ok], doc[ok]
    stop = np.sort(words(STOP_WORDS, "ascii")[0])
    ok = stop[np.minimum(np.searchsorted(stop, h), len(stop) - 1)] != h
    return h[ok], doc[ok]


def _pieces(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of an array that end at `ends` as binaries, without a copy each."""
    offsets = np.concatenate([[0], ends]) * x.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _indexer():
    """mapInArrow function: documents to their shards' postings, whatever will be asked."""

    def shard(number: int, parts: list) -> list[pa.RecordBatch]:
        ids, lens, term, doc, tf = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(term, kind="stable")
        term, doc, tf, lens = term[order], doc[order].astype(np.int32), tf[order].astype(np.int32), lens.astype(np.int32)
        at = np.flatnonzero(np.diff(term, prepend=term[:1] ^ np.uint64(1)) != 0)
        ends = np.append(at[1:], len(term)) if len(at) else at
        # a block's entry has what bounds its scores under any global figures: the most of a term, the shortest text
        of = np.repeat(np.arange(len(at)), ends - at)
        first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(doc // BLOCK_DOCS, prepend=-1) != 0))
        blocks = np.zeros(len(first), _BLOCK)
        if len(first):
            blocks["block"], blocks["n"] = doc[first] // BLOCK_DOCS, np.diff(np.append(first, len(doc)))
            blocks["tf"], blocks["len"] = np.maximum.reduceat(tf, first), np.minimum.reduceat(lens[doc], first)
        own = pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int64()), pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, lens)), pa.nulls(1, pa.binary())], names=["shard", "term", "df", "docs", "tfs", "blocks"])
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(term[at].view(np.int64)), pa.array((ends - at).astype(np.int32)), _pieces(doc, ends), _pieces(tf, ends), _pieces(blocks, np.searchsorted(first, ends))], names=own.schema.names)
        return [own, rows]

    def run(batches):
        from pyspark import TaskContext

        parts, n, held, number = [], 0, 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                if parts and (n + b - a > SHARD_DOCS or held > SHARD_TOKENS):
                    yield from shard(number, parts)
                    parts, n, held, number = [], 0, 0, number + 1
                h, doc = _tokens(texts[a:b])
                lens = np.bincount(doc, minlength=b - a)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.flatnonzero((np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0) | (np.diff(doc, prepend=-1) != 0))
                tf = np.diff(np.append(first, len(h)))
                parts.append((ids[a:b].astype(np.int64), lens, h[first], doc[first] + n, tf))
                n, held = n + b - a, held + len(first)
        if parts:
            yield from shard(number, parts)

    return lean(run)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs(doc_id, text), all terms of all documents (columns as in INDEX): one pass over the texts, for any queries and any number of searches."""
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return write_table(docs.mapInArrow(_indexer(), INDEX), "bm25-index")


def _expand(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges [begin, begin + size)."""
    skip = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.arange(size.sum()) + skip


def _searcher(names: list[int], queries: list[np.ndarray], idf: np.ndarray, terms: np.ndarray, avgdl: float, k: int, k1: float, b: float):
    """applyInArrow for one shard's row and its postings of the queries' terms: each query's k best documents of the shard, with exact global scores."""

    def search(table: pa.Table) -> pa.Table:
        own = table.filter(table["term"].is_null()).to_pylist()[0]
        ids, lens = np.frombuffer(own["docs"], np.int64), np.frombuffer(own["tfs"], np.int32)
        rows = table.filter(table["term"].is_valid())
        held = np.searchsorted(terms, rows["term"].to_numpy())
        df = rows["df"].to_numpy()
        docs, tfs = (np.frombuffer(b"".join(rows[c].to_pylist()), np.int32) for c in ("docs", "tfs"))
        each = [np.frombuffer(x, _BLOCK) for x in rows["blocks"].to_pylist()]
        entries = np.concatenate(each) if each else np.empty(0, _BLOCK)
        begins = np.concatenate([[0], np.cumsum(list(map(len, each)), dtype=np.int64)])
        n_blocks = len(ids) // BLOCK_DOCS + 1
        weight = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))
        of = np.repeat(idf[held], np.diff(begins))
        top, block, size = of * weight(entries["tf"], entries["len"]), entries["block"].astype(np.int64), entries["n"].astype(np.int64)
        first = np.cumsum(size) - size
        where = {int(t): i for i, t in enumerate(held)}
        out: list[tuple] = []
        for q, query in enumerate(queries):
            mine = [where[t] for t in query.tolist() if t in where]
            if not mine:
                continue
            entry = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in mine])
            bound = np.bincount(block[entry], weights=top[entry], minlength=n_blocks)
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] > 0]
            best_ids, best, done, step = np.empty(0, np.int64), np.empty(0), 0, 4
            while done < len(order):
                # WAND's test for a range of documents at once: what can't reach the k-th best score even with every term at its block's maximum is skipped, its postings unread
                least = best[-1] - 1e-9 if len(best) == k else -np.inf
                todo = order[done : done + step]
                todo = todo[bound[todo] >= least]
                if not len(todo):
                    break
                done, step = done + step, step * 2
                chosen = np.zeros(n_blocks, bool)
                chosen[todo] = True
                use = entry[chosen[block[entry]]]
                at = _expand(first[use], size[use])
                found, back = np.unique(docs[at], return_inverse=True)
                score = np.repeat(of[use], size[use]) * weight(tfs[at], lens[docs[at]])
                score = np.round(np.bincount(back, weights=score), 10)
                best, best_ids = np.concatenate([best, score]), np.concatenate([best_ids, ids[found]])
                keep = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[keep], best_ids[keep]
            ok = best > 0
            out.append((np.full(ok.sum(), q, np.int32), best_ids[ok], best[ok]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        give_back()
        return pa.Table.from_batches([to_batch(_HITS, q=cols[0], query_id=[names[i] for i in cols[0]], doc_id=cols[1], score=cols[2])])

    return search


def search(index: DataFrame, pairs: list[tuple[int, str]], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, text) queries, asked of a stored index: (query_id, doc_id, score to 6 places, rank). Of the index only the queries' terms are read."""
    spark = index.sparkSession
    own = index.where("term IS NULL")

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).cast(pa.int64())), pa.array([int(np.frombuffer(x, np.int32).sum()) for x in batch.column(1).to_pylist()], pa.int64())], names=["n", "total"])

    n, total = own.select("df", "tfs").mapInArrow(lengths, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    results = None
    for at in range(0, len(pairs) if n and total else 0, PASS_QUERIES):
        now = pairs[at : at + PASS_QUERIES]
        h, q = _tokens([t for _, t in now])
        terms, place = np.unique(h.view(np.int64), return_inverse=True)
        if not len(terms):
            continue
        queries = [np.unique(place[q == i]) for i in range(len(now))]
        asked = spark.createDataFrame(pa.table({"term": terms}))
        rows = index.join(F.broadcast(asked), "term", "left_semi")  # broadcast: the terms of PASS_QUERIES queries at most
        df = np.zeros(len(terms))
        for r in rows.groupBy("term").agg(F.sum("df")).collect():
            df[np.searchsorted(terms, r[0])] = r[1]
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5) + 1))
        hits = rows.select(*index.columns).unionByName(own).groupBy("shard").applyInArrow(_searcher([i for i, _ in now], queries, idf, terms, total / n, k, k1, b), "q int, query_id long, doc_id long, score double")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        hits = hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
        results = hits if results is None else results.unionByName(hits)
    return results if results is not None else spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, query_id: str = "item_id") -> DataFrame:
    """Each query's k best documents: (query_id, doc_id, score to 6 places, rank), best first, ties by doc_id.

    docs has doc_id and text, queries has query_id and text; other columns are ignored. A query is the set of its terms.
    (1) build_index() stores every partition's shards: for each term its documents, and for each block of BLOCK_DOCS
    documents what bounds its scores; (2) document count, mean length and the queries' document frequencies are summed
    over all shards; (3) every shard answers every query under those global figures, reading the postings of blocks
    alone whose bound reaches the k-th best score so far, and k rows a shard and query are merged. Nothing that is
    broadcast grows with the corpus: it is the queries' terms, at most PASS_QUERIES queries a pass; more take more passes.

    Rows with a null id or text are no documents; an empty text is one of length 0. A query without terms, with a null
    text or null id has no result. Each row of a repeated doc_id or query id counts as its own. Empty tables give no
    rows. The text of any length is used whole.
    """
    pairs = [(r[0], r[1]) for r in queries.where(F.col(query_id).isNotNull() & F.col("text").isNotNull()).select(query_id, "text").collect()]
    return search(build_index(docs), pairs, k, k1, b)


def brute_force(docs: list[tuple], queries: list[tuple], k: int = 10, k1: float = 1.2, b: float = 0.75) -> list[tuple]:
    """The same by scoring every document, in plain Python."""
    import math
    import re

    tok = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if 2 <= len(x) <= 50 and x not in STOP_WORDS]
    held = [(i, tok(t)) for i, t in docs if i is not None and t is not None]
    if not (total := sum(len(t) for _, t in held)):
        return []
    avg, out = total / len(held), []
    df: dict = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    for qid, text in queries:
        if qid is None or text is None:
            continue
        scores = []
        for i, t in held:
            s = sum(max(0, math.log((len(held) - df.get(x, 0) + 0.5) / (df.get(x, 0) + 0.5) + 1)) * t.count(x) * (k1 + 1) / (t.count(x) + k1 * (1 - b + b * len(t) / avg)) for x in set(tok(text)))
            if s > 0:
                scores.append((-round(s, 10), i))
        out += [(qid, i, round(-s, 6), n + 1) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return out


SQL = """
WITH stop AS (SELECT unnest(['{stop}']) AS t),
tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, t FROM tok WHERE length(t) BETWEEN 2 AND 50 AND t NOT IN (SELECT t FROM stop)),
len AS (SELECT d.doc_id, count(k.t) AS dl FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY 1),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM len),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM kept GROUP BY 1, 2),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM benchmark) WHERE length(t) BETWEEN 2 AND 50 AND t NOT IN (SELECT t FROM stop)),
s AS (SELECT q.item_id, tf.doc_id, round(sum(greatest(0::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 10) AS score
  FROM q JOIN tf ON tf.t = q.t JOIN df ON df.t = q.t JOIN len ON len.doc_id = tf.doc_id CROSS JOIN corpus GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id AS query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10
""".replace("{stop}", "','".join(STOP_WORDS))
