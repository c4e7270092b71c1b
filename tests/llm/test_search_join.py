"""BM25 top-k (2) and the n-gram Jaccard join (3) against brute force."""

import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from quillon.llm import bm25_wand, jaccard_join
from tests.llm.data import docs, hard_rows, taken, words


def grams(text: str, n: int = 3) -> frozenset:
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows, t: float, n: int = 3) -> dict:
    """All pairs of ids by the documented rule: copies with their representative, representatives with each other."""
    sets = [(i, grams(x, n)) for i, x in rows if i is not None and x is not None]
    rep: dict = {}
    for i, s in sets:
        if s:
            rep[s] = min(i, rep.get(s, i))
    out: dict = {}

    def add(a, b, j):
        if a != b:
            k = (min(a, b), max(a, b))
            out[k] = max(out.get(k, 0), round(j, 6))

    for i, s in sets:
        if s:
            add(i, rep[s], 1.0)
    items = list(rep.items())
    for k, (s, i) in enumerate(items):
        for o, j in items[:k]:
            inter = len(s & o)
            if inter and inter / (len(s) + len(o) - inter) >= t - 1e-12:
                add(i, j, inter / (len(s) + len(o) - inter))
    return out


def mutated(rng, text: str, share: float) -> str:
    return " ".join(f"x{rng.randrange(10_000)}" if rng.random() < share else w for w in text.split())


def corpus(rng, n: int = 250) -> list[tuple]:
    rows = [(i, words(rng, rng.choice([1, 2, 3, 4, 6, 10, 40, 300]), 5000)) for i in range(n)]
    for i in range(n, 2 * n):
        rows.append((i, mutated(rng, rows[rng.randrange(i)][1], rng.choice([0, 0.02, 0.05, 0.1, 0.2]))))
    shared = words(rng, 60, 5000)
    rows += [(2 * n + i, words(rng, 30, 5000) + " " + shared) for i in range(40)]  # a passage that many share
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_jaccard_is_exact(spark, t):
    rows = corpus(random.Random(int(t * 10)))
    got = {(a, b): j for a, b, j in taken(jaccard_join.similar_pairs(docs(spark, rows).repartition(3, "doc_id"), t))}
    assert got == jaccard_brute(rows, t)
    assert t == 1.0 or len(got) > 100


@pytest.mark.parametrize("light_to", [-1, 0, 12, 99])
def test_any_boundary_gives_the_same_pairs(spark, monkeypatch, light_to):
    """Only subsets, only lists, or both: the boundary moves costs, not results."""
    rows = corpus(random.Random(5), 120)
    monkeypatch.setattr(jaccard_join, "boundary", lambda costs: light_to)
    got = {(a, b): j for a, b, j in taken(jaccard_join.similar_pairs(docs(spark, rows)))}
    assert got == jaccard_brute(rows, 0.5)


def pairs_brute(rows, t: float) -> dict:
    """Every row with every other."""
    sets = [(i, s) for i, x in rows if i is not None and x is not None and (s := grams(x))]
    out: dict = {}
    for k, (a, s) in enumerate(sets):
        for b, o in sets[:k]:
            inter = len(s & o)
            if a != b and inter and (j := inter / (len(s) + len(o) - inter)) >= t - 1e-12:
                out[min(a, b), max(a, b)] = max(out.get((min(a, b), max(a, b)), 0), round(j, 6))
    return out


def classes_brute(rows, t: float = 0.5) -> list[tuple]:
    """(doc_id, class_id, links) by comparing every row with every other."""
    sets = [(i, grams(x) if x else frozenset()) for i, x in rows if i is not None]
    links, parent = {i: 0 for i, _ in sets}, {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, o in sets[:k]:
            inter = len(s & o)
            if inter and inter / (len(s) + len(o) - inter) >= t - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, find(i), n) for i, n in links.items())


@pytest.mark.parametrize("small", [False, True])
def test_classes_and_links_are_exact(spark, monkeypatch, small):
    """small: many batches, slices and blocks, dense groups cut both ways."""
    if small:
        for k, v in (("PACK_ENTRIES", 400), ("SLICE_BYTES", 3000), ("SLICE_POSTINGS", 300), ("BLOCK_PAIRS", 20), ("AT_ONCE", 50), ("PACK_POSTINGS", 100)):
            monkeypatch.setattr(jaccard_join, k, v)
    rng = random.Random(6)
    rows = corpus(rng, 80)
    rows += [(1000 + i, rng.choice(rows[:12])[1]) for i in range(60)]  # groups of copies beside near copies
    base = words(rng, 60, 5000)
    rows += [(1100 + i, mutated(rng, base, 0.03)) for i in range(60)]  # a dense group of different texts
    # an id with two texts that are similar, and copies of either; and two that are not
    rows += [(2000, "a b c d e f"), (2000, "a b c d e g"), (2001, "a b c d e f"), (2002, "a b c d e g"), (3000, "p q r s"), (3000, "t u v w"), (3001, "p q r s"), (3002, "t u v w")]
    rows += [(r[0], r[1]) for r in hard_rows(random.Random(1))] + [(20, "One!")]
    for clash in (False, True):
        got = [tuple(r) for r in taken(jaccard_join.ngram_jaccard_join(docs(spark, rows, clash).repartition(3, "doc_id")).select("doc_id", "class_id", "links"))]
        assert sorted(got) == classes_brute(rows)
    by = {i: c for i, c, _ in got}
    assert by[2001] == by[2002] == 2000 and by[3001] == by[3002] == 3000 and by[20] == by[11] == 4


def test_classes_of_empty_tables(spark):
    assert taken(jaccard_join.ngram_jaccard_join(docs(spark, []))) == []
    assert taken(jaccard_join.ngram_jaccard_join(docs(spark, [(None, "a b c d"), (1, None), (2, ""), (2, "")]))) == [(1, 1, 0), (2, 2, 0)]


def test_counting_sends_few_bytes(spark):
    """48-bit hashes with their places took 5.4 bytes an n-gram to the slices, and as many back if it was shared."""
    rng = random.Random(9)
    d = docs(spark, [(i, words(rng, 300, 5000)) for i in range(1000)]).coalesce(1)
    n_grams = sum(len(grams(r[1])) for r in d.select("doc_id", "text").collect())
    bits = (n_grams.bit_length()) + jaccard_join.NAME_BITS
    sent = d.select("doc_id", "text").mapInArrow(jaccard_join._pack(3, 4, bits), jaccard_join._S1)
    back = sent.groupBy("slice").applyInArrow(jaccard_join._count, jaccard_join._S2)
    size = lambda df, names: sum(len(x) for r in df.select(*names).collect() for x in r)
    assert size(sent, ("grams", "many", "counts")) < 2 * n_grams
    assert size(back, ("shared",)) < n_grams / 6


def test_ascending_numbers_come_back():
    rng = np.random.default_rng(4)
    for top in (1, 2, 1000, 1 << 20, 1 << 44):
        for size in (0, 1, 2, 9, 900):
            x = np.unique(rng.integers(0, top, size).astype(np.uint64))
            assert jaccard_join.unsparse(jaccard_join.sparse(x)).tolist() == x.tolist()


def test_texts_that_change_between_passes_are_an_error(spark, monkeypatch):
    """The second pass must see the rows that were counted."""
    monkeypatch.setattr(jaccard_join, "rereadable", lambda df: True)
    other = F.udf(lambda: str(uuid.uuid4())).asNondeterministic()
    moving = docs(spark, [(i, f"a{i} b c d e") for i in range(50)]).withColumn("text", F.concat("text", F.lit(" "), other()))
    with pytest.raises(Exception, match="other texts than when it was counted"):
        jaccard_join.ngram_jaccard_join(moving.select("doc_id", "text")).collect()


def test_places_and_hashes_come_back():
    rng = np.random.default_rng(3)
    for top in (1, 200, 256, 257, 3000, 60_000, 65_536):
        for size in (0, 1, 7, 500):
            x = rng.integers(0, top, size).astype(np.uint16)
            assert jaccard_join.unpack_places(jaccard_join.pack_places(x)).tolist() == x.tolist()
            h = rng.integers(0, 1 << 48, size).astype(np.uint64)
            assert jaccard_join.eight_bytes(jaccard_join.six_bytes(h)).tolist() == h.tolist()
            assert jaccard_join.raw_unplanes(jaccard_join.raw_planes(h), np.uint64).tolist() == h.tolist()
    assert len(jaccard_join.pack_places(np.arange(2000).astype(np.uint16))) < 2800


@pytest.mark.parametrize("light_to, most", [(-1, 2500), (99, 20_000)])
def test_runs_of_common_ngrams_give_few_repeats(light_to, most):
    """By lists and by subsets: a pair came once a common n-gram or subset (3,685 and 42,984 rows here); every similar pair must still be one."""
    rng = np.random.default_rng(5)
    base = [np.sort(rng.choice(10_000, 60, replace=False)) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(60) < rate, rng.integers(0, 10_000, 60), base[k % 4])) for k in range(24) for rate in (0.02, 0.3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([len(x) for x in sets]), pa.array([jaccard_join.six_bytes(x.astype(np.uint64)) for x in sets], pa.binary())], names=["uid", "n", "tokens"])
    made = pa.Table.from_batches(jaccard_join._postings(0.5, light_to, 500)([batch]))
    rows, pairs = 0, set()
    for s in sorted(set(made["slice"].to_pylist())):
        for out in jaccard_join._candidates(0.5)(iter(made.filter(pa.compute.equal(made["slice"], s)).to_batches())):
            rows, pairs = rows + out.num_rows, pairs | set(zip(out["b"].to_pylist(), out["o"].to_pylist()))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert both / (len(sets[a]) + len(sets[b]) - both) < 0.5 or (a, b) in pairs
    assert rows < most


def test_written_tables_leave_no_shuffle_files(spark):
    import glob

    from quillon.sources.workspace import write_table

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    there = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = there()
    lazy = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count()
    table = write_table(lazy, "counts")
    assert sorted(table.collect()) == sorted(lazy.collect())
    lazy.write.format("noop").mode("overwrite").save()
    known = there()
    write_table(spark.range(1000).selectExpr("id % 9 AS k", "id").groupBy("k").count(), "counts")
    assert there() <= known and known != before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_forest_is_components(n):
    import numpy as np

    rng = np.random.default_rng(n)
    for m in (0, n, 3 * n):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for _ in range(n):
            for a, b in zip(x, y):
                label[a] = label[b] = min(label[a], label[b])
        assert jaccard_join._forest(x, y, n).tolist() == label


def test_boundary_has_least_cost():
    costs = {0: (1.0, 9.0), 4: (2.0, 9.0), 8: (50.0, 5.0)}
    assert jaccard_join.boundary(costs) == 4
    assert jaccard_join.boundary({}) == -1
    assert jaccard_join.boundary({3: (9.0, 1.0)}) == -1


def test_jaccard_hard_rows(spark):
    rows = [(r[0], r[1]) for r in hard_rows(random.Random(1))] + [(20, "One!"), (21, "a b c d"), (21, "a b c e"), (22, "a b c d")]
    for clash in (False, True):
        got = {(a, b): j for a, b, j in taken(jaccard_join.similar_pairs(docs(spark, rows, clash)))}
        assert got == jaccard_brute(rows, 0.5)
    assert (4, 11) in got and (5, 6) in got and (5, 5) not in got


def test_jaccard_empty_and_all_null(spark):
    assert taken(jaccard_join.similar_pairs(docs(spark, []))) == []
    assert taken(jaccard_join.similar_pairs(docs(spark, [(None, "a b c d"), (1, None)]))) == []
    with pytest.raises(ValueError):
        jaccard_join.similar_pairs(docs(spark, []), 0)


def test_thousands_of_copies_cost_a_row_each(spark):
    rng = random.Random(2)
    base = words(rng, 50)
    rows = [(i, base) for i in range(3000)] + [(i, mutated(rng, base, 0.01)) for i in range(3000, 3200)]
    pairs = jaccard_join.similar_pairs(docs(spark, rows))
    assert sum(1 for a, b, j in taken(pairs) if a == 0 and b < 3000) == 2999
    kept = {r[0] for r in jaccard_join.keep(docs(spark, rows)).select("doc_id").collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in jaccard_brute(rows, 0.5):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert kept == {i for i, _ in rows if find(i) == i}


def test_keep_leaves_one_of_each_group_and_all_columns(spark):
    rows = [(r[0], r[1]) for r in hard_rows(random.Random(1))]
    d = docs(spark, rows, clash=True)
    out = jaccard_join.keep(d)
    assert out.columns == d.columns
    ids = sorted((r[0] is not None, r[0] or 0) for r in out.select("doc_id").collect())
    # 6 is a copy of 5 and 11 of 4; both rows of 5 stay, as do rows without an id
    assert ids == sorted((i is not None, i or 0) for i, _ in rows if i not in (6, 11))
    assert jaccard_join.keep(docs(spark, [])).count() == 0


# --- BM25 -----------------------------------------------------------------------------------------------------------


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 3, 10])
def test_bm25_matches_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(bm25_wand, "SHARD_DOCS", 90)  # several shards a partition
    monkeypatch.setattr(bm25_wand, "BLOCK_DOCS", 8)
    rng = random.Random(k)
    rows = [(i, words(rng, rng.choice([1, 5, 20, 200]), 300)) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(20)]  # ties
    queries = [(i, words(rng, rng.choice([1, 2, 8]), 300)) for i in range(40)]
    got = taken(bm25_wand.bm25_topk(docs(spark, rows), items(spark, queries), k))
    assert got == sorted(bm25_wand.brute_force(rows, queries, k), key=repr)


def test_bm25_passes_of_queries(spark, monkeypatch):
    monkeypatch.setattr(bm25_wand, "PASS_QUERIES", 7)
    rng = random.Random(9)
    rows, queries = [(i, words(rng, 20, 100)) for i in range(200)], [(i, words(rng, 3, 100)) for i in range(20)]
    got = taken(bm25_wand.bm25_topk(docs(spark, rows), items(spark, queries), 4))
    assert got == sorted(bm25_wand.brute_force(rows, queries, 4), key=repr)


def test_one_index_serves_many_searches(spark, monkeypatch):
    """The stored index knows no query; its block bounds hold whatever is asked, and blocks that can't matter aren't read."""
    monkeypatch.setattr(bm25_wand, "BLOCK_DOCS", 8)
    rng = random.Random(11)
    rows = [(i, words(rng, rng.choice([5, 50]), 200)) for i in range(500)]
    index = bm25_wand.build_index(docs(spark, rows))
    for k in (1, 5):
        queries = [(i, words(rng, 4, 200)) for i in range(15)]
        assert taken(bm25_wand.search(index, queries, k)) == sorted(bm25_wand.brute_force(rows, queries, k), key=repr)
    assert taken(bm25_wand.search(index, queries, 3, 0.9, 0.4)) == sorted(bm25_wand.brute_force(rows, queries, 3, 0.9, 0.4), key=repr)
    read = []
    plain = bm25_wand._expand
    monkeypatch.setattr(bm25_wand, "_expand", lambda begin, size: read.append(size.sum()) or plain(begin, size))
    terms = sorted({t for _, q in queries for t in q.split()})
    h = np.unique(bm25_wand._tokens(terms)[0].view(np.int64))
    table = index.toArrow()
    one = table.filter(pa.compute.and_(pa.compute.equal(table["shard"], table["shard"][0]), pa.compute.or_kleene(table["term"].is_null(), pa.compute.is_in(table["term"], pa.array(h)))))
    every = sum(x for x, t in zip(one["df"].to_pylist(), one["term"].to_pylist()) if t is not None)
    # a rare term and a common one: once a document with the rare one is found, blocks without it can't matter
    df = np.array([sum(x for x, t in zip(one["df"].to_pylist(), one["term"].to_pylist()) if t == v) for v in h.tolist()])
    query, idf = np.array([int(np.argmin(np.where(df > 0, df, 1 << 30))), int(np.argmax(df))]), np.log(1 + 500 / (1 + df))
    bm25_wand._searcher([0], [query], idf, h, 20.0, 1, 1.2, 0.75)(one)
    assert 0 < sum(read) < df[query].sum() < every


def test_bm25_hard_rows(spark):
    rows = hard_rows(random.Random(1))
    plain = [(r[0], r[1]) for r in rows]
    queries = [(1, "one"), (2, None), (3, ""), (4, "the of"), (None, "one"), (5, "w1 w2"), (5, "w3"), (6, "nowhere")]
    for clash in (False, True):
        got = taken(bm25_wand.bm25_topk(docs(spark, rows, clash), items(spark, queries), 3))
        assert got == sorted(bm25_wand.brute_force(plain, queries, 3), key=repr)
    assert {r[0] for r in got} == {1, 5}


def test_bm25_empty_tables(spark):
    assert taken(bm25_wand.bm25_topk(docs(spark, []), items(spark, [(1, "one")]))) == []
    assert taken(bm25_wand.bm25_topk(docs(spark, [(1, "one")]), items(spark, []))) == []
    assert taken(bm25_wand.bm25_topk(docs(spark, [(1, ""), (2, None)]), items(spark, [(1, "one")]))) == []
