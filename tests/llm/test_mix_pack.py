"""Cube-method mixing (5) and configuration-LP packing (8): balance, exactness, invariants."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import cube_mix, packing
from tests.llm.data import docs, hard_rows, taken, words


@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 1)), max_size=60), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_flight_keeps_both_totals(units, seed):
    size, x = [s for s, _ in units], [p for _, p in units]
    y = cube_mix.flight(list(range(len(x))), size, x, seed, False)
    assert sum(0 < p < 1 for p in y) <= 2
    assert abs(sum(y) - sum(x)) < 1e-4
    assert abs(sum(s * p for s, p in zip(size, y)) - sum(s * p for s, p in zip(size, x))) < 1e-4 * (1 + sum(size))
    landed = cube_mix.flight(list(range(len(x))), size, y, seed + 1, True)
    assert all(p in (0, 1) for p in landed)
    assert abs(sum(landed) - sum(x)) < 1 + 1e-4


def test_flight_keeps_expectations():
    rng = random.Random(0)
    size, x = [rng.randint(1, 50) for _ in range(12)], [rng.random() for _ in range(12)]
    n = 4000
    total = np.sum([cube_mix.flight(list(range(12)), size, x, s * 7919, True) for s in range(n)], axis=0) / n
    assert np.abs(total - x).max() < 5 * 0.5 / n**0.5


def source_rows(rng, counts: dict) -> list[tuple]:
    rows = []
    for s, n in counts.items():
        rows += [(len(rows) + i, words(rng, rng.randint(1, 60)), "en", s) for i in range(n)]
    return rows


def by_source(sample):
    n, t = Counter(), Counter()
    for _, s, k, _ in sample:
        n[s] += 1
        t[s] += k
    return n, t


@pytest.mark.parametrize("block", [20_000, 50])
def test_targets_are_met(spark, block):
    rows = source_rows(random.Random(1), {"hot": 1500, "mid": 300, "rare": 40, None: 60})
    sample = taken(cube_mix.mix(docs(spark, rows), block=block))
    tokens = defaultdict(int)
    for _, t, _, s in rows:
        tokens[s] += len(t.split())
    pi = {r[1]: r[3] for r in sample}
    n, t = by_source(sample)
    count = Counter(r[3] for r in rows)
    for s in tokens:
        assert abs(n[s] - pi[s] * count[s]) <= 1 + 1e-3
        assert abs(t[s] - pi[s] * tokens[s]) <= 2 * 60 + 1
    assert abs(sum(t.values()) - sum(tokens.values()) / 2) <= 2 * 60 * len(tokens)
    # in proportion to the square root of tokens, where a source has that much
    free = [s for s in tokens if pi[s] < 1]
    level = [pi[s] * tokens[s] / tokens[s] ** 0.5 for s in free]
    assert max(level) - min(level) < 1e-6 * max(level)
    assert len({r[0] for r in sample}) == len(sample)


def test_given_weights(spark):
    rows = source_rows(random.Random(2), {"a": 300, "b": 300, "c": 300})
    sample = taken(cube_mix.mix(docs(spark, rows), 0.3, weights={"a": 3.0, "b": 1.0}))
    n, t = by_source(sample)
    assert set(n) == {"a", "b"}
    assert abs(t["a"] - 3 * t["b"]) < 400
    assert taken(cube_mix.mix(docs(spark, rows), 0.3, weights={})) == []


def test_shares_at_the_ends(spark):
    rows = source_rows(random.Random(3), {"a": 30, "b": 10})
    assert len(taken(cube_mix.mix(docs(spark, rows), 1.0))) == 40
    assert taken(cube_mix.mix(docs(spark, rows), 0.0)) == []
    with pytest.raises(ValueError):
        cube_mix.mix(docs(spark, rows), 1.5)


def test_order_and_partitions_do_not_matter(spark):
    rows = source_rows(random.Random(4), {"a": 200, "b": 50})
    assert taken(cube_mix.mix(docs(spark, rows))) == taken(cube_mix.mix(docs(spark, rows[::-1]).repartition(3)))


def test_mix_hard_rows(spark):
    rows = hard_rows(random.Random(1)) + [(30, "", "en", "blank"), (31, None, "en", "blank"), (32, "x y", "en", "web"), (32, "x z", "en", "blog")]
    for clash in (False, True):
        d = docs(spark, rows, clash)
        sample = taken(cube_mix.mix(d))
        assert all(r[0] is not None and r[1] != "blank" for r in sample)
        assert len({r[:2] for r in sample}) == len(sample)
        kept = cube_mix.keep(d)
        assert kept.columns == d.columns
        chosen = {r[:2] for r in sample}
        wanted = sorted((i, s) for i, _, _, s in [(*r, "en", "web")[:4] if len(r) < 4 else r for r in rows] if (i, s) in chosen)
        assert sorted((r.doc_id, r.source) for r in kept.collect()) == wanted
    assert taken(cube_mix.mix(docs(spark, []))) == []
    assert cube_mix.keep(docs(spark, [])).collect() == []


def test_files_and_other_tables_keep_the_same_rows(spark, tmp_path):
    """Tables of files are filtered by row number, others by a join."""
    from quillon.llm import jaccard_join

    rng = random.Random(5)
    rows = source_rows(rng, {"a": 150, None: 30}) + hard_rows(rng)
    d = docs(spark, rows + rows[:9], clash=True)
    d.repartition(5).write.parquet(f"{tmp_path}/docs")
    files = spark.read.parquet(f"{tmp_path}/docs")
    assert files._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    for keep in (cube_mix.keep, jaccard_join.keep):
        a, b = keep(files), keep(files.where("true"))
        assert a.columns == b.columns == d.columns
        assert taken(a) == taken(b) and taken(a)


# --- packing --------------------------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 8)), min_size=1, max_size=8, unique_by=lambda p: p[0]), st.integers(20, 40))
@settings(max_examples=60, deadline=None)
def test_pricing_is_an_optimal_knapsack(classes, room):
    size, value = np.array(sorted(s for s, _ in classes)), np.array([float(v) for _, v in classes])
    config = packing.price(value, size, room)
    assert (config * size).sum() <= room
    best = [0.0] * (room + 1)
    for c in range(1, room + 1):
        best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(size, value) if s <= c)])
    assert abs((config * value).sum() - best[room]) < 1e-9


@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 300)), min_size=1, max_size=12, unique_by=lambda p: p[0]))
@settings(max_examples=30, deadline=None)
def test_plan_holds_every_piece_once(classes):
    size, count = np.array([s for s, _ in classes]), np.array([c for _, c in classes])
    total = np.zeros(len(size), np.int64)
    bins = 0
    for config, times in packing.plan(size, count, 32):
        assert (config * size).sum() <= 32 and times > 0
        total += config * times
        bins += times
    assert (total == count).all()
    assert bins >= -(-(size * count).sum() // 32)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    size = np.arange(1, 129)
    count = rng.integers(1, 2000, 128)
    bins = sum(t for _, t in packing.plan(size, count, 256))
    bound = (size * count).sum() / 256
    assert bins <= 1.01 * bound + 5


def best_fit_bins(size, count, room) -> int:
    return sum(t for _, t in packing._fill(np.sort(size), count[np.argsort(size)], room))


@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 500)), min_size=1, max_size=14, unique_by=lambda p: p[0]))
@settings(max_examples=40, deadline=None)
def test_the_program_covers_every_class_and_bounds_its_value(classes):
    size, count = np.array([s for s, _ in classes]), np.array([c for _, c in classes])
    order = np.argsort(size)
    size, count = size[order], count[order]
    pairs, bound = packing.solve(size, count, 32)
    covered = sum(x * c for c, x in pairs)
    assert (covered >= count * (1 - 1e-9)).all() and all((c * size).sum() <= 32 for c, _ in pairs)
    value = sum(x for _, x in pairs)
    volume = (size * count).sum() / 32
    assert volume <= value + 1e-6 and bound <= value + 1e-6
    assert value <= 1.2 * max(bound, volume) + len(size)  # a class of few pieces takes a bin
    assert sum(t for _, t in packing.plan(size, count, 32)) <= best_fit_bins(size, count, 32)


def test_the_program_beats_best_fit_where_that_is_off():
    """The classic bad case of decreasing fits: 11 bins for 9."""
    size = np.array([51, 27, 26, 23])
    for m in (1, 10, 1000):
        count = np.array([6, 6, 6, 12]) * m
        assert best_fit_bins(size, count, 100) == 11 * m
        assert sum(t for _, t in packing.plan(size, count, 100)) <= 1.02 * 9 * m + 1


def exact_bins(size: list[int], count: list[int], room: int) -> int:
    """Fewest bins by search over what each bin holds."""
    import functools

    @functools.cache
    def least(left: tuple) -> int:
        if not any(left):
            return 0
        top = max(i for i, c in enumerate(left) if c)
        found = []

        def grow(i, now, free):
            if i < 0:
                found.append(least(tuple(a - b for a, b in zip(left, now))))
                return
            for k in range(min(left[i], free // size[i]), -1 if i != top else 0, -1):
                grow(i - 1, (*now[:i], k, *now[i + 1 :]), free - k * size[i])

        grow(top, (0,) * len(left), room)
        return 1 + min(found)

    return least(tuple(count))


def test_plans_against_an_exact_solver():
    rng = random.Random(7)
    more = total = 0
    for _ in range(40):
        size = sorted(rng.sample(range(3, 17), 4))
        count = [rng.randint(1, 4) for _ in size]
        best = exact_bins(size, count, 20)
        bins = sum(t for _, t in packing.plan(np.array(size), np.array(count), 20))
        assert best <= bins <= best + 1
        more, total = more + bins - best, total + best
    assert more <= 0.05 * total


def check_bins(rows, packed, capacity: int):
    room, pieces = Counter(), defaultdict(list)
    for b, i, _, start, n in packed:
        room[b] += n
        pieces[i].append((start, n))
    assert max(room.values(), default=0) <= capacity
    assert sorted(room) == list(range(len(room)))
    want = Counter()
    for i, t, *_ in rows:
        n = len(t.split()) if t else 0
        for start in range(0, n, capacity):
            want[i, start, min(capacity, n - start)] += 1
    assert Counter((i, s, n) for i, p in pieces.items() for s, n in p) == want
    return room


def test_packing_is_exact_and_tight(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, int(rng.paretovariate(0.8) * 5) % 900 + 1)) for i in range(3000)]
    packed = taken(packing.pack(docs(spark, rows), 128, 8))
    room = check_bins(rows, packed, 128)
    assert len(room) <= 1.08 * sum(room.values()) / 128 + 5
    assert packed == taken(packing.pack(docs(spark, rows[::-1]).repartition(5), 128, 8))


def test_parts_of_classes_do_not_matter(spark, monkeypatch):
    rows = [(i, words(random.Random(i), 1 + i % 300)) for i in range(900)]
    whole = Counter(Counter(r[0] for r in packing.pack(docs(spark, rows), 128, 8).select("bin_id").collect()).values())
    monkeypatch.setattr(packing, "PART_PIECES", 7)
    packed = taken(packing.pack(docs(spark, rows), 128, 8))
    check_bins(rows, packed, 128)
    assert Counter(Counter(r[0] for r in packed).values()) == whole


def test_packing_hard_rows(spark):
    rows = [r[:2] for r in hard_rows(random.Random(1))]
    for clash in (False, True):
        check_bins(rows, taken(packing.pack(docs(spark, rows, clash), 2048)), 2048)
    assert taken(packing.pack(docs(spark, []))) == []
    assert taken(packing.pack(docs(spark, [(1, None), (2, "")]))) == []
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), 100, 8)


def test_packing_by_given_counts(spark):
    d = spark.createDataFrame([(1, 5), (2, -1), (3, None), (4, 0), (5, 30)], "doc_id long, k long")
    packed = taken(packing.pack(d, 16, 4, "k"))
    assert sorted((i, s, n) for _, i, _, s, n in packed) == [(1, 0, 5), (5, 0, 16), (5, 16, 14)]
