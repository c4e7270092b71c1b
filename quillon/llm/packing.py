"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights with knapsack pricing, then rounded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import lean, write_table
from quillon.llm.tokens import n_tokens

#: Pieces of one length class that are numbered together about: larger classes are parted by their counts, so that no task sorts a whole one.
PART_PIECES = 500_000
#: How often the linear program covers every class before it is scaled, how much of a class one step covers at most (less with less than 40 classes, as rounds are cheap then), and how fast weights fall.
COVERS, STEP, SHARP = 4.0, 0.25, 2.0


def _sums(f: np.ndarray, c: int) -> np.ndarray:
    """f[a] + f[c - a] for all a."""
    return f[: c + 1] + f[c::-1]


def price(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how many of each class make the most valuable bin. Sizes are in grid steps.

    best[k][c] is the most that 2 ** k pieces can be worth in room c; each is the (max, +) product of the one before with itself.
    """
    one = np.zeros(room + 1)
    np.maximum.at(one, size, value)
    who = np.full(room + 1, -1)
    for i in np.argsort(value, kind="stable"):
        if value[i] > 0:
            who[size[i]] = i
    for c in range(1, room + 1):
        if one[c - 1] >= one[c]:
            one[c], who[c] = one[c - 1], who[c - 1]
    best = [one]
    none = np.full(room, -np.inf)
    while 1 << (len(best) - 1) < room // max(1, int(size.min(initial=room))):
        f = best[-1]
        rest = np.lib.stride_tricks.sliding_window_view(np.concatenate([f[::-1], none]), room + 1)[::-1]  # [c][a]: f[c - a]
        best.append((rest + f).max(1))
    out, todo = np.zeros(len(size), np.int64), [(len(best) - 1, room)]
    while todo:
        k, c = todo.pop()
        if best[k][c] <= 0:
            continue
        if k == 0:
            out[who[c]] += 1
        else:
            a = int(_sums(best[k - 1], c).argmax())
            todo += [(k - 1, a), (k - 1, c - a)]
    return out


def solve(size: np.ndarray, count: np.ndarray, room: int, covers: float = COVERS, step: float = STEP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Covering configuration LP by multiplicative weights: min sum x_c so that every class is covered. ((configuration, x) pairs that cover, a lower bound of the program's value).

    Each round prices a piece by its class' weight over its count, finds the best bin for these prices, takes so much of
    it as covers `step` of some class, and lowers the weights of what it covers; a class that is covered `covers` times
    has no weight any more. In the end every class is, so all is divided by the least coverage. A step ends the round of
    one class at least, so there are at most classes * covers / step of them, whatever the counts. Prices under which no
    bin is worth more than 1 bound the value from below (duality).
    """
    step *= min(1.0, max(0.05, len(size) / 40))
    weight, covered, taken, bound = np.ones(len(size)), np.zeros(len(size)), {}, 0.0
    while (todo := covered < covers - 1e-9).any():
        value = np.where(todo, weight, 0.0) / count
        config = price(value, size, room)
        bound = max(bound, float((value * count).sum() / (value @ config)))
        # pieces that the class doesn't have make no part of a bin
        config = np.minimum(config, count)
        has = config > 0
        x = (count[has] / config[has]).min() * step
        part = x * config / count
        covered += part
        weight *= np.exp(-SHARP * part)
        weight /= weight[todo].max()
        key = config.tobytes()
        taken[key] = taken.get(key, 0.0) + x
    scale = 1 / covered.min(initial=np.inf) if len(size) else 1.0
    return [(np.frombuffer(k, np.int64), x * scale) for k, x in taken.items()], bound


def best_fit(size: np.ndarray, left: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """The bin that takes the largest class left, then always the largest that still fits, and how often it can be made."""
    config, free = np.zeros(len(size), np.int64), room
    for i in range(len(size) - 1, -1, -1):
        if size[i] <= free and left[i]:
            config[i] = min(left[i], free // size[i])
            free -= config[i] * size[i]
    has = config > 0
    return config, int((left[has] // config[has]).min())


def _fill(size: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    out, left = [], left.copy()
    while left.any():
        config, times = best_fit(size, left, room)
        left -= times * config
        out.append((config, times))
    return out


def plan(size: np.ndarray, count: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, times) pairs that hold exactly count[i] of every class i. The work depends on the number of classes alone, not on the counts.

    The program's bins are rounded so that what is cut from one is carried to the next (fullest first, then the most
    frequent), as far as there are pieces; what is left is packed best-fit. Should best-fit alone need fewer bins, its plan is taken.
    """
    order = np.argsort(size)
    size, count = size[order], count[order].astype(np.int64)
    left, out, carry = count.copy(), [], 0.0
    for config, x in sorted(solve(size, count, room)[0] if len(size) else [], key=lambda p: (-int(p[0] @ size), -p[1], p[0].tobytes())):
        has = config > 0
        times = min(int(x + carry + 1e-9), int((left[has] // config[has]).min()))
        carry = min(1.0, x + carry - times)
        if times:
            left -= times * config
            out.append((config, times))
    out += _fill(size, left, room)
    alone = _fill(size, count, room)
    if sum(t for _, t in alone) < sum(t for _, t in out):
        out = alone
    back = np.argsort(order)
    return [(c[back], t) for c, t in out]


def pack(docs: DataFrame, capacity: int = 2048, grid: int = 8, n_tokens_col: str | None = None) -> DataFrame:
    """Documents, cut where they exceed the capacity, in bins: (bin_id, doc_id, piece, start, n_tokens).

    A document longer than `capacity` is cut into full pieces and a rest; a piece covers n_tokens tokens from token
    `start` of its document. Every token of every document is in exactly one bin and no bin exceeds the capacity.
    Tokens are runs of non-white-space, or the counts that column n_tokens_col gives.

    The histogram of lengths, rounded up to multiples of `grid`, is all that reaches the driver (capacity / grid classes
    at most, each in parts of about PART_PIECES pieces); the linear program is solved and rounded there. Pieces are
    numbered inside (class, part), and their numbers give their bins: a shuffle of (id, length) rows and no join.
    Numbering is by doc_id, piece and length, hence the same in every run.

    Documents without tokens (null or empty text, null or negative counts) take no room and are in no bin. Rows that
    repeat or have a null doc_id are packed each. Texts of any length are cut, none is dropped. Extra columns are
    ignored. An empty table gives no rows.
    """
    if capacity < 1 or grid < 1 or capacity % grid:
        raise ValueError("capacity must be a positive multiple of grid")
    spark = docs.sparkSession
    n = (F.col(n_tokens_col).cast("long") if n_tokens_col else n_tokens()).alias("n")
    pieces = docs.select(F.col("doc_id").cast("long"), n).where("n > 0")
    pieces = pieces.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("piece", "start"))
    size = F.least(F.col("n") - F.col("start"), F.lit(capacity))
    pieces = write_table(pieces.select("doc_id", "piece", "start", size.alias("n_tokens"), F.ceil(size / grid).cast("int").alias("class")), "pieces")
    total = {r[0]: r[1] for r in pieces.groupBy("class").count().collect()}  # capacity / grid rows at most
    parts = [max(1, -(-total.get(c, 0) // PART_PIECES)) for c in range(capacity // grid + 1)]
    many = F.element_at(F.expr(f"array({', '.join(map(str, parts))})"), F.col("class") + 1)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), many).cast("int"))
    cells = {(r[0], r[1]): r[2] for r in pieces.groupBy("class", "part").count().collect()}
    classes = np.array(sorted(total), np.int64)
    count = np.array([total[c] for c in classes.tolist()], np.int64)
    before = {c: np.cumsum([0] + [cells.get((c, p), 0) for p in range(parts[c])])[:-1] for c in classes.tolist()}
    ranges: dict[int, list] = {c: [] for c in classes.tolist()}
    used, bins = np.zeros(len(classes), np.int64), 0
    for config, times in plan(classes, count, capacity // grid):
        for i in np.flatnonzero(config).tolist():
            ranges[int(classes[i])].append((used[i], bins, config[i]))
            used[i] += config[i] * times
        bins += times
    table = {c: tuple(np.array(x, np.int64) for x in zip(*r)) for c, r in ranges.items()}

    def run(batches):
        for batch in batches:
            cls, part, at = (batch.column(i).to_numpy() for i in range(3))
            where = np.empty(len(cls), np.int64)
            for c in np.unique(cls).tolist():
                own = cls == c
                begin, first, per = table[c]
                number = before[c][part[own]] + at[own] - 1
                i = np.searchsorted(begin, number, side="right") - 1
                where[own] = first[i] + (number - begin[i]) // per[i]
            yield pa.RecordBatch.from_arrays([pa.array(where), *batch.columns[3:]], names=["bin_id", "doc_id", "piece", "start", "n_tokens"])

    w = Window.partitionBy("class", "part").orderBy("doc_id", "piece", "n_tokens")
    numbered = pieces.select("class", "part", F.row_number().over(w).alias("at"), "doc_id", "piece", "start", "n_tokens")
    return numbered.mapInArrow(lean(run), "bin_id long, doc_id long, piece int, start long, n_tokens long")
