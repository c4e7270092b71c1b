"""Mixing sources to target weights by balanced sampling: the cube method's flight phase, block by block, then a small landing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import keep_joined, write_table
from quillon.llm.tokens import n_tokens

#: Units of one flight: larger sources fly in blocks, whose undecided units (two a block at most) fly again together.
BLOCK = 20_000
_TINY = 1e-9
_OUT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("pi", pa.float64()), ("x", pa.float64())])
_UNITS = "doc_id long, source string, n_tokens long, pi double, x double"


def draw(unit: int, turn: int, seed: int) -> float:
    """Uniform in [0, 1), a function of its arguments alone: a task that runs again draws the same."""
    m = (1 << 64) - 1
    x = (unit * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7 + 0x632BE59BD9B4E019) & m
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * c) & m
    return ((x ^ (x >> 33)) >> 11) / (1 << 53)


def flight(ids: list, size: list, x: list, seed: int, land: bool) -> list[float]:
    """Moves probabilities x to 0 and 1 so that their sum and the sum of size * x stay as they are.

    Three units that are still fractional have a direction that leaves both sums alone (the null space of two rows);
    the walk goes along it, forwards or backwards with the chances that keep every expectation, until one unit is decided,
    and takes the next. Two units at most stay fractional; landing then drops the size constraint (their sum stays),
    then the last unit is drawn by its probability.
    """
    x = [0.0 if p < _TINY else 1.0 if p > 1 - _TINY else p for p in x]
    open_, turn = [], 0
    todo = iter(i for i, p in enumerate(x) if 0 < p < 1)
    while True:
        while len(open_) < 3 and (i := next(todo, None)) is not None:
            open_.append(i)
        if len(open_) < 3 and not (land and len(open_)):
            break
        if len(open_) == 3:
            a, b, c = (size[i] for i in open_)
            u = [b - c, c - a, a - b] if a != b or b != c else [1.0, -1.0, 0.0]
        else:
            u = [1.0, -1.0] if len(open_) == 2 else [1.0]
        up = min(((1 - x[i]) / d if d > 0 else x[i] / -d) for i, d in zip(open_, u) if d)
        down = min((x[i] / d if d > 0 else (1 - x[i]) / -d) for i, d in zip(open_, u) if d)
        turn += 1
        step = up if draw(ids[open_[-1]] or 0, turn, seed) * (up + down) < down else -down
        for i, d in zip(open_, u):
            p = x[i] + step * d
            x[i] = 0.0 if p < _TINY else 1.0 if p > 1 - _TINY else p
        open_ = [i for i in open_ if 0 < x[i] < 1]
    return x


def _flier(seed: int, turn: int, land: bool):
    """applyInArrow function: one block's flight, its units in the order of a hash, so that the table's order doesn't matter."""

    def fly(table):
        key = [draw(i, -1, seed) for i in table["doc_id"].to_pylist()]
        table = table.append_column("key", pa.array(key, pa.float64())).sort_by([("key", "ascending"), ("doc_id", "ascending")])
        x = flight(table["doc_id"].to_pylist(), table["n_tokens"].to_pylist(), table["x"].to_pylist(), seed + turn, land)
        return pa.Table.from_arrays([*(table[c].combine_chunks() for c in ("doc_id", "source", "n_tokens", "pi")), pa.array(x, pa.float64())], schema=_OUT)

    return fly


def rates(totals: DataFrame, share: float, alpha: float, weights: dict[str, float] | None) -> DataFrame:
    """(source, pi): the inclusion probability of each source's documents. totals: (source, n_docs, tokens).

    The sample is to have `share` of all tokens, source s a part in proportion to its weight, which is tokens ** alpha, or
    what `weights` says (0 for a source that it doesn't name). A source that has fewer tokens than its part gives all of
    them, and the others make up for it in proportion.
    """
    if weights is None:
        weight = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    else:
        weight = F.coalesce(F.create_map(*[F.lit(v) for k, w in (weights or {"": 0.0}).items() for v in (k, float(w))])[F.col("source")], F.lit(0.0))
    t = totals.where("tokens > 0").withColumn("weight", weight)
    all_ = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # over the sources' totals, one row a source: those with the fewest tokens for their weight are the first to run out
    prior = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")).asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("source", "tokens", "weight", F.sum("tokens").over(all_).alias("t_all"), F.sum("weight").over(all_).alias("w_all"), F.coalesce(F.sum("tokens").over(prior), F.lit(0)).alias("t_prior"), F.coalesce(F.sum("weight").over(prior), F.lit(0.0)).alias("w_prior"))
    level = F.when((F.col("w_all") - F.col("w_prior") > 0) & (F.col("weight") > 0), (F.lit(share) * F.col("t_all") - F.col("t_prior")) / (F.col("w_all") - F.col("w_prior")))
    # the level of the first source that doesn't run out holds for all after it
    t = t.withColumn("level", level).withColumn("least", F.min(F.when(F.col("level") * F.col("weight") < F.col("tokens"), F.struct("w_prior", "level"))).over(all_)["level"])
    pi = F.when(F.col("weight") <= 0, 0.0).when(F.col("least").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("least") * F.col("weight") / F.col("tokens"))))
    return t.select("source", pi.alias("pi"))


def mix(docs: DataFrame, share: float = 0.5, alpha: float = 0.5, weights: dict[str, float] | None = None, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The sampled documents: (doc_id, source, n_tokens, pi), pi being the inclusion probability.

    In every source the number of documents is sum(pi) to within one, and the number of tokens its target to within
    what the two documents hold that the landing decides; what the sample holds of each source therefore follows the target weights
    (see rates) and not chance. Sources fly by themselves, large ones in blocks of about `block` documents by hash; the
    rounds end when every source is down to one block, which the landing finishes. Only (id, source, tokens) rows move.

    A null source is a source like others. A null text has 0 tokens; a document of 0 tokens (an empty one too) is sampled
    with its source's pi; a source without any token is left out. Rows of one doc_id and source count as one document of
    their summed tokens; rows with a null id are left out. Extra columns are ignored; empty tables give no rows.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be between 0 and 1")
    null = "\0null"
    units = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit(null)).alias("source"), n_tokens().alias("n_tokens"))
    units = write_table(units.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens")), "units")
    pi = rates(units.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens")), share, alpha, weights)
    now = units.join(pi, "source").select("doc_id", "source", "n_tokens", "pi", F.col("pi").alias("x"))
    most = max([r[0] for r in units.groupBy("source").count().select(F.max("count")).collect() if r[0]], default=0)
    done, turn = None, 0
    while True:
        land, n = most <= block, F.lit(max(1, -(-most // block)))

        flown = now.groupBy("source", F.pmod(F.xxhash64("doc_id", F.lit(seed + turn)), n).alias("block")).applyInArrow(_flier(seed, turn, land), _UNITS)
        if not land:
            flown = write_table(flown, "flight")
        decided = flown.where("x = 1")
        done = decided if done is None else done.unionByName(decided)
        if land:
            break
        now = flown.where("x > 0 AND x < 1")
        most = max([r[0] for r in now.groupBy("source").count().select(F.max("count")).collect() if r[0]], default=0)
        turn += 1
    return done.select("doc_id", F.nullif("source", F.lit(null)).alias("source"), "n_tokens", "pi")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns as they were, that mix() samples; rows of one doc_id and source go together."""
    chosen = write_table(mix(docs, **options).select(F.col("doc_id").alias("_chosen"), F.col("source").alias("_chosen_source")), "chosen")
    return keep_joined(docs, ["doc_id", "source"], lambda d: d.join(chosen, (d["doc_id"] == chosen["_chosen"]) & d["source"].cast("string").eqNullSafe(chosen["_chosen_source"]), "left_semi"))
