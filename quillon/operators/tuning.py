"""Prompt search: scoring as jobs over a table of samples, proposals as small loops on the driver; the language model is a function that is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.errors import ConfigurationError

Model = Callable[[Column], Column]
Writer = Callable[[str], str]
_MASK = (1 << 64) - 1


def exact_match(output: Column | str = "output", expected: Column | str = "expected") -> Column:
    """1 or 0; null without an expectation."""
    o, e = (F.col(c) if isinstance(c, str) else c for c in (output, expected))
    return F.when(e.isNotNull(), (F.trim(o) == F.trim(e)).cast("double"))


def substring_match(output: Column | str = "output", expected: Column | str = "expected") -> Column:
    o, e = (F.col(c) if isinstance(c, str) else c for c in (output, expected))
    return F.when(e.isNotNull(), o.contains(e).cast("double"))


def prompt_score(scores: Column | str = "score") -> Column:
    """The mean of what isn't null, minus infinity for nothing."""
    return F.coalesce(F.avg(scores), F.lit(float("-inf")))


def score_prompts(prompts: DataFrame, samples: DataFrame, model: Model, metric: Callable[[Column, Column], Column] = exact_match) -> DataFrame:
    """prompts(prompt_id, prompt) and samples(sample_id, input, expected) to (prompt_id, prompt, score). All prompts are scored in one job; they are few and go to the samples."""
    full = F.concat(F.col("prompt"), F.lit("\n\n"), F.col("input"))
    j = samples.crossJoin(F.broadcast(prompts)).withColumn("score", metric(model(full), F.col("expected")))  # broadcast: the candidates of one search
    return j.groupBy("prompt_id", "prompt").agg(prompt_score().alias("score"))


def select_best(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "prompt_id").limit(1)


def demo_text() -> Column:
    return F.when(F.col("expected").isNull(), F.concat(F.lit("Input: "), F.col("input"))).otherwise(F.concat(F.lit("Input: "), F.col("input"), F.lit("\nOutput: "), F.col("expected")))


def demo_sets(samples: DataFrame, count: int, size: int, seed: int = 0) -> DataFrame:
    """(demo_set, rank, sample_id, input, expected): `count` sets of `size` samples, each drawn by a hash."""
    draws = samples.withColumn("demo_set", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 0 else samples.withColumn("demo_set", F.lit(0)).where("false")
    w = Window.partitionBy("demo_set").orderBy(F.xxhash64("sample_id", "demo_set", F.lit(seed)), "sample_id")
    return draws.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).select("demo_set", "rank", "sample_id", "input", "expected")


def assemble_prompts(instructions: DataFrame, demos: DataFrame) -> DataFrame:
    """instructions(prompt_id, instruction) with every demo set: (prompt_id, demo_set, prompt); empty parts are left out."""
    texts = demos.groupBy("demo_set").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", demo_text().alias("t")))), lambda x: x["t"]).alias("demos"))
    parts = F.filter(F.concat(F.array("instruction"), "demos"), lambda x: x != "")
    return instructions.crossJoin(F.broadcast(texts)).select("prompt_id", "demo_set", F.array_join(parts, "\n\n").alias("prompt"))  # broadcast: as many rows as demo sets


def variants(prompt: str, count: int, writer: Writer) -> list[str]:
    """The prompt and up to `count` rewrites of it, each once."""
    ask = f"Make this prompt clearer and more effective.\n\n{prompt}\n\nBetter prompt:"
    return list(dict.fromkeys([prompt, *(writer(ask) for _ in range(count))]))


def _draws(seed: int):
    x = seed & _MASK
    while True:
        x = (x * 6364136223846793005 + 1442695040888963407) & _MASK
        yield x >> 33


def _scores(spark, prompts: list[str], samples: DataFrame, model: Model, metric) -> list[float]:
    table = spark.createDataFrame(list(enumerate(prompts)), "prompt_id int, prompt string")
    got = {r[0]: r[2] for r in score_prompts(table, samples, model, metric).collect()}  # a row a candidate
    return [got.get(i, float("-inf")) for i in range(len(prompts))]


def _needs_samples(samples: DataFrame) -> None:
    if samples.isEmpty():
        raise ConfigurationError("there must be samples")


def mipro(prompt: str, samples: DataFrame, model: Model, writer: Writer, metric=exact_match, proposals: int = 5, sets: int = 3, minibatch: int = 20, trials: int = 10, seed: int = 42) -> tuple[str, float]:
    """Rewrites of the instruction with sets of examples: first each with the first set, then random combinations; all are scored in one job over the first `minibatch` samples by id. (prompt, score) of the best, the first of equals."""
    _needs_samples(samples)
    spark = samples.sparkSession
    instructions = variants(prompt, proposals, writer)
    table = spark.createDataFrame(list(enumerate(instructions)), "prompt_id int, instruction string")
    made = {(r[0], r[1]): r[2] for r in assemble_prompts(table, demo_sets(samples, sets, minibatch, seed)).collect()}
    whole = lambda i, s: made.get((i, s), instructions[i])
    candidates = [whole(i, 0) for i in range(len(instructions))]
    draw = _draws(seed + 99)
    candidates += [whole(next(draw) % len(instructions), next(draw) % max(1, sets)) for _ in range(trials)]
    candidates = list(dict.fromkeys(candidates))
    scores = _scores(spark, candidates, samples.orderBy("sample_id").limit(max(1, minibatch)), model, metric)
    best = max(range(len(candidates)), key=lambda i: (scores[i], -i))
    return (candidates[best], scores[best]) if scores[best] > float("-inf") else (prompt, scores[best])


def gepa(prompt: str, samples: DataFrame, model: Model, writer: Writer, metric=exact_match, population: int = 4, iterations: int = 5, frontier: int = 3, feedback: int = 5, seed: int = 42) -> tuple[str, float]:
    """Evolves a population of prompts: rewrites by examples that aren't scored on; each round a parent of the best `frontier` has a child, and the worst goes."""
    _needs_samples(samples)
    spark = samples.sparkSession
    shown = samples.orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(feedback)
    lines = [f"Input: {r['input']}\nExpected: {r['expected'] if r['expected'] is not None else '(unknown)'}" for r in shown.collect()]
    rest = samples.join(shown.select("sample_id"), "sample_id", "left_anti")
    held = samples if rest.isEmpty() else rest

    def child(p: str) -> str:
        return writer(f"Make this prompt better by these examples.\n\n{p}\n\nExamples:\n" + "\n".join(lines) + "\n\nBetter prompt:")

    people = [*(child(prompt) for _ in range(population)), prompt]
    scored = list(zip(people, _scores(spark, people, held, model, metric)))
    draw = _draws(seed + 1)
    for _ in range(iterations):
        scored.sort(key=lambda x: -x[1])
        parent = scored[next(draw) % min(frontier, len(scored))][0]
        new = child(parent)
        scored = sorted([*scored, (new, _scores(spark, [new], held, model, metric)[0])], key=lambda x: -x[1])[: population + 1]
    return max(scored, key=lambda x: x[1])


def noop(prompt: str, *_, **__) -> tuple[str, None]:
    return prompt, None
