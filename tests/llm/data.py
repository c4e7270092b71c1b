"""Small document tables with all that operators must take: nulls, empty and long texts, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns of a table they must neither break nor change anything.
CLASH = ["_metadata", "_file", "_place", "class_id", "links", "rep", "lead", "_id", "_gone", "_chosen", "_chosen_source", "_host", "_path", "_prior", "_posterior", "_evidence", "_symbols", "_label", "_row", "n_tokens", "uid", "n", "q", "key", "slice", "batch", "block", "part", "class", "root", "source_", "pi", "x", "size", "title", "score", "rank", "level", "at", "b"]


def docs(spark, rows, clash: bool = False):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "web", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    return df


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def hard_rows(rng: random.Random) -> list[tuple]:
    """Null ids and texts, empty and blank ones, one word, repeated rows, characters of all kinds, a very long text."""
    same = words(rng, 30)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, same), (5, same), (6, same), (None, same), (None, None),
        (7, "é ü ß 漢字 😀 ́x"), (8, words(rng, 60_000)), (9, "!!! ... ???"), (10, "a\n\nb\n\n\nc"), (11, "ONE"), (12, words(rng, 8), None, None),
    ]


def taken(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
