"""Word-level differences of pairs of texts as short marked snippets, with neighbouring units where a change touches a border."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import ship

DELIMITER = " "


def changed(old: list[str], new: list[str]) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """The first and last word that a shortest edit script deletes and inserts. Common ends are set aside, the rest is Myers' greedy search."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    if not a or not b:
        span = lambda x: (head, head + len(x) - 1) if x else None
        return span(a), span(b)
    n, m = len(a), len(b)
    reach, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                break
        else:
            continue
        break
    gone, came, x, y = [], [], n, m
    for d in range(len(trace) - 1, 0, -1):
        before, k = trace[d], x - y
        down = k == -d or k != d and before.get(k - 1, -1) < before.get(k + 1, -1)
        k0 = k + 1 if down else k - 1
        x0 = before[k0]
        y0 = x0 - k0
        if down:
            came.append(y0)
        else:
            gone.append(x0)
        x, y = x0, y0
    span = lambda p: (head + min(p), head + max(p)) if p else None
    return span(gone), span(came)


def cut(text: str, most: int) -> str:
    """Its first `most` bytes, without a character that they cut."""
    return text.encode()[: max(0, most)].decode("utf-8", "ignore")


def excerpt(words: list[str], span: tuple[int, int] | None, most: int, context: int) -> str:
    """The span in [[ ]] with `context` words to either side; no span: the whole text is marked."""
    if not words:
        return ""
    a, b = span or (0, len(words) - 1)
    first, last = max(0, a - context), min(len(words) - 1, b + context)
    parts = [" ".join(words[first:a]), f"[[{' '.join(words[a : b + 1])}]]", " ".join(words[b + 1 : last + 1])]
    text = " ".join(p for p in parts if p)
    return cut("..." * (first > 0) + text + "..." * (last < len(words) - 1), most)


def focused_pair(previous: str | None, current: str | None, snippet_max: int = 400, context_tokens: int = 8) -> tuple[str, str]:
    old, new = (previous or "").split(), (current or "").split()
    if old == new:
        return cut(" ".join(old), snippet_max), cut(" ".join(new), snippet_max)
    gone, came = changed(old, new)
    return excerpt(old, gone, snippet_max, context_tokens), excerpt(new, came, snippet_max, context_tokens)


def boundary_sensitive(previous: str, current: str, threshold: int) -> bool:
    """Do both texts differ within `threshold` characters of either end?"""
    if not previous or not current or previous == current:
        return False
    least = min(len(previous), len(current))
    head = next((i for i in range(least) if previous[i] != current[i]), least)
    tail = next((i for i in range(least - head) if previous[-1 - i] != current[-1 - i]), least - head)
    return head <= threshold or tail <= threshold


def focused_pairs(pairs: DataFrame, previous: str = "previous", current: str = "current", snippet_max: int = 400, context_tokens: int = 8) -> DataFrame:
    """pairs with previous_snippet and current_snippet. A null text counts as empty."""
    ship(pairs.sparkSession)

    @F.pandas_udf("previous_snippet string, current_snippet string")
    def snippets(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([focused_pair(x, y, snippet_max, context_tokens) for x, y in zip(a, b)], columns=["previous_snippet", "current_snippet"])

    return pairs.withColumn("_s", snippets(pairs[previous], pairs[current])).select(*pairs.columns, "_s.previous_snippet", "_s.current_snippet")


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))


def stitched_pairs(previous_units: DataFrame, current_units: DataFrame, pairs: DataFrame, snippet_max: int = 400, context_tokens: int = 8, radius: int = 1, stitch_max: int = 4000, threshold: int = 20) -> DataFrame:
    """units(doc, id, position, text) and pairs(doc, previous_id, current_id) to pairs with snippets, stitched, and the ids and positions that were joined.

    Where a unit's change lies near its border, `radius` neighbours on each side join it before the texts are compared.
    """
    ship(pairs.sparkSession)
    w = Window.partitionBy("doc").orderBy("position", "id").rowsBetween(-radius, radius)

    def side(units: DataFrame, name: str) -> DataFrame:
        near = F.collect_list(F.struct("id", "position", _squeeze(F.col("text")).alias("text"))).over(w)
        return units.select("doc", F.col("id").alias(f"{name}_id"), _squeeze(F.col("text")).alias(f"_{name}"), near.alias(f"_near_{name}"))

    j = pairs.join(side(previous_units, "previous"), ["doc", "previous_id"], "left").join(side(current_units, "current"), ["doc", "current_id"], "left")

    @F.pandas_udf("boolean")
    def sensitive(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([boundary_sensitive(x or "", y or "", threshold) for x, y in zip(a, b)], dtype=bool)

    @F.pandas_udf("string")
    def first_bytes(a: pd.Series) -> pd.Series:
        return pd.Series([cut(x or "", stitch_max) for x in a], dtype=object)

    j = j.withColumn("_wide", sensitive("_previous", "_current"))
    for name in ("previous", "current"):
        own = F.filter(f"_near_{name}", lambda u: u["id"] == F.col(f"{name}_id"))  # noqa: B023
        used = F.coalesce(F.when(F.col("_wide"), F.col(f"_near_{name}")).otherwise(own), F.array().cast(dict(j.dtypes)[f"_near_{name}"]))
        j = j.withColumn(f"_used_{name}", used)
        joined = first_bytes(_squeeze(F.array_join(F.transform(f"_used_{name}", lambda u: u["text"]), DELIMITER)))
        j = j.withColumn(f"_text_{name}", F.coalesce(F.nullif(joined, F.lit("")), F.col(f"_{name}"), F.lit("")))
    j = focused_pairs(j, "_text_previous", "_text_current", snippet_max, context_tokens)
    ids = lambda n, f: F.transform(f"_used_{n}", lambda u: u[f])
    stitched = F.col("_wide") & ((F.size("_used_previous") > 1) | (F.size("_used_current") > 1))
    return j.select(*pairs.columns, "previous_snippet", "current_snippet", stitched.alias("stitched"), ids("previous", "id").alias("previous_ids"), ids("current", "id").alias("current_ids"), ids("previous", "position").alias("previous_positions"), ids("current", "position").alias("current_positions"))
