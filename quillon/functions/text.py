"""Tokens and text predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()
GAP_STOP_WORDS = "a an and are as at be by for from how in is of on or that the these this to what when where which who why with".split()
SUFFIXES = ("ing", "edly", "ed", "ly", "s")
#: White space of retrieval tokens.
ASCII_SPACE = "[ \\t\\n\\x0C\\r]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def suffix_stem(token: Column | str) -> Column:
    """Without the first of ing, edly, ed, ly, s that ends it, if anything is left."""
    t = _col(token)
    out = t
    for s in reversed(SUFFIXES):
        out = F.when((F.length(t) > len(s)) & t.endswith(s), t.substr(F.lit(1), F.length(t) - len(s))).otherwise(out)
    return out


def tokenize(text: Column | str, stem: bool = False, stop_words: list[str] | None = None, least: int = 2, most: int = 50, unicode: bool = False) -> Column:
    """Index terms: lower-cased runs of [a-z0-9] (with unicode, of letters, marks and digits), `least` to `most` long, stemmed if asked, without stop words; null for a null text."""
    stop = STOP_WORDS if stop_words is None else stop_words
    tokens = F.split(F.lower(_col(text)), "[^\\p{L}\\p{M}\\p{N}]+" if unicode else "[^a-z0-9]+")
    tokens = F.filter(tokens, lambda t: F.length(t).between(least, most))
    if stem:
        tokens = F.transform(tokens, suffix_stem)
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def count_tokens(text: Column | str) -> Column:
    """Tokens parted by ASCII white space."""
    return F.size(F.filter(F.split(_col(text), ASCII_SPACE), lambda t: t != "")).cast("long")


def gap_pattern(query: Column | str) -> Column:
    """What a query is counted as: its lower-cased alphanumeric words without stop words, or, if none is left, the trimmed lower-cased query; null for an empty one."""
    q = F.lower(F.trim(_col(query)))
    words = F.filter(F.split(q, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(GAP_STOP_WORDS))
    joined = F.array_join(words, " ")
    return F.nullif(F.when(joined != "", joined).otherwise(q), F.lit(""))
