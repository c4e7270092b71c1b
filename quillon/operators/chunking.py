"""Texts in chunks: by characters, tokens, sentences, and parents with children. One row a chunk: (id, index, content, start, end, byte_start, byte_end, kind, parent_index, overflow)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import ship
from quillon.sources.errors import ConfigurationError

_TOKEN = re.compile(r"[^ \t\n\x0c\r]+")
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
_SPACE = " \t\n\r"


def _check(most: int, overlap: int) -> None:
    if most < 1 or overlap < 0 or overlap >= most:
        raise ConfigurationError("a chunk must hold something, and more than the overlap")


def fixed_length(docs: DataFrame, max_length: int = 1000, overlap: int = 0, key: str = "id") -> DataFrame:
    """(key, index, content, start, end): windows of characters, each max_length - overlap after the last, as long as one begins inside the text. Stays in the JVM."""
    _check(max_length, overlap)
    n = F.length("text")
    starts = docs.where(n > 0).select(key, "text", F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(max_length - overlap))).alias("index", "start"))
    end = F.least(F.col("start") + max_length, F.length("text"))
    return starts.select(key, "index", F.substring("text", F.col("start") + 1, F.lit(max_length)).alias("content"), "start", end.alias("end"))


def token_windows(docs: DataFrame, max_tokens: int = 200, overlap: int = 0, key: str = "id") -> DataFrame:
    """(key, index, first, n_tokens): which tokens each window holds. Stays in the JVM; token_count() has the texts too."""
    from quillon.functions.text import count_tokens

    _check(max_tokens, overlap)
    n = docs.select(key, count_tokens("text").alias("n")).where("n > 0")
    first = n.select(key, "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(max_tokens - overlap).cast("long"))).alias("index", "first"))
    return first.select(key, "index", "first", F.least(F.col("n") - F.col("first"), F.lit(max_tokens)).cast("long").alias("n_tokens"))


def token_chunks(text: str, most: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Where windows of tokens begin and end in the text."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    return [(spans[i][0], spans[min(i + most, len(spans)) - 1][1]) for i in range(0, len(spans), max(1, most - overlap))]


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each sentence: up to a run of . ! ?, without the white space around it."""
    out = []
    for m in _SENTENCE.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _SPACE:
            a += 1
        while b > a and text[b - 1] in _SPACE:
            b -= 1
        if text[a:b].strip():
            out.append((a, b, len(_TOKEN.findall(text, a, b))))
    return out


def sentence_chunks(text: str, least: int = 50, most: int = 200, overlap: int = 20) -> list[tuple[str, int, int, bool]]:
    """(content, start, end, overflow): sentences packed up to `most` tokens; if the next doesn't fit and the chunk is still under `least`, it overflows. A longer sentence is cut by tokens. Trailing sentences of `overlap` tokens open the next chunk."""
    out: list[tuple[str, int, int, bool]] = []
    held: list[tuple[int, int, int]] = []
    size = 0

    def close(overflow: bool) -> None:
        nonlocal held, size
        out.append((" ".join(text[a:b] for a, b, _ in held), held[0][0], held[-1][1], overflow))
        kept, size = [], 0
        for s in reversed(held) if overlap else ():
            kept.insert(0, s)
            size += s[2]
            if size >= overlap:
                break
        held = kept

    for s in sentences(text):
        a, b, n = s
        if n > most:
            if held:
                close(False)
            out += [(text[a + x : a + y], a + x, a + y, True) for x, y in token_chunks(text[a:b], most, overlap)]
            continue
        if size + n > most and held:
            if size < least:
                held.append(s)
                close(True)
                continue
            close(False)
        held.append(s)
        size += n
    if held:
        out.append((" ".join(text[a:b] for a, b, _ in held), held[0][0], held[-1][1], False))
    return out


def parent_child_chunks(text: str, parent: int = 1024, child: int = 256) -> list[tuple[str, int, int, int | None]]:
    """(content, start, end, index of the parent): each parent, followed by its children."""
    out: list[tuple[str, int, int, int | None]] = []
    for a, b in token_chunks(text, parent):
        up = len(out)
        out.append((text[a:b], a, b, None))
        out += [(text[a + x : a + y], a + x, a + y, up) for x, y in token_chunks(text[a:b], child)]
    return out


_FIELDS = [("index", pa.int32(), "int"), ("content", pa.string(), "string"), ("start", pa.int64(), "long"), ("end", pa.int64(), "long"), ("byte_start", pa.int64(), "long"), ("byte_end", pa.int64(), "long"), ("kind", pa.string(), "string"), ("parent_index", pa.int32(), "int"), ("overflow", pa.bool_(), "boolean")]


def _chunked(docs: DataFrame, key: str, cut) -> DataFrame:
    """cut: text to (content, start, end, kind, parent, overflow) tuples. Null texts have no chunk."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                rows = cut(text) if text else []
                if not rows:
                    continue
                place, prefix, at = {}, 0, 0  # bytes before a character
                for p in sorted({p for r in rows for p in r[1:3]}):
                    prefix += len(text[at:p].encode("utf-8", "surrogatepass"))
                    place[p], at = prefix, p
                cols = [list(range(len(rows))), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [place[r[1]] for r in rows], [place[r[2]] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(i, 1)] * len(rows)), *(pa.array(c, f[1]) for c, f in zip(cols, _FIELDS))], names=[key, *(f[0] for f in _FIELDS)])

    return docs.select(key, "text").mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{n} {s}" for n, _, s in _FIELDS)]))


def token_count(docs: DataFrame, max_tokens: int = 200, overlap: int = 0, key: str = "id") -> DataFrame:
    _check(max_tokens, overlap)
    return _chunked(docs, key, lambda t: [(t[a:b], a, b, "tokens", None, False) for a, b in token_chunks(t, max_tokens, overlap)])


def sentence_token(docs: DataFrame, min_tokens: int = 50, max_tokens: int = 200, overlap: int = 20, key: str = "id") -> DataFrame:
    _check(max_tokens, overlap)
    return _chunked(docs, key, lambda t: [(c, a, b, "sentences", None, o) for c, a, b, o in sentence_chunks(t, min_tokens, max_tokens, overlap)])


def parent_child(docs: DataFrame, parent_size: int = 1024, child_size: int = 256, key: str = "id") -> DataFrame:
    if not 0 < child_size <= parent_size:
        raise ConfigurationError("a child must hold something and no more than its parent")
    return _chunked(docs, key, lambda t: [(c, a, b, "parent" if p is None else "child", p, False) for c, a, b, p in parent_child_chunks(t, parent_size, child_size)])
