"""Document fingerprints by locally consistent parsing: deterministic coin tossing cuts a text into phrases, level by level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import CHUNK_CHARS, chunks, lean, to_batch
from quillon.llm.words import mix

_RUN, _PLACE, _LEN = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x8CB92BA72F3D8DD7)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_levels", pa.int32()), ("root", pa.int64()), ("signatures", pa.list_(pa.int64())), ("lower", pa.list_(pa.list_(pa.int64())))])
SCHEMA = "doc_id long, n_chars long, n_levels int, root long, signatures array<long>, lower array<array<long>>"
#: The lowest level whose names are given; below, a name is a character or about three.
LOWEST = 2


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit in which a label differs from its left neighbour's, plus that bit. Neighbours that differ stay different."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = ~label[first]
    diff = label ^ left
    low = diff & (~diff + label.dtype.type(1))
    place = np.minimum(np.bitwise_count(low - label.dtype.type(1)), label.dtype.itemsize * 8 - 1)
    bit = (label >> place.astype(label.dtype)).astype(np.uint8) & np.uint8(1)
    return (place << np.uint8(1)) | bit


def level_up(sym: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level's phrases. sym: the symbols of several non-empty texts in a row, begin: where each text begins.

    Runs of one symbol become one; four rounds of tossing turn 64-bit symbols into labels under 6; a phrase begins at
    every label greater than both its neighbours (and at a text's start), so where it begins depends on a few symbols
    around it alone. A phrase's name is a hash of its symbols in order: the same everywhere, without a dictionary.
    """
    head = np.zeros(len(sym), bool)
    head[begin] = True
    new = head.copy()
    new[1:] |= sym[1:] != sym[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(sym))).astype(np.uint64)
    sym, head = sym[at], head[at]
    if (many := size > 1).any():
        sym = sym.copy()
        sym[many] = mix(sym[many] + size[many] * _RUN)
    first = np.flatnonzero(head)
    label = _toss(sym, first)
    for _ in range(3):
        label = _toss(label, first)
    left, right = np.zeros(len(label), np.int8), np.zeros(len(label), np.int8)
    value = label.astype(np.int8)
    left[1:], right[:-1] = value[:-1], value[1:]
    left[first] = -1
    right[first[1:] - 1] = -1
    right[-1:] = -1
    start = np.flatnonzero(((value > left) & (value > right)) | head)
    size = np.diff(np.append(start, len(sym)))
    place = (np.arange(len(sym)) - np.repeat(start, size)).astype(np.uint64)
    name = mix(np.add.reduceat(mix(sym + (place + np.uint64(1)) * _PLACE), start) + size.astype(np.uint64) * _LEN)
    return name, np.searchsorted(start, first)


def parse(texts: list[str], level: int) -> tuple[list, list, list]:
    """For each text (none empty): its levels up to a single name, that name, and the distinct names at `level` (or at its top, if that is lower), sorted."""
    levels, root, names = parse_levels(texts, [level])
    return levels, root, names[0]


def parse_levels(texts: list[str], wanted: list[int]) -> tuple[list, list, list[list]]:
    """parse() for several levels at once: the names by level, then by text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    sym = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    begin, alive = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.arange(len(texts))
    levels, root, names = [0] * len(texts), [0] * len(texts), [[None] * len(texts) for _ in wanted]
    depth = 0
    while len(alive):
        size = np.diff(np.append(begin, len(sym)))
        done = size == 1
        for level, found in zip(wanted, names):
            for i in np.flatnonzero(done if depth != level else np.ones(len(alive), bool)):
                if found[alive[i]] is None:
                    found[alive[i]] = np.unique(sym[begin[i] : begin[i] + size[i]].view(np.int64))
        for i in np.flatnonzero(done):
            levels[alive[i]], root[alive[i]] = depth, int(sym[begin[i] : begin[i] + 1].view(np.int64)[0])
        if done.any():
            sym, alive, size = sym[np.repeat(~done, size)], alive[~done], size[~done]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else begin[:0]
        if len(alive):
            sym, begin = level_up(sym, begin)
            depth += 1
    return levels, root, names


_NONE = np.empty(0, np.int64)


def _lists(rows: list[list[np.ndarray]]) -> pa.ListArray:
    """Rows of arrays as a list of lists."""
    parts = [x for r in rows for x in r]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(list(map(len, sizes)), dtype=np.int64)]), pa.int32())
    return pa.ListArray.from_arrays(ends(rows), pa.ListArray.from_arrays(ends(parts), pa.array(np.concatenate([_NONE, *parts]), pa.int64())))


def fingerprints(docs: DataFrame, level: int = 4) -> DataFrame:
    """One row a document: (doc_id, n_chars, n_levels, root, signatures, lower).

    root names the whole text: equal texts, and (but for 64-bit collisions) only those, have equal roots at equal
    n_levels. signatures are the distinct names of its phrases at `level` (about 3 ** level characters each), sorted: a
    passage that two documents share, at whatever offsets, gives both the same names, but for a few phrases at its ends.
    Of a short passage (about 50 words or less) those few may be all; so lower has the names of the levels from LOWEST to
    below `level`, a list each, where phrases are shorter: about 9 characters at level 2, 27 at level 3.

    Whole texts of any length; one pass without a shuffle, and nothing is held beyond a batch. Null and empty texts
    have n_levels 0, a null root and no signatures; n_chars is null for a null text. Null ids, repeated rows and extra
    columns: every input row gives one row with its doc_id; other columns are ignored. An empty table gives none.
    """

    wanted = [level, *range(LOWEST, level)]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                full = [i for i in range(a, b) if texts[i]]
                levels, root, names = parse_levels([texts[i] for i in full], wanted) if full else ([], [], [[] for _ in wanted])
                at = dict(zip(full, range(len(full))))
                pick = lambda values, i, other: values[at[i]] if i in at else other  # noqa: B023, E731
                lists = _lists([[names[0][at[i]]] if i in at else [_NONE] for i in range(a, b)]).flatten()
                lower = _lists([[n[at[i]] for n in names[1:]] if i in at else [_NONE] * (len(wanted) - 1) for i in range(a, b)])
                yield to_batch(_OUT, doc_id=ids[a:b], n_chars=[None if t is None else len(t) for t in texts[a:b]], n_levels=[pick(levels, i, 0) for i in range(a, b)], root=[pick(root, i, None) for i in range(a, b)], signatures=lists, lower=lower)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCHEMA)


def brute_force(text: str, level: int) -> tuple[int, int | None, list[int]]:
    """The same for one text, symbol by symbol."""
    m = (1 << 64) - 1

    def mixed(x: int) -> int:
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * c) & m
        return x ^ (x >> 33)

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    sym, depth, names = [mixed(ord(c) + 1) for c in text], 0, None
    while sym:
        if names is None and (depth == level or len(sym) == 1):
            names = sorted({signed(x) for x in sym})
        if len(sym) == 1:
            return depth, signed(sym[0]), names
        runs: list[list[int]] = []
        for x in sym:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        sym = [x if n == 1 else mixed((x + n * int(_RUN)) & m) for x, n in runs]
        label, bits = sym, 64
        for _ in range(4):
            nxt = []
            for i, x in enumerate(label):
                diff = x ^ (label[i - 1] if i else ~x & ((1 << bits) - 1))
                low = (diff & -diff).bit_length() - 1
                nxt.append(2 * low + (x >> low & 1))
            label, bits = nxt, 8
        start = [i for i, x in enumerate(label) if not i or (x > label[i - 1] and (i + 1 == len(label) or x > label[i + 1]))]
        sym = [mixed((sum(mixed((x + (k + 1) * int(_PLACE)) & m) for k, x in enumerate(sym[a:b])) + (b - a) * int(_LEN)) & m) for a, b in zip(start, [*start[1:], len(sym)])]
        depth += 1
    return 0, None, []
