"""The best of many questions, kept while their answers come in."""

from __future__ import annotations

import numpy as np


class Best:
    """By score, then id: up to `limit` answers of each of n questions. least: what a score must reach to change anything; full: questions that have `limit`."""

    def __init__(self, n: int, limit: int, least: float = 0.0):
        self.n, self.limit = n, limit
        self.row, self.score, self.id = np.empty(0, np.int64), np.empty(0), None
        self.least, self.full = np.full(n, least), np.zeros(n, bool)

    def merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.least[row]
        row, score, ids = row[ok], score[ok], ids[ok]
        if not len(row):
            return
        mine = np.zeros(self.n, bool)
        mine[row] = True
        old = mine[self.row]
        r, s = np.concatenate([self.row[old], row]), np.concatenate([self.score[old], score])
        i = ids if self.id is None or not len(self.id) else np.concatenate([self.id[old], ids])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep, last = place < self.limit, place == self.limit - 1
        self.least[r[last]], self.full[r[last]] = np.maximum(self.least[r[last]], s[last]), True
        self.id = i[keep] if self.id is None or not len(self.id) else np.concatenate([self.id[~old], i[keep]])
        self.row, self.score = np.concatenate([self.row[~old], r[keep]]), np.concatenate([self.score[~old], s[keep]])


def true(x: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of few: eight at a time."""
    x = x.ravel()
    even = len(x) // 8 * 8
    at = (np.flatnonzero(x[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[x[at]], even + np.flatnonzero(x[even:])])
