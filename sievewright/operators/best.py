"""The best rows of many queries that one task has seen, with bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

HELD = 500_000


class Best:
    """The ``top`` rows of different texts of each query: score falling, then id rising. Rows under ``floor`` never count; of a text the best counts."""

    def __init__(self, queries: int, top: int, floor: float):
        self.top = top
        self.most = max(HELD, 4 * queries * top)
        self.floor = np.full(queries, floor, np.float64)
        self._held: list[tuple[np.ndarray, ...]] = []
        self._size = 0

    def add(self, near: np.ndarray, off: float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, texts: np.ndarray) -> None:
        """near: scores that are off by ``off`` at most, a row for each query, a column for each id; exact: scores of queries and columns; texts: of the ids.

        Only what may count is scored exactly. That is little under a floor that is near; else the best of so many texts raise it first.
        """
        open_ = near >= (self.floor - off).astype(near.dtype)[:, None]
        if np.count_nonzero(open_) > 2 * self.top * len(near):
            own, at = np.unique(texts, return_inverse=True)
            if len(own) > self.top:
                best = near
                if len(own) < len(texts):
                    order = np.argsort(at, kind="stable")
                    best = np.maximum.reduceat(near[:, order], np.searchsorted(at[order], np.arange(len(own))), axis=1)
                least = np.partition(np.nan_to_num(best, nan=-np.inf), -self.top, axis=1)[:, -self.top].astype(np.float64) - off
                self.floor = np.maximum(self.floor, np.floor(least * 1e9) / 1e9)
                open_ = near >= (self.floor - off).astype(near.dtype)[:, None]
        query, at = np.nonzero(open_)
        score = exact(query, at)
        held = score >= self.floor[query]
        query, at, score = query[held], at[held], score[held]
        self._held.append((query, score, ids[at], texts[at]))
        self._size += len(query)
        if self._size > self.most:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id, text) of the best so far; all else is forgotten."""
        if not self._held:
            none = np.zeros(0, np.int64)
            return none, np.zeros(0), none, none
        query, score, ids, texts = (np.concatenate(x) for x in zip(*self._held, strict=True))
        order = np.lexsort((ids, -score, texts, query))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(query[order]) != 0) | (np.diff(texts[order]) != 0)
        query, score, ids, texts = (x[order[first]] for x in (query, score, ids, texts))
        order = np.lexsort((ids, -score, query))
        query, score, ids, texts = query[order], score[order], ids[order], texts[order]
        heads = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
        last = place == self.top - 1
        self.floor[query[last]] = score[last]
        keep = place < self.top
        self._held = [(query[keep], score[keep], ids[keep], texts[keep])]
        self._size = int(keep.sum())
        return self._held[0]
