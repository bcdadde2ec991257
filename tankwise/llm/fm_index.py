"""A bidirectional FM-index over word ids of one shard, and the enumeration of its
n-grams by interval extension, in NumPy steps.

The shard's text is a row of ids with 0 between pieces.  Suffixes are ordered by
their first ``depth`` ids only, as no longer phrase is asked for.  The BWT of the
text extends an interval to the left, that of the reversed text to the right; a
step in one keeps the interval in the other, so both ends stay open."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense rank of each key, and the order that sorts them."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    step = np.zeros(len(s), np.int64)
    np.cumsum(s[1:] != s[:-1], out=step[1:])
    rank = np.empty(len(s), np.int64)
    rank[order] = step
    return rank, order


def bwt(text: np.ndarray, depth: int) -> np.ndarray:
    """Id before each suffix, suffixes ordered by their first ``depth`` ids."""
    rank, span = text.astype(np.int64), 1
    order = None
    while span < depth or order is None:
        second = np.zeros(len(rank), np.int64)
        second[:-span] = rank[span:]
        rank, order = _ranks(rank * (int(rank.max(initial=0)) + 1) + second)
        span *= 2
    return text[order - 1]                       # the text starts and ends with 0


def text_of(ids: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Ids with a 0 before the first piece, between pieces and at the end;
    ``opens`` marks the first word of each piece."""
    piece = np.cumsum(opens)
    out = np.zeros(len(ids) + (int(piece[-1]) if len(ids) else 0) + 1, np.int32)
    out[np.arange(len(ids)) + piece] = ids
    return out


@dataclass
class Grams:
    """N-grams of one length: ids by column, their intervals in both indexes, counts."""
    words: np.ndarray
    at: np.ndarray
    mirror: np.ndarray
    count: np.ndarray

    def where(self, keep: np.ndarray) -> Grams:
        return Grams(self.words[keep], self.at[keep], self.mirror[keep], self.count[keep])


class Index:
    """``left`` and ``right`` are the BWT of the text and of its reverse."""

    def __init__(self, left: np.ndarray, right: np.ndarray, symbols: int):
        self.symbols = symbols                   # ids run from 1 to symbols - 1
        self.table = {"left": left, "right": right}
        self.back: dict[str, np.ndarray] = {}
        self.first = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(left, minlength=symbols), out=self.first[1:])

    def _last_to_first(self, side: str) -> np.ndarray:
        if side not in self.back:
            t = self.table[side]
            out = np.empty(len(t), np.int64)
            out[np.argsort(t, kind="stable")] = np.arange(len(t))
            self.back[side] = out
        return self.back[side]

    def unigrams(self, wanted: np.ndarray) -> Grams:
        """The words whose id is marked in ``wanted`` (one flag an id)."""
        ids = np.flatnonzero(wanted[1:]) + 1
        at = self.first[ids]
        return Grams(ids[:, None].astype(np.int32), at, at.copy(), self.first[ids + 1] - at)

    def extend(self, grams: Grams, side: str, wanted: np.ndarray) -> Grams:
        """All n-grams of one more word on ``side``, that word marked in ``wanted``."""
        here, there = (grams.at, grams.mirror) if side == "left" else (grams.mirror, grams.at)
        parent = np.repeat(np.arange(len(here)), grams.count)
        before = np.cumsum(grams.count) - grams.count
        rows = np.arange(len(parent)) - before[parent] + here[parent]
        symbol = self.table[side][rows]
        key = parent * self.symbols + symbol
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(key)))
        parent, symbol = key[head] // self.symbols, key[head] % self.symbols
        keep = wanted[symbol]
        head, count, parent, symbol = head[keep], count[keep], parent[keep], symbol[keep]
        moved = self._last_to_first(side)[rows[order[head]]]     # the group's first row
        smaller = there[parent] + head - before[parent]          # rows of the parent with a smaller id
        new = symbol[:, None].astype(np.int32)
        words = grams.words[parent]
        if side == "left":
            return Grams(np.hstack([new, words]), moved, smaller, count)
        return Grams(np.hstack([words, new]), smaller, moved, count)
