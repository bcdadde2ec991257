"""Vectorised word and shingle hashing over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A word's 64-bit hash
is a polynomial over per-byte random codes taken from prefix sums, so a chunk of
texts is tokenised and hashed by a handful of NumPy passes over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 finaliser, element-wise."""
    with np.errstate(over="ignore"):
        z = x + U((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


_P = 0xD1342543DE82EF95
_PINV = pow(_P, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = mix(_LOWER.astype(U), 77)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = max(n, CHUNK_BYTES)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, U(base))
            a[0] = U(1)
            _POWERS[key] = np.cumprod(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield ``(first_row, offsets, bytes)`` over consecutive rows of a string
    array; null rows count as empty.  A chunk ends after ``limit`` bytes; one
    text longer than that is a chunk of its own."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buf = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(buf[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, off[a:b + 1] - off[a], data[off[a]:off[b]]
        a = b


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each text's first word index."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, U)
    p, inv = _powers(len(data))
    with np.errstate(over="ignore"):
        v = _CODES[data] * p
        c = np.cumsum(v)
        h = (c[ends - 1] - c[starts] + v[starts]) * inv[starts]
    return mix(h)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted: ``(values, offsets)``.

    ``first`` holds each text's first word index (one more at the end).  A text
    of 1..k-1 words has its whole sequence as its only shingle."""
    n = np.diff(first)
    per = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=out[1:])
    total = int(out[-1])
    values = np.zeros(total, U)
    if total == 0:
        return values, out
    doc = np.repeat(np.arange(len(n)), per)
    pos = np.arange(total) - out[doc] + first[doc]
    with np.errstate(over="ignore"):
        padded = np.concatenate([hashes, np.zeros(k, U)])
        short = (n < k)[doc]
        left = np.minimum(n[doc], k)
        acc = np.zeros(total, U)
        some_short = bool(short.any())
        for j in range(k):
            step = acc * U(_P) + padded[pos + j]
            acc = np.where(j < left, step, acc) if some_short else step
        values = mix(acc + left.astype(U) if some_short else acc + U(k))
    for a, b in zip(out[:-1].tolist(), out[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(total, bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    count = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(doc[keep], minlength=len(n)), out=count[1:])
    return values[keep], count


def shingles_of_texts(column: pa.Array, k: int):
    """Yield ``(first_row, values, offsets)`` per chunk of texts."""
    for row, off, data in text_chunks(column):
        s, e, first = word_bounds(off, data)
        values, count = shingle_sets(word_hashes(data, s, e), first, k)
        yield row, values, count


class HashIndex:
    """Position of 64-bit hashes in a fixed list: open addressing, looked up in
    NumPy steps."""

    def __init__(self, hashes: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(hashes) + 1))) + 2)
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int64)
        todo, step = np.arange(len(hashes)), 0
        slot = (hashes >> self.shift).astype(np.int64)
        while len(todo):                       # the first to claim a free slot keeps it
            s = (slot[todo] + step) & self.mask
            free = self.at[s] < 0
            claim, first = np.unique(np.where(free, s, -1), return_index=True)
            first = first[claim >= 0]
            self.at[s[first]], self.keys[s[first]] = todo[first], hashes[todo[first]]
            won = np.zeros(len(todo), bool)
            won[first] = True
            # a loser of a free slot sees it taken now, like the others: go on
            todo, step = todo[~won], step + 1
        self.steps = step

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions, -1 where a hash is not in the list."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> self.shift).astype(np.int64)
        todo = np.arange(len(hashes))
        for step in range(self.steps):
            s = (slot[todo] + step) & self.mask
            hit = (self.keys[s] == hashes[todo]) & (self.at[s] >= 0)
            out[todo[hit]] = self.at[s[hit]]
            todo = todo[~hit & (self.at[s] >= 0)]
            if len(todo) == 0:
                break
        return out
