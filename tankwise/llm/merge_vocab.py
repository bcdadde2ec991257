"""Merge-type SentencePiece vocabulary as arrays: pieces, scores and the table of
adjacent pairs that may merge."""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"
NO_RANK = np.int32(1 << 30)
UNKNOWN = 0xFFFF
_LOADED: dict[str, "MergeVocab"] = {}


def load(path: str) -> "MergeVocab":
    """The vocabulary file's tables, built once in a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = MergeVocab(path)
    return _LOADED[path]


class MergeVocab:
    """Reads a BPE ``.model`` with byte fallback, an identity normaliser and a
    leading space (others raise)."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.processor = sp
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        if size >= UNKNOWN or sp.encode("a  b ") != sp.encode("a  b ", add_bos=False) or sp.decode(sp.encode(" a  b ")) != " a  b ":
            raise ValueError("expected a vocabulary below 65,535 pieces that keeps white space")
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.ids = ids
        self.texts = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.texts[i] = bytes([b])
        self.numerals = [str(i) for i in range(size)]
        score = np.array([sp.get_score(i) for i in range(size)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)   # equal scores: equal rank
        self.char_id = np.full(0x110000, UNKNOWN, np.uint16)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        pairs = {}
        for p, i in ids.items():
            for j in range(1, len(p)):
                a, b = ids.get(p[:j]), ids.get(p[j:])
                if a is not None and b is not None:
                    pairs[(a << 16) | b] = i
        self.pairs = pairs
        self._bits = max(12, int(np.ceil(np.log2(len(pairs) + 1))) + 3)
        n = 1 << self._bits
        self._keys = np.full(n, 0xFFFFFFFF, np.uint32)
        self._merged = np.zeros(n, np.uint16)
        keys = np.array(sorted(pairs), np.uint32)
        slot = self._slot(keys)
        self.probes = 1
        for k, s in zip(keys.tolist(), slot.tolist()):
            step = 1
            while self._keys[s] != 0xFFFFFFFF:
                s, step = (s + 1) & (n - 1), step + 1
            self._keys[s], self._merged[s] = k, pairs[k]
            self.probes = max(self.probes, step)
        # text falls into independent segments before a space that follows a
        # letter, and around line ends, unless some piece spans such a place
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
            self.segment = re.compile(r".+", re.S)
        else:
            self.segment = re.compile(rf"\n|[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+")

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def lookup(self, a, b):
        """Merged piece and its rank of adjacent symbols, element-wise (rank
        ``NO_RANK``: they do not merge)."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        s = self._slot(key)
        known = a != UNKNOWN              # two unknowns would look like an empty slot
        found = (self._keys[s] == key) & known
        open_ = np.flatnonzero(~found & known & (self._keys[s] != 0xFFFFFFFF))
        for _ in range(self.probes - 1):
            if len(open_) == 0:
                break
            s[open_] = (s[open_] + 1) & (len(self._keys) - 1)
            k = self._keys[s[open_]]
            hit = k == key[open_]
            found[open_[hit]] = True
            open_ = open_[~hit & (k != 0xFFFFFFFF)]
        merged = np.where(found, self._merged[s], 0).astype(np.uint16)
        return merged, np.where(found, self.rank[merged], NO_RANK).astype(np.int32)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character ids of all words end to end, and each word's length."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return self.char_id[points], n
