"""Token counts (operator 8) by a compiled finite-state transducer.

For merge vocabularies an encoding is right exactly when each two neighbouring
pieces are the encoding of their own concatenation.  So the encoding of a prefix
is fixed by its last piece and by the encoding before that piece, and all that
later characters can depend on is, for every suffix of the prefix that begins
some piece, the piece in front of that suffix and how many pieces the suffix has
added.  These tuples are the states.  A transition on a character carries the
change of the emitted-token count (negative when pieces merge into a longer
one).  States and transitions are determinised on first use and kept for the
life of the Python worker.

A text falls into segments (see ``merge_vocab``) at which the machine restarts;
counts of distinct segments are kept.  Long segments are cut into chunks: a
chunk's state map takes an entry state to an exit state and a count, maps are
first made for the states expected at the chunk borders, and a prefix scan
composes neighbouring maps pairwise, adding entries that were not expected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.llm.merge_vocab import SPACE, UNKNOWN, MergeVocab, load
from tankwise.llm.piece_codec import CHUNK_CHARS, MODEL, _heap, vocabulary_path
from tankwise.llm.shared import arrow_map, documents

LIMIT = 4096
LONG = 512               # characters from which a segment is cut into chunks
CHUNK = 128
WARM = 24                # characters read to guess the state at a chunk's start
MAX_STATES = 300_000   # then the machine starts over
CACHE_SEGMENTS = 400_000
START, LOST = -1, -2     # in front of a suffix: the segment's start, a character without piece
_MACHINES: dict[str, "Transducer"] = {}


class Transducer:
    def __init__(self, vocab: MergeVocab):
        self.vocab = vocab
        self.prefixes = {p[:j] for p in vocab.ids for j in range(1, len(p))}
        self._fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (("", START, 0),)
        self.states, self.moves = [start], [{}]
        self.number = {start: 0}

    def fits(self, a: int, b: int) -> bool:
        """Whether pieces a, b are the encoding of their concatenation."""
        if a < 0:
            return True
        key = (a << 16) | b
        ok = self._fits.get(key)
        if ok is None:
            v = self.vocab
            chars = [int(v.char_id[ord(c)]) for c in v.pieces[a] + v.pieces[b]]
            ok = self._fits[key] = UNKNOWN not in chars and _heap(v, chars) == [a, b]
        return ok

    def move(self, state: int, char: str) -> tuple[int, int]:
        """Next state and change of the count; made on first use."""
        known = self.states[state]
        if int(self.vocab.char_id[ord(char)]) == UNKNOWN:
            entries, delta = (("", LOST, 0),), len(char.encode())
        else:
            for suffix, before, added in reversed(known):       # longest piece first
                piece = self.vocab.ids.get(suffix + char)
                if piece is not None and self.fits(before, piece):
                    break
            else:
                raise ValueError(f"no piece ends with {char!r} after {known!r}")
            delta = 1 - added
            entries = (("", piece, 0),) + tuple((s + char, b, n + delta) for s, b, n in known
                                                if s + char in self.prefixes)
        to = self.number.get(entries)
        if to is None:
            to = self.number[entries] = len(self.states)
            self.states.append(entries)
            self.moves.append({})
        self.moves[state][char] = (to, delta)
        return to, delta

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """Exit state and emitted tokens of ``text`` read from ``state``."""
        moves, total = self.moves, 0
        for c in text:
            step = moves[state].get(c)
            if step is None:
                step = self.move(state, c)
            state = step[0]
            total += step[1]
        return state, total

    def run_chunks(self, text: str) -> int:
        """Tokens of a long segment: scan of its chunks' state maps."""
        maps = []
        for a in range(0, len(text), CHUNK):
            guess = self.run(text[max(0, a - WARM):a])[0] if a else 0
            maps.append((text[a:a + CHUNK], {guess: self.run(text[a:a + CHUNK], guess)}))
        while len(maps) > 1:
            maps = [self._compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i]
                    for i in range(0, len(maps), 2)]
        return self._apply(maps[0], 0)[1]

    def _apply(self, chunk, entry):
        text, known = chunk
        if entry not in known:
            known[entry] = self.run(text, entry)
        return known[entry]

    def _compose(self, left, right):
        both = {}
        for entry, (mid, n) in left[1].items():
            out, m = self._apply(right, mid)
            both[entry] = (out, n + m)
        return left[0] + right[0], both

    def count(self, segment: str) -> int:
        word = segment.replace(" ", SPACE)
        return self.run_chunks(word) if len(word) >= LONG else self.run(word)[1]


def machine(path: str) -> Transducer:
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(load(path))
    return _MACHINES[path]


def _count(batches, path, limit):
    m = machine(path)
    cache: dict[str, int] = {}
    names = ["id", "n_bytes", "n_tokens", "over_limit"]
    find = m.vocab.segment.findall
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        a = 0
        while a < len(texts):
            part, sizes, size, b = [], [], 0, a
            while b < len(texts) and (b == a or size < CHUNK_CHARS):
                t = texts[b].as_py() or ""
                part.append(find(" " + t) if t else [])
                sizes.append(len(t.encode()))
                size += len(t)
                b += 1
            if len(cache) > CACHE_SEGMENTS:
                cache.clear()
            if len(m.states) > MAX_STATES:
                m.clear()
            for s in set().union(*part):
                if s not in cache:
                    cache[s] = m.count(s)
            n = [sum(map(cache.__getitem__, p)) for p in part]
            yield pa.record_batch([ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
                                   pa.array([x > limit for x in n], pa.bool_())], names=names)
            a = b


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row, without begin and end.

    A null text counts as empty (0 bytes, 0 tokens); ids may be null or repeated;
    other columns are not read."""
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                     lambda it: _count(it, model_path, limit),
                     f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, "
                     "over_limit boolean").withColumnRenamed("id", id_col)


def op8_token_counts(spark, sf_dir):
    """Tokens of every whole document under the 32k piece vocabulary."""
    return token_counts(documents(spark, sf_dir), vocabulary_path(MODEL))
