"""SentencePiece encoding and decoding (operator 5): score-ordered agenda.

Encoding starts from characters and keeps merging the adjacent pair whose merged
piece has the best score, leftmost among equals, until no pair is in the
vocabulary; characters outside it become byte pieces.  The agenda of all
distinct segments of a chunk of texts advances together: one NumPy step takes
the best pair of every segment, merges it and looks up the two pairs that it
changed.  Long segments use a heap.  Every distinct segment is compared with the
sentencepiece library, batch by batch, before its ids are used.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.llm.merge_vocab import NO_RANK, SPACE, UNKNOWN, MergeVocab, load
from tankwise.llm.shared import arrow_map, documents

MODEL = "piece_bpe_32k.model"
HEAP_FROM = 48           # characters from which a segment has a heap of its own
CHUNK_CHARS = 1 << 21    # texts encoded together
CACHE_SEGMENTS = 400_000


def agenda(vocab: MergeVocab, words: list[str]) -> list[list[int]]:
    """Symbol ids of each word after all merges (``UNKNOWN`` where a character
    has no piece)."""
    out: list = [None] * len(words)
    flat, n = vocab.symbols(words)
    start = np.concatenate([[0], np.cumsum(n)])
    for length in np.unique(n).tolist():
        rows = np.flatnonzero(n == length)
        if length == 0:
            for r in rows:
                out[r] = []
        elif length >= HEAP_FROM:
            for r in rows.tolist():
                out[r] = _heap(vocab, flat[start[r]:start[r + 1]].tolist())
        else:
            _together(vocab, flat[start[rows][:, None] + np.arange(length)], rows, out)
    return out


def _together(vocab, sym, rows, out):
    if sym.shape[1] > 1:
        shape = (sym.shape[0], sym.shape[1] - 1)
        merged, rank = (x.reshape(shape) for x in vocab.lookup(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
    while sym.shape[1] > 1:
        j = rank.argmin(axis=1)
        at = np.arange(len(j))
        go = rank[at, j] < NO_RANK
        if not go.all():
            for r, s in zip(rows[~go].tolist(), sym[~go].tolist()):
                out[r] = s
            sym, merged, rank, rows, j = sym[go], merged[go], rank[go], rows[go], j[go]
            at = np.arange(len(j))
            if len(j) == 0:
                return
        sym[at, j] = merged[at, j]
        width = sym.shape[1] - 1
        cols = np.arange(width)
        sym = np.take_along_axis(sym, cols + (cols > j[:, None]), 1)
        if width == 1:
            break
        cols = np.arange(width - 1)
        keep = cols + (cols >= j[:, None])
        merged, rank = np.take_along_axis(merged, keep, 1), np.take_along_axis(rank, keep, 1)
        for side, ok in ((j - 1, j > 0), (j, j < width - 1)):
            r, c = at[ok], side[ok]
            merged[r, c], rank[r, c] = vocab.lookup(sym[r, c], sym[r, c + 1])
    for r, s in zip(rows.tolist(), sym.tolist()):
        out[r] = s


def _heap(vocab, sym):
    """The same for one long word: entries (rank, left place, left, right)."""
    n = len(sym)
    nxt, prv = list(range(1, n)) + [-1], [-1] + list(range(n - 1))
    heap = []

    def push(i):
        k = nxt[i] if i >= 0 else -1
        if k >= 0 and sym[i] != UNKNOWN and sym[k] != UNKNOWN:
            m = vocab.pairs.get((sym[i] << 16) | sym[k])
            if m is not None:
                heapq.heappush(heap, (int(vocab.rank[m]), i, sym[i], sym[k], m))
    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        k = nxt[i]
        if sym[i] != a or k < 0 or sym[k] != b:
            continue
        sym[i], sym[k] = m, None
        nxt[i] = nxt[k]
        if nxt[i] >= 0:
            prv[nxt[i]] = i
        nxt[k] = -1
        push(prv[i])
        push(i)
    return [s for s in sym if s is not None]


def segment_ids(vocab: MergeVocab, segments: list[str]) -> list[list[int]]:
    """Piece ids of segments (spaces written as such), bytes where needed."""
    words = [s.replace(" ", SPACE) for s in segments]
    out = agenda(vocab, words)
    for i, ids in enumerate(out):
        if UNKNOWN in ids:
            lost = iter([c for c in words[i] if vocab.char_id[ord(c)] == UNKNOWN])
            full = []
            for x in ids:
                full += vocab.byte_ids[list(next(lost).encode())].tolist() if x == UNKNOWN else [x]
            out[i] = full
    return out


def decode_ids(vocab: MergeVocab, ids: list[int]) -> str:
    """Text of piece ids, before the leading space is taken off."""
    return b"".join([vocab.texts[i] for i in ids]).decode("utf-8", "replace")


def check_segments(vocab: MergeVocab, segments: list[str], ids: list[list[int]]) -> None:
    """Raise unless the library gives the same ids.  It puts a space before a
    text, so a segment without one is given behind a line end."""
    sp = vocab.processor
    spaced = [i for i, s in enumerate(segments) if s[0] in (" ", SPACE) and len(s) > 1]
    bare = [i for i, s in enumerate(segments) if s[0] not in (" ", SPACE)]
    head = sp.encode("\n")
    for want, at, cut in ((sp.encode([segments[i][1:] for i in spaced], num_threads=1), spaced, 0),
                          (sp.encode(["\n" + segments[i] for i in bare], num_threads=1), bare, len(head))):
        for i, w in zip(at, want):
            if w[cut:] != ids[i]:
                raise ValueError(f"segment {segments[i]!r}: {ids[i]} but the library gives {w[cut:]}")


def _encode(batches, path, check):
    vocab = load(path)
    listed: dict[str, str] = {}
    decoded: dict[str, str] = {}
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        a = 0
        while a < len(texts):
            part, size, b = [], 0, a
            while b < len(texts) and (b == a or size < CHUNK_CHARS):
                t = texts[b].as_py() or ""
                part.append(vocab.segment.findall(" " + t) if t else [])
                size += len(t)
                b += 1
            if len(listed) > CACHE_SEGMENTS:
                listed.clear()
                decoded.clear()
            new = [s for s in set().union(*part) if s not in listed]
            got = segment_ids(vocab, new)
            if check:
                check_segments(vocab, new, got)
            for s, g in zip(new, got):
                listed[s] = ",".join([vocab.numerals[i] for i in g])
                decoded[s] = decode_ids(vocab, g)
            rows = []
            for p in part:
                text = "".join(map(decoded.__getitem__, p))
                line = ",".join(map(listed.__getitem__, p))
                rows.append((line.count(",") + 1 if line else 0, hashlib.sha256(line.encode()).hexdigest(),
                             hashlib.sha256(text[1:].encode()).hexdigest()))
            cols = list(zip(*rows))
            yield pa.record_batch([ids.slice(a, b - a), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                                   pa.array(cols[2], pa.string())], names=names)
            a = b


def piece_codec(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                check: bool = True) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` per row: the text's ids
    without begin and end, and their decoded text, as digests.

    A null text counts as empty: no tokens, digests of the empty string.  Rows
    keep their id, null or repeated; other columns are not read.  With ``check``
    every distinct segment is compared with the library and a difference
    raises."""
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                     lambda it: _encode(it, model_path, check),
                     f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, "
                     "decoded_sha256 string").withColumnRenamed("id", id_col)


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file (installed on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op5_piece_codec(spark, sf_dir):
    """Encode and decode every whole document with the 32k piece vocabulary."""
    return piece_codec(documents(spark, sf_dir), vocabulary_path(MODEL))
