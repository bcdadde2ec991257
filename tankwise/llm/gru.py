"""Gated recurrent network with a class-factored softmax, in NumPy.

Targets are head words (each in a class) or the tail class as a whole.  Documents
run side by side, longest first; training cuts back-propagation at windows, and
both training and scoring carry the state from window to window."""

from __future__ import annotations

import numpy as np

WINDOW = 32
LONG_RUN = 8     # rows from which a run is summed by itself


def start(head_counts: np.ndarray, tail_count: float, inputs: int, hidden: int, classes: int, seed: int):
    """Parameters that give the unigram distribution of classes and words.  The
    last row of ``c`` and the last column of ``w`` are biases; the words' rows of
    ``w`` lie by class."""
    rng = np.random.default_rng(seed)
    order = np.argsort(-head_counts, kind="stable")
    mass = np.cumsum(np.sqrt(head_counts[order] + 1.0))
    cls = np.zeros(len(order), np.int32)
    cls[order] = np.minimum((mass / mass[-1] * classes).astype(np.int32), classes - 1)
    total = np.bincount(cls, head_counts + 1.0, minlength=classes)
    by_class = np.argsort(cls, kind="stable")
    f = np.float32
    p = {"x": (rng.normal(size=(inputs, 3 * hidden)) * 0.1).astype(f),
         "h": (rng.normal(size=(hidden, 3 * hidden)) * 0.3).astype(f),
         "b": np.zeros(3 * hidden, f),
         "c": np.zeros((hidden + 1, classes + 1), f),
         "w": np.zeros((len(order), hidden + 1), f)}
    p["c"][-1] = np.log(np.append(np.maximum(total, 1e-9), tail_count + 1.0))
    p["w"][:, -1] = np.log(head_counts + 1.0)[by_class]
    first = np.searchsorted(cls[by_class], np.arange(classes + 1))
    inside = np.zeros(len(order), np.int32)
    inside[by_class] = np.arange(len(order)) - first[cls[by_class]]
    # by target; the last entry, found by -1, is the tail's
    return p, {"cls": np.append(cls, classes).astype(np.int16 if classes < 2**15 else np.int64), "inside": inside, "first": first}


SAFE = 60.0      # exp() of this and its negative, and sums of them, are far from a float's bounds


def _input_table(p):
    """Input vectors with the bias, a row for each input and gate; halves for z and r."""
    n = p["h"].shape[0]
    return _halved((p["x"] + p["b"]).reshape(-1, 3, n), 1).reshape(-1, n)


def _halved(x, axis):
    """Halves for z and r: sigmoid(x) = (tanh(x / 2) + 1) / 2."""
    x.swapaxes(0, axis)[:2] *= 0.5
    return x


def _rows(tokens):
    """Rows (steps, gates, documents) of an input table."""
    return tokens[:, None] * 3 + np.arange(3)[:, None]


class _Room:
    """Arrays for the windows of one shape, and each step's views of them, as making a
    view costs about what its arithmetic does.  What a step writes lies in one piece.

    ``given``: input vectors (steps, gates, documents, hidden); ``states`` before each
    step and after the last; ``gates``: z, r, the candidate's recurrent part and the
    candidate of each step, or of the last one only without ``keep``."""

    def __init__(self, steps, width, n, dtype, keep):
        self.shape = steps, width
        self.given = np.empty((steps, 3, width, n), dtype)
        self.states = np.empty((steps + 1, width, n), dtype)
        self.gates = np.empty((steps if keep else 1, 4, width, n), dtype)
        gates = self.gates if keep else [self.gates[0]] * steps
        self.forth = [(s, nxt, x[:2], x[2], g[:3], g[:2], *g) for s, nxt, x, g in zip(self.states, self.states[1:], self.given, gates)]
        if keep:
            self.by_d = np.empty((steps, 2, width, n), dtype)      # of d, in the candidate and z
            self.rest = np.empty((steps, width, n), dtype)
            self.grads = np.empty_like(self.gates)
            self.parts = np.empty((steps, 5, width, n), dtype)     # of a state's gradient: by r, u and z, by the state after it, its own
            self.back = [(by, d[:2], d[0], g[1:3], d[2:], d[1:], part[:3], g[0], part[3], part.reshape(5, -1)) for by, d, g, part in
                         zip(self.by_d[::-1], self.grads[::-1], self.gates[::-1], self.parts[::-1])]


def _forward(p, room, h):
    """Runs a window of ``room.given`` from the states ``h``."""
    n = h.shape[1]
    w = _halved(p["h"].reshape(n, 3, n).transpose(1, 0, 2).copy(), 0)
    room.states[0] = h
    half = np.array(0.5, h.dtype)
    add, multiply, subtract, tanh, matmul = np.add, np.multiply, np.subtract, np.tanh, np.matmul
    for s, nxt, x_zr, x_g, zru, zr, z, r, u, g in room.forth:
        matmul(s, w, zru)
        add(zr, x_zr, zr)
        tanh(zr, zr)
        multiply(zr, half, zr)
        add(zr, half, zr)
        multiply(r, u, g)
        add(g, x_g, g)
        tanh(g, g)
        subtract(s, g, nxt)
        multiply(nxt, z, nxt)
        add(nxt, g, nxt)


def _exp(x, begin=None, each=None):
    """exp(x) in place, of rows or of runs that begin at ``begin``, and what was taken
    from each first; nothing but from values beyond SAFE."""
    off = None
    if x.size and max(x.max(), -x.min()) > SAFE:
        off = x.max(axis=1) if begin is None else np.maximum.reduceat(x, begin)
        x -= off[:, None] if begin is None else np.repeat(off, each)
    np.exp(x, x)
    return off


def output(p, tables, states, targets, grads=None, there=None):
    """``(log-probabilities, None)``: natural, of each target (-1: the tail class)
    from its state.  With ``grads`` ``(None, gradients of the states)``, and those of
    ``c`` and ``w`` are written into it.  Both are 0 outside ``there`` (None: all).

    Rows lie by class, the words' probabilities of all rows one after the other in
    one array, so that only matrix products go class by class."""
    first = tables["first"]
    tail, n = len(first) - 1, states.shape[1]
    cls = tables["cls"][targets]
    if there is not None:
        cls[~there] = tail + 1
    order = np.argsort(cls, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    if there is not None:
        order = order[:np.count_nonzero(there)]
    cls = cls[order]
    cut = np.searchsorted(cls, np.arange(tail + 1))
    s = np.ones((len(order), n + 1), states.dtype)              # the last column is for the bias
    s[:, :n] = np.take(states, order, axis=0)
    q = s @ p["c"]
    at = np.arange(0, q.size, tail + 1) + cls
    logp = q.ravel()[at] if grads is None else None
    off = _exp(q)
    total = q @ np.ones(tail + 1, q.dtype)
    back = None
    if grads is None:
        logp -= np.log(total) if off is None else np.log(total) + off
    else:
        q *= (1 / total)[:, None]
        q.ravel()[at] -= 1
        np.matmul(s.T, q, out=grads["c"])
        back = q @ p["c"][:n].T
        grads["w"].fill(0)
    m = int(cut[-1])
    if m:
        w = p["w"]
        each = np.repeat(np.diff(first), np.diff(cut))          # words of each row's class
        begin = np.cumsum(each) - each
        flat = np.empty(int(begin[-1] + each[-1]), np.result_type(s, w))
        parts = []
        o = 0
        for a, b, i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), first[:-1].tolist(), first[1:].tolist()):
            if b > a:
                e = o + (b - a) * (j - i)
                part = s[a:b], w[i:j], flat[o:e].reshape(b - a, j - i)
                np.dot(part[0], part[1].T, part[2])
                parts.append((a, b, i, j, *part))
                o = e
        goal = begin + tables["inside"][targets[order[:m]]]
        if grads is None:
            logp[:m] += flat[goal]
        off = _exp(flat, begin, each)
        total = np.add.reduceat(flat, begin)
        if grads is None:
            logp[:m] -= np.log(total) if off is None else np.log(total) + off
        else:
            flat *= np.repeat(1 / total, each)
            flat[goal] -= 1
            gw, gs = grads["w"], np.empty((m, n + 1), s.dtype)
            for a, b, i, j, sp, wp, q in parts:
                np.dot(q.T, sp, gw[i:j])
                np.dot(q, wp, gs[a:b])
            back[:m] += gs[:, :n]
    out = logp if grads is None else back
    if there is not None:
        out = np.concatenate([out, np.zeros((len(place) - len(out), *out.shape[1:]), out.dtype)])
    out = np.take(out, place, axis=0)
    return (out, None) if grads is None else (None, out)


def windows(lengths: np.ndarray, width: int, window: int = WINDOW, *, refill: bool):
    """Documents (longest first) side by side in up to ``width`` lanes.  With
    ``refill`` one that ends leaves its lane to the next, else all have to end first;
    ended ones are left out when they are half of the lanes.  ``(documents, first
    token of each, steps, lanes of the window before that go on, None: all or none)``."""
    number, begun = int(np.count_nonzero(lengths)), 0
    docs = at = np.zeros(0, np.int64)
    while True:
        ended, kept = at >= lengths[docs], None
        if ended.all():
            docs = np.arange(begun, min(begun + width, number))
            at = np.zeros_like(docs)
            begun += len(docs)
            if len(docs) == 0:
                return
        elif ended.any():
            free = np.flatnonzero(ended)[:number - begun if refill else 0]
            docs, at = docs.copy(), at.copy()
            docs[free], at[free], ended[free] = np.arange(begun, begun + len(free)), 0, False
            begun += len(free)
            if 2 * np.count_nonzero(ended) >= len(docs):
                kept = np.flatnonzero(~ended)
                docs, at = docs[kept], at[kept]
        yield docs, at, int(min(window, (lengths[docs] - at).max())), kept
        at = at + window


def _lanes(inputs, targets, offsets, width, refill):
    """Per window: documents, tokens and targets (steps, documents), which of them are
    there (None: all; a place behind a document's end repeats its last token), and
    which lanes begin a document and which go on."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    for docs, first, steps, kept in windows(lengths[order], width, refill=refill):
        docs = order[docs]
        left = lengths[docs] - first
        t = np.arange(steps)[:, None]
        at = offsets[docs] + first + np.minimum(t, left - 1)
        yield docs, inputs[at], targets[at], None if left.min() >= steps else (t < left).ravel(), first == 0, kept


def _states(h, size, dtype, begin, kept):
    """States at a window's start, from those at the end of the one before."""
    if begin.all():
        return np.zeros((len(begin), size), dtype)
    h = h.copy() if kept is None else h[kept]
    h[begin] = 0
    return h


def score(p, tables, inputs, targets, offsets, width: int = 512) -> np.ndarray:
    """Sum of natural log-probabilities of each document's targets."""
    size, out = p["h"].shape[0], np.zeros(len(offsets) - 1)
    table = _input_table(p)
    h = room = None
    for docs, tok, goal, there, begin, kept in _lanes(inputs, targets, offsets, width, True):
        if room is None or room.shape != tok.shape:
            room = _Room(*tok.shape, size, table.dtype, False)
        h = _states(h, size, table.dtype, begin, kept)
        np.take(table, _rows(tok), axis=0, out=room.given, mode="clip")
        _forward(p, room, h)
        h = room.states[-1]
        logp, _ = output(p, tables, room.states[:-1].reshape(-1, size), goal.ravel(), there=there)
        out[docs] += logp.reshape(tok.shape).sum(axis=0, dtype=float)
    return out


def _backward(p, room, back):
    """Gradients of a window, (steps, 4, documents, hidden): of the candidate, z, the
    candidate's recurrent part and r before their functions; ``back`` has those of
    the states.  Uses up the room's gates."""
    steps, _, width, n = room.gates.shape
    z, r, u, g = room.gates.swapaxes(0, 1)
    w = p["h"].T.reshape(3, n, n)[[0, 2, 1]]
    to_g, to_z = room.by_d.swapaxes(0, 1)
    rest = np.subtract(1, z, room.rest)
    np.multiply(g, g, to_g)
    np.subtract(1, to_g, to_g)
    to_g *= rest
    np.subtract(room.states[:-1], g, to_z)
    to_z *= z
    to_z *= rest
    u *= r                                                     # r and u: of the candidate's, in its recurrent part and r
    u *= np.subtract(1, r, rest)
    room.parts[:, 4] = back.reshape(steps, width, n)
    carry, ones = np.zeros((width, n), z.dtype), np.ones(5, z.dtype)
    total = carry.reshape(-1)
    dot, multiply, matmul = np.dot, np.multiply, np.matmul
    for by, d_gz, d_g, by_g, d_ur, d_zur, part, z, after, parts in room.back:
        multiply(carry, by, d_gz)
        multiply(d_g, by_g, d_ur)
        matmul(d_zur, w, part)
        multiply(carry, z, after)
        dot(ones, parts, total)
    return room.grads


def _sums(rows, head):
    """``(order, sums)``: the runs of ``rows`` that begin at ``head``, longest first,
    and their sums: long runs one by one, the others all together by place."""
    n = np.diff(np.append(head, len(rows)))
    order = np.argsort(-n, kind="stable")
    head, n = head[order], n[order]
    out = np.take(rows, head, axis=0)
    more = np.searchsorted(-n, -np.arange(LONG_RUN + 1)).tolist()      # runs of more rows
    long = more[-1]
    ones = np.ones(int(n[0]), rows.dtype)
    for total, a, size in zip(out[:long], head[:long].tolist(), n[:long].tolist()):
        np.dot(ones[:size], rows[a:a + size], total)
    for place in range(1, LONG_RUN):
        if more[place] > long:
            out[long:more[place]] += np.take(rows, head[long:more[place]] + place, axis=0)
    return order, out


def _views(flat, like):
    """The arrays of ``like`` but for x, lying one after the other in ``flat``."""
    out, at = {}, 0
    for k, v in like.items():
        if k != "x":
            out[k] = flat[at:at + v.size].reshape(v.shape)
            at += v.size
    return out


def _step(value, grad, memory, rate):
    """AdaGrad's new ``value`` and ``memory``, in place; uses up ``grad``."""
    np.clip(grad, -1, 1, out=grad)
    memory += grad * grad
    grad /= np.sqrt(memory)
    grad *= rate
    value -= grad


def train(p, tables, inputs, targets, offsets, rate: float = 0.08, width: int = 64, memory=None):
    """One pass of AdaGrad steps, one per window of a group of documents, in place;
    returns the AdaGrad memory."""
    size, x = p["h"].shape[0], p["x"]
    key = np.int16 if len(x) < 2**15 else np.int64             # short ones sort by radix
    dense = np.concatenate([v.ravel() for k, v in p.items() if k != "x"])        # one step for all of them
    grad = np.zeros_like(dense)
    q, grads = _views(dense, p), _views(grad, p)
    memory = memory or {"x": np.full_like(x, 1e-2), "dense": np.full_like(dense, 1e-2)}
    h = room = None
    for _, tok, goal, there, begin, kept in _lanes(inputs, targets, offsets, width, False):
        docs = tok.shape[1]
        if room is None or room.shape != tok.shape:
            room = _Room(*tok.shape, size, x.dtype, True)
        h = _states(h, size, x.dtype, begin, kept)
        np.take(x.reshape(-1, size), _rows(tok), axis=0, out=room.given, mode="clip")
        room.given += np.repeat(q["b"].reshape(3, 1, size), docs, axis=1)
        _halved(room.given, 1)
        _forward(q, room, h)
        h = room.states[-1]
        flat, tok = room.states[:-1].reshape(-1, size), tok.ravel()
        _, back = output(q, tables, flat, goal.ravel(), grads, there)
        d = _backward(q, room, back)
        for gate, at in enumerate((1, 3, 2)):
            grads["h"][:, gate * size:(gate + 1) * size] = flat.T @ d[:, at].reshape(-1, size)
        place = np.argsort(tok.astype(key), kind="stable") if there is None else (
            np.flatnonzero(there)[np.argsort(tok[there].astype(key), kind="stable")])
        tok = tok[place]
        head = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        row = place + place // docs * (3 * docs)      # of the candidate's; the others' lie behind it
        each = np.take(d.reshape(-1, size), row[:, None] + np.array([1, 3, 0]) * docs, axis=0)
        runs, gx = _sums(each.reshape(len(place), 3 * size), head)
        used = tok[head[runs]]
        gx.sum(axis=0, out=grads["b"])
        scale = 1.0 / len(place)
        grad *= scale
        gx *= scale
        _step(dense, grad, memory["dense"], rate)
        mine, was = np.take(x, used, axis=0), np.take(memory["x"], used, axis=0)
        _step(mine, gx, was, rate)
        x[used], memory["x"][used] = mine, was
    for k, v in q.items():
        p[k][...] = v
    return memory
