"""Small dense numerics of the whitening operator: the singular values and right
vectors of one square factor, by bidiagonal qd transforms.

Householder reflections bring the factor R to an upper bidiagonal B; dqds finds
the squared singular values of B with shifts from below, so that each comes out
with few roundings relative to itself; a twisted factorisation of B'B - lambda
gives each vector without iterating.  Everything works on one d x d array."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
NEAR = 1e-6        # eigenvalues relatively nearer than this are taken as one cluster
CLOSE = 1e-3       # vectors of eigenvalues nearer than this are orthogonalised


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector v with (I - 2vv')x = beta * e1."""
    size = float(np.linalg.norm(x))
    if size == 0.0:
        return np.zeros_like(x), 0.0
    beta = -size if x[0] >= 0 else size
    v = x.copy()
    v[0] -= beta
    return v / np.linalg.norm(v), beta


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, v)``: r = U B v' with B upper bidiagonal of diagonal a, superdiagonal b."""
    m = r.astype(np.float64).copy()
    d = m.shape[1]
    a, b, v = np.zeros(d), np.zeros(max(d - 1, 0)), np.eye(d)
    for k in range(d):
        left, a[k] = _reflector(m[k:, k])
        m[k:, k:] -= 2.0 * np.outer(left, left @ m[k:, k:])
        if k < d - 1:
            right, b[k] = _reflector(m[k, k + 1:])
            m[k:, k + 1:] -= 2.0 * np.outer(m[k:, k + 1:] @ right, right)
            v[:, k + 1:] -= 2.0 * np.outer(v[:, k + 1:] @ right, right)
    return a, b, v


def _lower_bound(q: list[float], e: list[float]) -> float:
    """1 / trace of the inverse: below the smallest eigenvalue, near it once it stands alone."""
    d = q[0]
    total = 1.0 / d
    for i in range(len(e)):
        d = d * (q[i + 1] / (d + e[i]))
        total += 1.0 / d
    return 1.0 / total


def _shifted(q: list[float], e: list[float], s: float):
    """One dqds transform, or None if the shift lies above the smallest eigenvalue."""
    n = len(q)
    out_q, out_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - s
    for i in range(n - 1):
        if d <= 0.0:
            return None
        out_q[i] = d + e[i]
        t = q[i + 1] / out_q[i]
        out_e[i] = e[i] * t
        d = d * t - s
    if d < 0.0:
        return None
    out_q[n - 1] = d
    return out_q, out_e


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling."""
    size = float(max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)))
    if size == 0.0:
        return np.zeros(len(a))
    tiny = 1e-40                                   # far below a rounding of the largest entry
    q = [max((x / size) ** 2, tiny) for x in a.tolist()]
    e = [(x / size) ** 2 for x in b.tolist()]
    out: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1)
                        if e[i] <= (EPS * EPS) * max(base, 0.0) or e[i] <= (EPS * EPS) * min(q[i], q[i + 1])), None)
            if cut is not None:                    # falls apart here
                blocks.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            s = _lower_bound(q, e) * (1.0 - 8 * EPS)
            done = _shifted(q, e, s)
            while done is None:
                s = s * 0.75 if s > tiny else 0.0
                done = _shifted(q, e, s)
            q, e = [max(x, tiny * EPS) for x in done[0]], done[1]
            base += s
            if q[-1] > q[0] * 4.0:                 # small values belong at the end
                q, e = _flipped(q, e)
        out.append(base + q[0])
    return np.sort(np.array(out))[::-1] * size * size


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array read from its other end: same eigenvalues."""
    return q[::-1], e[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, lam: float) -> np.ndarray:
    """Vector of L D L' - lam, from the twisted factorisation whose pivot is smallest."""
    n = len(d)
    up, down = np.zeros(n), np.zeros(n)            # the two runs of the auxiliary value
    forward, back = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    guard = EPS * EPS * float(np.abs(d).max())
    s = -lam
    for i in range(n - 1):
        up[i] = s
        p = s + d[i]
        p = p if abs(p) > guard else guard
        forward[i] = d[i] * low[i] / p
        s = forward[i] * low[i] * s - lam
    up[n - 1] = s
    p = d[n - 1] - lam
    for i in range(n - 2, -1, -1):
        down[i + 1] = p
        t = d[i] * low[i] * low[i] + p
        t = d[i] / (t if abs(t) > guard else guard)
        back[i] = low[i] * t
        p = p * t - lam
    down[0] = p
    r = int(np.argmin(np.abs(up + down + lam)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -forward[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -back[i] * z[i]
    return z / np.linalg.norm(z)


def _cluster(tri: np.ndarray, lam: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors of a cluster too tight to be told apart one by one: the
    invariant subspace by shifted solves, then its own small problem."""
    n = len(tri)
    rng = np.random.default_rng(n)
    z = np.linalg.qr(rng.standard_normal((n, count)))[0]
    shifted = tri - (lam * (1.0 + 64 * EPS) + 64 * EPS * EPS) * np.eye(n)
    for _ in range(4):
        z = np.linalg.qr(np.linalg.solve(shifted, z))[0]
    value, turn = np.linalg.eigh(z.T @ tri @ z)
    return value[::-1], (z @ turn)[:, ::-1]


def right_vectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray, count: int) -> np.ndarray:
    """Right singular vectors of the bidiagonal (a, b) for its ``count`` largest
    squared singular values ``squares`` (falling), as columns."""
    n = len(a)
    top = float(np.abs(a).max(initial=0.0)) or 1.0
    safe = np.where(np.abs(a) > 1e-20 * top, a, 1e-20 * top)
    d, low = safe * safe, b / safe[:-1]
    out, at = np.zeros((n, count)), 0
    while at < count:
        end = at + 1
        while end < n and squares[end - 1] - squares[end] <= NEAR * squares[end - 1]:
            end += 1
        take = min(end, count) - at
        if end - at == 1:
            z = _twisted(d, low, float(squares[at]))
            for k in range(at):                    # neighbours only
                if squares[k] - squares[at] <= CLOSE * squares[k]:
                    z -= out[:, k] * (out[:, k] @ z)
            out[:, at] = z / np.linalg.norm(z)
        else:
            tri = np.diag(d + np.concatenate([[0.0], b * b])) + np.diag(safe[:-1] * b, 1) + np.diag(safe[:-1] * b, -1)
            out[:, at:at + take] = _cluster(tri, float(squares[at:end].mean()), end - at)[1][:, :take]
        at = at + take
    return out


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(squares, vectors)``: all squared singular values of r, falling, and the
    right vectors of the first ``count`` as columns; the entry of largest size in
    a vector is positive."""
    a, b, v = bidiagonalise(r)
    squares = squared_singular_values(a, b)
    z = v @ right_vectors(a, b, squares, count)
    z *= np.sign(z[np.abs(z).argmax(axis=0), np.arange(count)])
    return squares, z
