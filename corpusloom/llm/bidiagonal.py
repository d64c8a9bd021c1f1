"""Singular values and right singular vectors of a square matrix, through its bidiagonal form.

Householder reflections make the matrix bidiagonal, the differential qd algorithm with shifts (dqds) finds the squares of its
singular values without subtracting, hence to high relative accuracy, and twisted factorisations of the tridiagonal
B'B - e I give the vectors. The matrix is as large as the number of dimensions, whatever the number of rows it came from.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: What a qd array may lose from its last place to be split there.
NEGLIGIBLE = (10 * EPS) ** 2
#: Vectors whose values are closer than this, relative to the larger, are made orthogonal to each other.
CLOSE = 1e-2


def reflection(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, beta, alpha): I - beta v v' turns x into (alpha, 0, ...)."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0 or not x[1:].any():
        return np.zeros_like(x), 0.0, float(x[0])
    alpha = -norm if x[0] > 0 else norm
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V): the diagonal and upper diagonal of U' M V, and V."""
    m = np.array(matrix, np.float64)
    n = len(m)
    right = np.eye(n)
    for k in range(n):
        v, beta, alpha = reflection(m[k:, k])
        if beta:
            m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
            m[k, k], m[k + 1 :, k] = alpha, 0.0
        if k + 2 < n:
            v, beta, alpha = reflection(m[k, k + 1 :])
            if beta:
                m[k:, k + 1 :] -= beta * np.outer(m[k:, k + 1 :] @ v, v)
                m[k, k + 1], m[k, k + 2 :] = alpha, 0.0
                right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One step of dqds: the next q and e, the smallest d, and whether all d before the last are positive.

    A negative d says that the shift is above the smallest value; q and e are then of no use.
    """
    n, d = len(q), q[0] - shift
    q_next, e_next, least = [0.0] * n, [0.0] * (n - 1), d
    for i in range(n - 1):
        if d < 0.0:
            return q, e, d, False
        q_next[i] = d + e[i]
        if q_next[i] == 0.0:  # a zero splits here
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / q_next[i]
            e_next[i] = e[i] * ratio
            d = d * ratio - shift
        least = min(least, d)
    q_next[-1] = d
    return q_next, e_next, least, True


def _shifted(q: list[float], e: list[float], bound: float) -> tuple[list[float], list[float], float, float]:
    """The next q and e, the shift that was taken off, and a bound of the smallest value that is left. ``bound`` is above the smallest."""
    # the smaller value of the last two places is above the smallest of all; its determinant has no difference
    above, below = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
    root = float(np.hypot((above - below) / 2, np.sqrt(q[-2] * e[-1])))
    low = (q[-2] * q[-1] + (e[-2] * below if len(e) > 1 else 0.0)) / ((above + below) / 2 + root)
    guess = min(low, bound) * (1 - 4 * EPS)
    for attempt in range(8):
        q_next, e_next, d, late = _qd_step(q, e, guess)
        if d >= 0.0:
            return q_next, e_next, guess, d
        # where only the last d is negative, the smallest value is not below the shift by more than that
        guess = guess + d if late and guess + d > 0.0 and attempt < 4 else guess / 2
    q_next, e_next, d, _ = _qd_step(q, e, 0.0)
    return q_next, e_next, 0.0, d


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, largest first."""
    scale = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(a))
    found, parts = [], [(((a / scale) ** 2).tolist(), ((b / scale) ** 2).tolist(), 0.0)]
    while parts:
        q, e, gone = parts.pop()
        if q[0] < q[-1]:  # small ones belong at the end
            q, e = q[::-1], e[::-1]
        bound, tries = float("inf"), 0
        while len(q) > 1:
            if e[-1] <= NEGLIGIBLE * (gone + q[-1]):
                found.append(gone + q.pop())
                e.pop()
                bound = float("inf")
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= NEGLIGIBLE * min(gone + q[i], gone + q[i + 1])), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], gone))
                q, e, bound = q[cut + 1 :], e[cut + 1 :], float("inf")
                continue
            q, e, shift, bound = _shifted(q, e, bound)
            gone += shift
            tries += 1
            if tries > 100 * (len(a) + 2):
                raise ArithmeticError("the qd steps do not converge")
        found += [gone + x for x in q]
    return np.sort(np.array(found))[::-1] * scale * scale


def _unit(x: np.ndarray) -> np.ndarray:
    """x at length one; zero where it has none or is not finite."""
    largest = float(np.abs(x).max())
    if not 0.0 < largest < float("inf"):
        return np.zeros_like(x)
    x = x / largest
    return x / np.linalg.norm(x)


class Twisted:
    """Factorisations of T - value I from both ends, for the tridiagonal T = B'B, met at every place."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        d, ell = a * a, b / a[:-1]
        self.down, self.lower = np.empty(n), np.empty(n - 1)
        s = np.empty(n)
        s[0] = -value
        for i in range(n):
            pivot = s[i] + d[i]
            self.down[i] = pivot if pivot else EPS * abs(value) + 1e-300
            if i + 1 < n:
                self.lower[i] = d[i] * ell[i] / self.down[i]
                s[i + 1] = self.lower[i] * ell[i] * s[i] - value
        self.up, self.upper = np.empty(n), np.empty(n - 1)
        p = np.empty(n)
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            pivot = d[i] * ell[i] * ell[i] + p[i + 1]
            self.up[i + 1] = pivot if pivot else EPS * abs(value) + 1e-300
            ratio = d[i] / self.up[i + 1]
            self.upper[i] = ell[i] * ratio
            p[i] = p[i + 1] * ratio - value
        gamma = s + p + value
        self.twist = int(np.nanargmin(np.abs(gamma)))
        self.gamma = gamma[self.twist] if gamma[self.twist] else EPS * abs(value) + 1e-300

    def vector(self) -> np.ndarray:
        """Solves N' z = (1 at the twist)."""
        z, k = np.zeros(len(self.down)), self.twist
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.lower[i] * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] = -self.upper[i] * z[i]
        return _unit(z)

    def solve(self, r: np.ndarray) -> np.ndarray:
        """(T - value I)^-1 r, scaled to length one."""
        y, k, n = r.copy(), self.twist, len(r)
        for i in range(1, k):
            y[i] -= self.lower[i - 1] * y[i - 1]
        for i in range(n - 2, k, -1):
            y[i] -= self.upper[i] * y[i + 1]
        if k > 0:
            y[k] -= self.lower[k - 1] * y[k - 1]
        if k + 1 < n:
            y[k] -= self.upper[k] * y[k + 1]
        x = np.empty(n)
        x[k] = y[k] / self.gamma
        for i in range(k - 1, -1, -1):
            x[i] = y[i] / self.down[i] - self.lower[i] * x[i + 1]
        for i in range(k, n - 1):
            x[i + 1] = y[i + 1] / self.up[i + 1] - self.upper[i] * x[i]
        return _unit(x)


def _block_vectors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors (as columns) of B'B for a bidiagonal B without zeros above the diagonal.

    A vector that is no longer one after it was made orthogonal to close ones is iterated anew from a random start.
    """
    values = squared_values(a, b)
    vectors = np.zeros((len(a), len(a)))
    random = np.random.default_rng(len(a))
    for j, value in enumerate(values):
        twisted = Twisted(a, b, float(value))
        near = vectors[:, [i for i in range(j) if values[i] - value <= CLOSE * values[i]]]
        z = twisted.vector()
        for attempt in range(12):
            for _ in range(3):
                z = z - near @ (near.T @ z)
                size = float(np.linalg.norm(z))
                z = z / size if size > 0.0 and np.isfinite(size) else random.standard_normal(len(a))
            product = a * z
            product[:-1] += b * z[1:]
            back = a * product
            back[1:] += b * product[:-1]
            if size > 0.5 and np.abs(back - value * z).max() <= 64 * EPS * values[0]:
                break
            start = random.standard_normal(len(a)) if attempt % 4 == 0 else z
            z = twisted.solve(start - near @ (near.T @ start))
        vectors[:, j] = z
    return values, vectors


def right_vectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, largest first, and the right singular vectors of a square matrix as columns."""
    a, b, right = bidiagonalise(matrix)
    n, scale = len(a), max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(n), right
    least = EPS * scale / 1024  # below the rounding of the reflections
    a = np.where(np.abs(a) < least, least, a)
    edges = np.r_[0, np.flatnonzero(np.abs(b) <= EPS * scale / 8) + 1, n]
    values, vectors = np.zeros(n), np.zeros((n, n))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        values[s:e], vectors[s:e, s:e] = _block_vectors(a[s:e], b[s : e - 1])
    order = np.argsort(-values, kind="stable")
    return values[order], right @ vectors[:, order]
