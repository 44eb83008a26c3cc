"""Singular values and right vectors of a small matrix: Householder bidiagonal form, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Singular values whose squares lie closer together than this share are made orthogonal to each other.
CLOSE = 1e-3


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right rotation ``p`` with ``matrix = u @ b @ p.T`` for a square matrix."""
    a = np.array(matrix, dtype=float)
    d = len(a)
    p = np.eye(d)
    for k in range(d):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, beta = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ v, v)
            p[:, k + 1:] -= beta * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` and ``beta`` of the reflection ``1 - beta v v'`` that leaves only the first entry of ``x``."""
    scale = np.abs(x).max(initial=0.0)
    if len(x) < 2 or scale == 0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0
    v = x / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v, 2.0 / (v @ v)


def qd_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal with squared diagonal ``q`` and upper diagonal ``e``.

    Each sweep subtracts a shift that is a lower bound of the smallest value left (one that proves
    too large is taken back), so values are sums of positive terms and small ones stay accurate.
    """
    found: list[float] = []
    parts = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while parts:
        q, e, sigma = parts.pop()
        guess = 0.0
        while q:
            if len(q) == 1:
                found.append(sigma + q.pop())
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut == len(e) - 1:
                found.append(sigma + q.pop())
                e.pop()
                guess = 0.0
                continue
            if cut is not None:
                parts.append((q[:cut + 1], e[:cut], sigma))
                q, e, guess = q[cut + 1:], e[cut + 1:], 0.0
                continue
            if q[0] < q[-1]:  # the small end belongs to the bottom
                q.reverse()
                e.reverse()
            shift = guess
            for _ in range(4):
                swept = _sweep(q, e, shift)
                if swept is not None:
                    break
                shift *= 0.5
            else:
                shift = 0.0
                swept = _sweep(q, e, 0.0)
            q, e, least = swept
            sigma += shift
            # the least pivot bounds the smallest value from above, the last rows from below once they stand apart
            last = q[-1] - e[-1] - 2 * (e[-1] * max(q[-1], 0.0)) ** 0.5
            guess = max(0.0, min(0.98 * least, last if last > 0 else 0.25 * least))
    return np.sort(np.array(found))[::-1]


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd sweep; nothing if the shift exceeds the smallest value."""
    out_q, out_e = [], []
    d = least = q[0] - shift
    for k, off in enumerate(e):
        if d < 0:
            return None
        top = d + off
        if top == 0:
            top = 1e-300
        ratio = q[k + 1] / top
        out_q.append(top)
        out_e.append(off * ratio)
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    return [*out_q, d], out_e, least


class Twisted:
    """The factorisation of ``b.T b - value`` from both ends that meets where its pivot is smallest."""

    def __init__(self, diagonal: np.ndarray, upper: np.ndarray, value: float) -> None:
        n = len(diagonal)
        big, low = diagonal ** 2, upper / diagonal[:-1]
        tiny = EPS * EPS * max(value, float(big.max()), 1e-290)
        self.down, self.lower = np.empty(n), np.empty(n - 1)
        self.up, self.higher = np.empty(n), np.empty(n - 1)
        s, p = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n):
            pivot = s[i] + big[i]
            self.down[i] = pivot if abs(pivot) > tiny else -tiny
            if i < n - 1:
                self.lower[i] = big[i] * low[i] / self.down[i]
                s[i + 1] = self.lower[i] * low[i] * s[i] - value
        p[-1] = big[-1] - value
        for i in range(n - 2, -1, -1):
            pivot = big[i] * low[i] ** 2 + p[i + 1]
            self.up[i + 1] = pivot if abs(pivot) > tiny else -tiny
            ratio = big[i] / self.up[i + 1]
            self.higher[i] = low[i] * ratio
            p[i] = p[i + 1] * ratio - value
        gamma = s + p + value
        self.at = int(np.argmin(np.abs(gamma)))
        # not below rounding, or solutions for close values would all be this vector
        self.pivot = float(np.copysign(max(abs(gamma[self.at]), EPS * value, tiny), gamma[self.at]))

    def solve(self, f: np.ndarray) -> np.ndarray:
        n, r = len(f), self.at
        y = np.array(f, dtype=float)
        for i in range(1, r):
            y[i] -= self.lower[i - 1] * y[i - 1]
        for i in range(n - 2, r, -1):
            y[i] -= self.higher[i] * y[i + 1]
        if r > 0:
            y[r] -= self.lower[r - 1] * y[r - 1]
        if r < n - 1:
            y[r] -= self.higher[r] * y[r + 1]
        y[:r] /= self.down[:r]
        y[r] /= self.pivot
        y[r + 1:] /= self.up[r + 1:]
        for i in range(r - 1, -1, -1):
            y[i] -= self.lower[i] * y[i + 1]
        for i in range(r + 1, n):
            y[i] -= self.higher[i - 1] * y[i - 1]
        return y

    def vector(self) -> np.ndarray:
        start = np.zeros(len(self.down))
        start[self.at] = self.pivot
        z = self.solve(start)
        return z / np.linalg.norm(z)


def right_vectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest squared singular values of a square matrix and their right vectors as columns.

    The entry of largest size in each vector is positive. Values that (nearly) coincide get some
    orthonormal basis of their common space. Zero values have vectors too.
    """
    diagonal, upper, p = bidiagonal(matrix)
    d = len(diagonal)
    size = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0))
    if size == 0:
        return np.zeros(min(k, d)), np.eye(d)[:, :min(k, d)]
    diagonal, upper = diagonal / size, upper / size
    diagonal = np.where(np.abs(diagonal) < EPS * EPS, EPS * EPS, diagonal)
    # rounding of the reflections is as large as what is cut here
    cuts = [i + 1 for i in range(d - 1) if abs(upper[i]) <= EPS]
    blocks = list(zip([0, *cuts], [*cuts, d]))
    values = sorted(((v, start, stop) for start, stop in blocks
                     for v in qd_values(diagonal[start:stop] ** 2, upper[start:stop - 1] ** 2)), reverse=True)[:k]
    columns: list[np.ndarray] = []
    near: dict[tuple[int, int], list[tuple[float, np.ndarray]]] = {}
    rng = np.random.default_rng(1)
    for value, start, stop in values:
        group = near.setdefault((start, stop), [])
        if group and group[-1][0] - value > CLOSE * group[-1][0] and group[-1][0] > (d * EPS) ** 2:
            group.clear()
        z = _vector(diagonal[start:stop], upper[start:stop - 1], value, [v for _, v in group], rng)
        group.append((value, z))
        whole = p[:, start:stop] @ z
        columns.append(whole * np.copysign(1.0, whole[np.argmax(np.abs(whole))]))
    return np.array([v for v, _, _ in values]) * size ** 2, np.array(columns).T


def _vector(diagonal: np.ndarray, upper: np.ndarray, value: float, others: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Vector of one value, orthogonal to those of the close values before it."""
    if len(diagonal) == 1:
        return np.ones(1)
    twisted = Twisted(diagonal, upper, value)
    z = twisted.vector()
    if not others:
        return z
    basis = np.array(others).T
    apart = z - basis @ (basis.T @ z)
    if np.linalg.norm(apart) < 0.5:  # mostly a vector found before: iterate from a start outside of those
        # a little aside, so that no vector of the group is amplified far beyond the others
        twisted = Twisted(diagonal, upper, value * (1 - 16 * EPS))
        apart = rng.standard_normal(len(z))
        for _ in range(4):
            apart -= basis @ (basis.T @ apart)
            apart -= basis @ (basis.T @ apart)
            apart = twisted.solve(apart / np.linalg.norm(apart))
            apart /= np.linalg.norm(apart)
    for _ in range(2):
        apart -= basis @ (basis.T @ apart)
        apart /= np.linalg.norm(apart)
    return apart
