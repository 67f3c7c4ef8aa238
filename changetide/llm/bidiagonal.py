"""Singular values and right singular vectors of a small square matrix by way of its bidiagonal form.

Householder reflections make the matrix bidiagonal. The differential quotient-difference algorithm
with shifts (dqds) finds the squares of the singular values; it only adds, multiplies and divides
positive numbers, so small ones keep their relative accuracy. Its shifts come from two lower bounds of the
smallest eigenvalue: the reciprocal of the inverse's trace, which a pass without a shift yields, and the
least diagonal element less the rest of its row. Vectors come from twisted factorisations: factored from the top and from the
bottom, joined at the row where the remainder is smallest.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Vectors of values closer than this, relatively, are made orthogonal to each other explicitly.
CLOSE = 1e-3


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector u for which x - 2 u (u·x) has a first entry only; zeros where x is done already."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0 or not np.abs(x[1:]).max(initial=0.0):
        return np.zeros_like(x)
    u = x / scale
    u[0] += np.copysign(np.linalg.norm(u), u[0])
    return u / np.linalg.norm(u)


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): square = u @ (a on the diagonal, b right above it) @ v.T, u and v orthogonal."""
    m = np.array(square, np.float64)
    n = len(m)
    v = np.eye(n)
    for k in range(n):
        u = _reflector(m[k:, k])
        m[k:, k:] -= 2 * np.outer(u, u @ m[k:, k:])
        u = _reflector(m[k, k + 1 :])
        m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ u, u)
        v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _pass(q: list, e: list, shift: float):
    """One dqds step: (q, e, the d's) of the next matrix, or None where the shift is too large."""
    d = q[0] - shift
    if d < 0:
        return None
    new_q, new_e, seen = [], [], [d]
    for k, upper in enumerate(e):
        total = d + upper
        ratio = q[k + 1] / total if total > 0 else 0.0
        new_q.append(total)
        new_e.append(upper * ratio)
        d = d * ratio - shift if total > 0 else q[k + 1] - shift
        if d < 0:
            return None
        seen.append(d)
    new_q.append(d)
    return new_q, new_e, seen


def _negligible(before: float, between: float, after: float, sigma: float) -> bool:
    """Does dropping the element between two diagonal ones move no value by more than rounding does?"""
    value = sigma + min(before, after)
    return between <= 0.01 * EPS * EPS * value or between * max(before, between, after) <= (0.1 * EPS * value) ** 2


def _rows(q: list, e: list) -> float:
    """The least diagonal element less its row's others: no value is below it. It is sharp for clusters."""
    beside = [0.0, *((a * b) ** 0.5 for a, b in zip(q, e)), 0.0]
    return min(a + b - beside[k] - beside[k + 1] for k, (a, b) in enumerate(zip(q, [0.0, *e])))


def dqds(q: list[float], e: list[float]) -> list[float]:
    """The squared singular values of a bidiagonal matrix with squares q on and e above the diagonal."""
    found, open_blocks = [], [(list(q), list(e), 0.0)]
    while open_blocks:
        q, e, sigma = open_blocks.pop()
        if len(q) > 1 and 1.5 * q[0] < q[-1]:  # the algorithm goes on at the end, where small ones should be
            q, e = q[::-1], e[::-1]
        for _ in range(60 + 20 * len(q)):
            if max(q) + max(e, default=0.0) <= 4 * len(q) * EPS * sigma or len(q) == 1:
                found += [sigma + value for value in q]  # what is left is rounding, or done
                break
            cut = next((k for k in reversed(range(len(e))) if _negligible(q[k], e[k], q[k + 1], sigma)), None)
            if cut is not None:
                open_blocks.append((q[: cut + 1], e[:cut], sigma))
                open_blocks.append((q[cut + 1 :], e[cut + 1 :], sigma))
                break
            q, e, seen = _pass(q, e, 0.0)
            shift = (1 - 8 * EPS) * max(1 / sum(1 / d for d in seen), _rows(q, e)) if min(seen) > 1e-300 else 0.0
            while shift > EPS * EPS * sigma:
                step = _pass(q, e, shift)
                if step:
                    q, e, sigma = step[0], step[1], sigma + shift
                    break
                shift *= 0.9 if shift > 0.5 * min(seen) / len(seen) else 0.25
        else:
            raise ArithmeticError("dqds did not converge")
    return sorted(found, reverse=True)


def _twisted(a: np.ndarray, b: np.ndarray, value: float):
    """(z for a twist row, rows by falling merit) of the transposed bidiagonal times itself, less value."""
    n, tiny = len(a), EPS * value * 1e-3
    pivots, low = a * a, b / a[:-1]
    s, plus = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + pivots[i] or tiny
        plus[i] = pivots[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p, minus = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = pivots[-1] - value
    for i in range(n - 2, -1, -1):
        ratio = pivots[i] / (pivots[i] * low[i] * low[i] + p[i + 1] or tiny)
        minus[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    remainder = s + p + value

    def vector(row: int) -> np.ndarray:
        z = np.zeros(n)
        z[row] = 1.0
        for i in range(row - 1, -1, -1):
            z[i] = -plus[i] * z[i + 1]
        for i in range(row, n - 1):
            z[i + 1] = -minus[i] * z[i]
        return z / np.linalg.norm(z)

    return vector, np.argsort(np.abs(remainder), kind="stable")


def decomposed(square: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares, directions): all squared singular values, falling, and the right singular vectors of the
    first ones, at most so many, as columns. Vectors of values that are zero to rounding are left out."""
    a, b, v = bidiagonal(square)
    n = len(a)
    norm = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if norm == 0:
        return np.zeros(n), np.zeros((n, 0))
    a, b = a / norm, b / norm
    a[np.abs(a) < EPS * EPS] = EPS * EPS  # far below what rounding has left undecided
    edges = [0, *(np.flatnonzero(np.abs(b) <= 0.1 * EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))) + 1), n]
    values = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        own = dqds((a[low:high] ** 2).tolist(), (b[low : high - 1] ** 2).tolist())
        values += [(value, i) for value in own]
    values.sort(key=lambda x: -x[0])
    floor = (n * EPS) ** 2 * values[0][0]
    found: list[np.ndarray] = []
    for at, (value, block) in enumerate(values[:most]):
        if value <= floor:
            break
        low, high = edges[block], edges[block + 1]
        vector, rows = _twisted(a[low:high], b[low : high - 1], value)
        near = [found[i] for i in range(at) if values[i][0] - value <= CLOSE * values[i][0]]
        best, kept = None, 0.0
        for row in rows:  # the first one, but for values that are equal to rounding
            z = np.zeros(n)
            z[low:high] = vector(row)
            for _ in range(2):
                for other in near:
                    z -= other * (other @ z)
            left = np.linalg.norm(z)
            if np.isfinite(left) and left > kept:
                best, kept = z / left, left
            if kept > 0.1:
                break
        for other in near:
            best = best - other * (other @ best)
        found.append(best / np.linalg.norm(best))
    directions = v @ np.array(found).T if found else np.zeros((n, 0))
    return np.array([x[0] for x in values]) * norm**2, directions
