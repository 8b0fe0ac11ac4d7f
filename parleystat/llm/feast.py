"""The largest eigenvalues of a symmetric matrix by contour integration (FEAST; Polizzi, 2009).

A contour round an interval of eigenvalues turns solves with complex shifts into a projector on their eigenspace,
Rayleigh-Ritz takes values and vectors out of the projected space, and the inertia of shifted matrices says how many
there have to be.
"""

from __future__ import annotations

import numpy as np

#: Points of the quadrature on the upper half of a contour, and how often a subspace is refined.
NODES = 8
ROUNDS = 60
#: Eigenvalues that one contour encloses, unless they lie closer together than `APART` of the matrix's norm.
PER_CONTOUR = 4
APART = 1e-9
_EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with the same eigenvalues, by Householder reflections."""
    a = np.array(matrix, float)
    n = len(a)
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        if size == 0:
            continue
        u[0] += size if u[0] >= 0 else -size
        u /= np.linalg.norm(u)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        p -= (u @ p) * u
        rest -= 2 * (np.outer(u, p) + np.outer(p, u))
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """Eigenvalues less than `shift`: the negative pivots of the shifted matrix, by Sylvester's law of inertia."""
    tiny = _EPS * (np.abs(diagonal).max(initial=0.0) + np.abs(side).max(initial=0.0) + abs(shift)) + 1e-300
    count, pivot = 0, 1.0
    for k, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (side[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def _bisected(diagonal: np.ndarray, side: np.ndarray, rank: int, low: float, high: float) -> float:
    """About the eigenvalue of which `rank` are greater or equal."""
    n, width = len(diagonal), high - low
    while high - low > 1e-12 * width:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if n - below(diagonal, side, middle) >= rank:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def _contours(values: list[float], apart: float, low: float, high: float) -> list[tuple[float, float]]:
    """Intervals that part falling `values` in the middle of gaps; the last value is only a neighbour to keep out."""
    edges, first = [high], 0
    for k in range(1, len(values)):
        gap = values[k - 1] - values[k]
        ahead = [values[j - 1] - values[j] for j in range(k + 1, min(first + PER_CONTOUR, len(values) - 1) + 1)]
        if gap > apart and (k - first >= PER_CONTOUR or k == len(values) - 1 or gap >= max(ahead, default=0.0)):
            edges.append((values[k - 1] + values[k]) / 2)
            first = k
    if first < len(values) - 1:
        edges.append(low)
    return [(b, a) for a, b in zip(edges, edges[1:])]


def _projected(matrix: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """The quadrature of the resolvent times `y` along a circle over the interval."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    out, one = np.zeros_like(y), np.eye(len(matrix))
    for t, w in zip(nodes, weights):
        turn = np.exp(1j * np.pi / 2 * (1 - t))
        out += (w / 2) * np.real(radius * turn * np.linalg.solve((middle + radius * turn) * one - matrix, y.astype(complex)))
    return out


def inside(matrix: np.ndarray, low: float, high: float, expected: int) -> tuple[np.ndarray, np.ndarray]:
    """The `expected` eigenvalues in an interval with their vectors. Raises if they can't all be found."""
    n, norm = len(matrix), np.abs(matrix).sum(axis=1).max()
    draw = np.random.default_rng(n)
    size = min(n, 2 * expected + 6)
    while True:
        y, last = draw.normal(size=(n, size)), np.inf
        for _ in range(ROUNDS):
            q, _ = np.linalg.qr(_projected(matrix, y, low, high))
            small = q.T @ matrix @ q
            values, turned = np.linalg.eigh((small + small.T) / 2)
            y = q @ turned
            off = np.linalg.norm(matrix @ y - y * values, axis=0)
            held = np.flatnonzero((values > low) & (values < high) & (off < 1e-10 * norm))
            worst = off[held].max(initial=0.0)
            if len(held) == expected and (worst <= 4 * _EPS * norm or worst >= last / 2):
                return values[held], y[:, held]
            last = worst if len(held) == expected else np.inf
        if size == n:
            raise ArithmeticError(f"{len(held)} of {expected} eigenvalues found between {low} and {high}")
        size = min(n, 2 * size)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` positive eigenvalues, falling, and unit eigenvectors as columns.

    Values that rounding can't tell from zero are left out. Equal eigenvalues share a contour, and which of their
    vectors come is arbitrary.
    """
    n, norm = len(matrix), np.abs(matrix).sum(axis=1).max(initial=0.0)
    none = np.empty(0), np.empty((n, 0))
    if not norm:
        return none
    diagonal, side = tridiagonal(matrix)
    floor, ceiling = n * _EPS * norm, norm * 1.01
    positive = n - below(diagonal, side, floor)
    rank = min(most, positive)
    if not rank:
        return none
    values = [_bisected(diagonal, side, k, floor, ceiling) for k in range(1, rank + 1)]
    while len(values) < positive and values[rank - 1] - values[-1] <= APART * norm:
        values.append(_bisected(diagonal, side, len(values) + 1, floor, ceiling))
    if len(values) == positive and values[rank - 1] - values[-1] <= APART * norm:
        values.append(0.0)
    vectors, found = [], 0
    for low, high in _contours(values, APART * norm, floor / 2, ceiling):
        expected = below(diagonal, side, high) - below(diagonal, side, low)
        if expected:
            vectors.append(inside(matrix, low, high, expected)[1])
            found += expected
    if found < rank:
        raise ArithmeticError(f"{found} of {rank} eigenvalues lie inside the contours")
    q, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    small = q.T @ matrix @ q
    least, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-least, kind="stable")[:rank]
    return least[order], (q @ turned)[:, order]
