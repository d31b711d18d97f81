"""Leading eigenpairs of one symmetric matrix, whose side is the length of a vector.

Householder reflections bring the matrix to tridiagonal form, Sturm counts bisect for the
wanted eigenvalues, inverse iteration finds their vectors; vectors of eigenvalues that lie
close together are made orthogonal to each other in every step.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
# Neighbouring eigenvalues closer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, beside, q)`` with ``a = q t q'`` for a symmetric ``a``."""
    a = np.array(a, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k]
        tail = np.abs(x[1:]).max()
        if tail == 0.0:
            continue
        v = x / max(tail, abs(x[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        # The reflection I - 2vv' from both sides touches rows and columns from k on.
        a[k + 1:, k:] -= 2.0 * np.outer(v, v @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ v, v)
        q[:, k + 1:] -= 2.0 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def count_below(diagonal: np.ndarray, beside: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each ``x``."""
    tiny = EPS * (np.abs(diagonal).max() + (np.abs(beside).max() if len(beside) else 0.0)) + 1e-300
    below = np.zeros(x.shape, np.int64)
    pivot = np.ones(x.shape)
    for d, b in zip(diagonal, np.concatenate([[0.0], beside])):
        pivot = d - x - b * b / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to the last bit."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], beside])) + np.abs(np.concatenate([beside, [0.0]]))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    slack = EPS * n * max(np.abs(low).max(), np.abs(high).max()) + 1e-300
    low, high = low - slack, high + slack
    rank = n - 1 - np.arange(k)  # the j-th largest has this many below it
    for _ in range(200):
        middle = 0.5 * (low + high)
        if np.all((middle <= low) | (middle >= high)):
            break
        above = count_below(diagonal, beside, middle) > rank
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return 0.5 * (low + high)


def _solver(diagonal: np.ndarray, beside: np.ndarray, value: float, tiny: float):
    """Solve ``(t - value) x = y`` by elimination with row exchanges."""
    n = len(diagonal)
    d, upper, far = diagonal - value, np.append(beside, 0.0), np.zeros(n)
    swap, factor = np.zeros(n, bool), np.zeros(n)
    for i in range(n - 1):
        below = beside[i]
        if abs(below) > abs(d[i]):
            swap[i] = True
            factor[i] = d[i] / below
            d[i], rest = below, upper[i]
            upper[i], far[i] = d[i + 1], upper[i + 1] if i + 2 < n else 0.0
            d[i + 1] = rest - factor[i] * upper[i]
            upper[i + 1] = -factor[i] * far[i]
        else:
            d[i] = d[i] if abs(d[i]) > tiny else tiny
            factor[i] = below / d[i]
            d[i + 1] -= factor[i] * upper[i]
    d[n - 1] = d[n - 1] if abs(d[n - 1]) > tiny else tiny
    d = np.where(np.abs(d) > tiny, d, tiny)

    def solve(y: np.ndarray) -> np.ndarray:
        x = y.copy()
        for i in range(n - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                x[i] -= upper[i] * x[i + 1]
            if i + 2 < n:
                x[i] -= far[i] * x[i + 2]
            x[i] /= d[i]
        return x

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, one column a value; ``values`` fall."""
    n = len(diagonal)
    norm = (np.abs(diagonal).max() + 2.0 * (np.abs(beside).max() if len(beside) else 0.0)) or 1.0
    out = np.zeros((n, len(values)))
    draw = np.random.default_rng(0)
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # Equal values are parted a little, so that their solves differ.
        shift = value if j == first else min(value, shift - 10.0 * EPS * norm)
        solve = _solver(diagonal, beside, shift, EPS * norm)
        x = draw.uniform(-1.0, 1.0, n)
        for _ in range(8):
            x = solve(x / np.linalg.norm(x))
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            if not np.linalg.norm(x) > 0.0:
                x = draw.uniform(-1.0, 1.0, n)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)``: the ``k`` largest eigenvalues, falling, and unit columns."""
    k = min(k, len(a))
    scale = np.abs(a).max() if len(a) else 0.0
    if scale == 0.0:
        return np.zeros(k), np.eye(len(a))[:, :k]
    diagonal, beside, q = tridiagonal(a / scale)
    values = leading_values(diagonal, beside, k)
    vectors = q @ tridiagonal_vectors(diagonal, beside, values)
    # One more orthogonal step over all columns, which differ from it by rounding only.
    for j in range(k):
        vectors[:, j] -= vectors[:, :j] @ (vectors[:, :j].T @ vectors[:, j])
        vectors[:, j] /= np.linalg.norm(vectors[:, j])
    return values * scale, vectors
