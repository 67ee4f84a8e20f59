"""Eigenvectors of a symmetric matrix by spectral divide and conquer with polar decompositions (QDWH).

The polar factor U of A - shift * I is the matrix sign, so (U + I) / 2 projects on the eigenvectors above the
shift. Bases of the projector's range and null space split the matrix in two, and so on down to single
components. The matrix is as large as a vector is long, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
CLOSE = 1e-9


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps."""
    n, eye = len(a), np.eye(len(a))
    size = np.linalg.norm(a)
    if size == 0:
        return eye
    x, low = a / size, EPS
    for _ in range(12):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # a QR factorisation while the weights are large, a Cholesky factorisation afterwards
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            step = (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(eye + wc * x.T @ x)
            step = (wa - wb / wc) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        after = wb / wc * x + step
        after = (after + after.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved, x = np.linalg.norm(after - x), after
        if abs(1 - low) < 10 * EPS and moved < (4 * EPS) ** (1 / 3):
            break
    return x


def _basis(projector: np.ndarray, k: int) -> np.ndarray:
    """k orthonormal columns that span the range of a projector."""
    q = np.random.Generator(np.random.PCG64(k)).standard_normal((len(projector), k))
    for _ in range(3):
        q, _ = np.linalg.qr(projector @ q)
    return q


def _shifts(a: np.ndarray) -> list[float]:
    """Where the spectrum may be cut. The mean lies inside it unless all eigenvalues are equal."""
    diagonal = np.diag(a)
    mean, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(len(a))) / np.sqrt(len(a))
    return [float(np.median(diagonal)), *(float(mean + f * spread) for f in (0, 0.03, -0.07, 0.15, -0.31, 0.6, -0.9))]


def _split(a: np.ndarray, scale: float) -> np.ndarray:
    """Orthonormal columns that make `a` diagonal."""
    n = len(a)
    if n == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= n * EPS * scale:
        return np.eye(n)
    for shift in _shifts(a):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(np.trace(projector))
        if 0 < k < n and np.linalg.norm(projector @ projector - projector) <= 1e-8:
            break
    else:  # all eigenvalues agree to rounding: any basis will do
        return np.eye(n)
    parts = [_basis(projector, k), _basis(np.eye(n) - projector, n - k)]
    q, _ = np.linalg.qr(np.hstack(parts))
    above, below = q[:, :k], q[:, k:]
    return np.hstack([part @ _split((m := part.T @ a @ part) / 2 + m.T / 2, scale) for part in (above, below)])


def _refined(a: np.ndarray, x: np.ndarray, steps: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) after steps of iterative refinement in the precision of `a`.

    Eigenvalues nearer to each other than `CLOSE` of the norm count as equal: their vectors are only made orthogonal.
    """
    eye, norm = np.eye(len(a), dtype=a.dtype), np.linalg.norm(a.astype(float))
    for _ in range(steps):
        r, s = eye - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        unsure = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + norm * np.linalg.norm(r.astype(float)))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > max(unsure, CLOSE * norm)
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return values, x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, given in extended precision.

    The largest entry of each eigenvector is positive.
    """
    work = a.astype(np.float64)
    start = _split(work, float(np.linalg.norm(work)))
    values, vectors = _refined(a, start.astype(a.dtype))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order].astype(np.float64), vectors[:, order].astype(np.float64)
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)
