"""Largest eigenpairs of a symmetric matrix by contour integration, with inertia counts.

An interval of the real axis is enclosed by a circle. Quadrature of the resolvent (z I - V)^-1 along it, applied to some
vectors, projects them onto the eigenvectors whose eigenvalues lie inside; Rayleigh-Ritz on the projected vectors gives
eigenpairs, and the step repeats until their residuals are as small as rounding allows. The inertia of V - s I, read from a
pivoted block LDL^T, says how many eigenvalues lie above s: it places the intervals and proves that none is missed.

The matrix is the covariance of one table's vectors, so its order is their dimension; it is held by one process.
"""

from __future__ import annotations

import numpy as np

#: The largest diagonal entry is a pivot if it is this share of the largest entry beside it in its column; else two rows are.
_PIVOT = (1 + 17**0.5) / 8
_POINTS = 8
_ROUNDS = 30


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: the positive part of the inertia of the shifted matrix."""
    a = np.array(matrix, np.float64) - shift * np.eye(len(matrix))
    positive, left = 0, len(a)

    def last(i: int, to: int) -> None:
        if i != to:
            a[[i, to], :left] = a[[to, i], :left]
            a[:left, [i, to]] = a[:left, [to, i]]

    while left:
        i = int(np.argmax(np.abs(np.diagonal(a)[:left])))
        beside = np.abs(a[:left, i])
        beside[i] = 0.0
        other, value = int(np.argmax(beside)), a[i, i]
        if abs(value) >= _PIVOT * beside[other]:
            if value == 0.0:  # the largest diagonal entry and its column are zero: so is the diagonal
                if not a[:left, :left].any():
                    break
                i, other = (int(k) for k in np.unravel_index(int(np.argmax(np.abs(a[:left, :left]))), (left, left)))
            else:
                positive += int(value > 0)
                last(i, left - 1)
                left -= 1
                side = a[:left, left].copy()
                a[:left, :left] -= np.outer(side, side / a[left, left])
                continue
        # A pivot of order two has one eigenvalue of each sign, as no diagonal entry is larger than the one left aside.
        positive += 1
        last(max(i, other), left - 1)
        last(min(i, other), left - 2)
        left -= 2
        side = a[:left, left : left + 2].copy()
        a[:left, :left] -= side @ np.linalg.solve(a[left : left + 2, left : left + 2], side.T)
    return positive


def _bound(matrix: np.ndarray) -> float:
    """Above all eigenvalues (discs around the diagonal)."""
    return float(np.abs(matrix).sum(axis=1).max(initial=0.0)) * (1 + 1e-9)


def _next_value(matrix: np.ndarray, above: int, low: float, high: float, step: float) -> tuple[float, float] | None:
    """Bounds, at most ``step`` apart, of the largest eigenvalue with ``above`` others above it; none below ``low``."""
    if count_above(matrix, low) <= above:
        return None
    while high - low > step:
        middle = (low + high) / 2
        if count_above(matrix, middle) > above:
            low = middle
        else:
            high = middle
    return low, high


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, together ``wanted`` eigenvalues or more.

    Eigenvalues are located by inertia to a millionth of the norm; those that lie closer than three such steps share an interval.
    It reaches half-way into the gaps to its neighbours, so the contour keeps away from all eigenvalues.
    """
    top = _bound(matrix)
    bottom, step = -top - 1.0, 1e-6 * top
    groups, found, high = [], 0, top
    while found < len(matrix):
        bounds = _next_value(matrix, found, bottom, high, step)
        if bounds is None:
            break
        low, above = bounds
        inside = count_above(matrix, low)
        while (more := count_above(matrix, low - 3 * step)) > inside:
            low, inside = low - 3 * step, more
        groups.append((low, above, inside - found, found >= wanted))
        if found >= wanted:
            break  # only its place was needed
        found, high = inside, low
    out = []
    for k, (low, above, inside, beyond) in enumerate(groups):
        if beyond:
            break
        gaps = [g[0] - above for g in groups[k - 1 : k] if k] + [low - g[1] for g in groups[k + 1 : k + 2]]
        reach = min(gaps, default=top) / 2
        out.append((low - reach, above + reach, inside))
    return out


def _projected(matrix: np.ndarray, low: float, high: float, vectors: np.ndarray) -> np.ndarray:
    """Quadrature of the resolvent along the upper half circle; the lower half gives the conjugate."""
    centre, radius = (low + high) / 2, (high - low) / 2
    places, weights = np.polynomial.legendre.leggauss(_POINTS)
    total = np.zeros(vectors.shape)
    for place, weight in zip(places, weights):
        turn = np.exp(1j * np.pi * (1 - place) / 2)
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, vectors.astype(complex))
        total += weight / 2 * (radius * turn * solved).real
    return total


def pairs_inside(matrix: np.ndarray, low: float, high: float, inside: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenpairs between ``low`` and ``high``, falling; an error if that many do not converge."""
    order, scale = len(matrix), max(_bound(matrix), 1e-300)
    width = min(order, inside + max(4, inside // 2))
    while True:
        best = _converged(matrix, low, high, inside, np.random.default_rng(seed).standard_normal((order, width)), scale)
        if best is not None:
            return best[0][::-1], best[1][:, ::-1]
        if width == order:
            raise ArithmeticError(f"{inside} eigenvalues lie between {low} and {high}, but the contour did not give them")
        width = min(order, 2 * width)  # too many eigenvalues lie just outside: a wider projection converges faster


def _converged(matrix, low: float, high: float, inside: int, vectors: np.ndarray, scale: float):
    """Rounds of projection until residuals no longer fall; None if they do not get small."""
    best = None
    for _ in range(_ROUNDS):
        basis, _ = np.linalg.qr(_projected(matrix, low, high, vectors))
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ turn
        residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        found = np.flatnonzero((values > low) & (values <= high))
        error = float(residual[found].max(initial=0.0))
        if len(found) == inside:
            if best is not None and error >= best[0] / 2 and best[0] <= 1e-9 * scale:
                break  # no longer improving
            if best is None or error < best[0]:
                best = (error, values[found], vectors[:, found])
            if error <= 1e-15 * scale:
                break
    return None if best is None or best[0] > 1e-9 * scale else best[1:]


def largest(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    matrix = np.asarray(matrix, np.float64)
    wanted = min(wanted, len(matrix))
    if wanted == 0 or not matrix.any():
        return np.zeros(wanted), np.eye(len(matrix))[:, :wanted]
    vectors = [pairs_inside(matrix, *interval)[1] for interval in intervals(matrix, wanted)]
    # Vectors of neighbouring intervals are only orthogonal up to the gap between them: one more Rayleigh-Ritz step over all.
    basis, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1][:wanted], (basis @ turn)[:, ::-1][:, :wanted]
