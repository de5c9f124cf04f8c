"""Singular values and right singular vectors of a small square matrix by qd transformations.

Householder reflections bring the matrix to upper bidiagonal form (diagonal a, superdiagonal b).
The differential qd algorithm with shifts finds the squared singular values from q = a^2 and
e = b^2 by quotients and sums of positive numbers, so also the small ones are right to nearly all
digits.  A singular vector solves a twisted factorisation of B'B - s^2: the stationary
factorisation from the top and the progressive one from the bottom meet at the row with the
smallest pivot, and the vector follows by products alone.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
SPLIT = (10 * EPS) ** 2  # an e so much smaller than its q counts as zero
NEAR = 1e-4  # squares closer than this (relative) share a cluster
TINY = np.finfo(float).tiny / EPS


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(unit v, head): I - 2vv' takes x to (head, 0, ...)."""
    top = np.abs(x).max(initial=0.0)
    if top == 0.0 or not np.abs(x[1:]).max(initial=0.0):
        return np.zeros_like(x), float(x[0])
    scaled = x / top
    head = -np.copysign(np.linalg.norm(scaled), scaled[0])
    v = scaled.copy()
    v[0] -= head
    return v / np.linalg.norm(v), float(head * top)


def bidiagonalised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(a, b, right reflectors) of a square matrix."""
    m = np.array(matrix, dtype=float)
    n = len(m)
    a, b, right = np.zeros(n), np.zeros(max(0, n - 1)), []
    for k in range(n):
        v, a[k] = _reflector(m[k:, k].copy())
        m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k < n - 1:
            w, b[k] = _reflector(m[k, k + 1 :].copy())
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
            right.append(w)
    return a, b, right


def _dqds(q: list[float], e: list[float], shift: float, slack: float) -> tuple[list[float], list[float], list[float]]:
    """One transformation: (q, e, d) of the matrix less ``shift``; a d below zero by rounding (``slack``) is zero."""
    d, out_q, out_e, seen = q[0] - shift, [], [], []
    for k, off in enumerate(e):
        d = 0.0 if -slack <= d < 0.0 else d
        seen.append(d)
        head = d + off
        out_q.append(head)
        ratio = q[k + 1] / head if head else 0.0
        out_e.append(off * ratio)
        d = d * ratio - shift
    d = 0.0 if -slack <= d < 0.0 else d
    seen.append(d)
    out_q.append(d)
    return out_q, out_e, seen


def _least_bound(q: list[float], e: list[float]) -> float:
    """A number not above the least square: the inverse's trace is the sum of 1/d."""
    _, _, d = _dqds(q, e, 0.0, 0.0)
    return 0.0 if min(d) <= 0.0 else (1 - 1e-12 * len(d)) / sum(1 / x for x in d)


def _corner(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows, which the least square does not exceed."""
    trace, product = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
    half = trace / 2
    root = max(0.0, half * half - product) ** 0.5
    return product / (half + root) if half + root > 0.0 else 0.0


def _negligible(upper: float, e: float, lower: float, total: float) -> bool:
    """Whether an e moves no square, all at least ``total``, by more than rounding."""
    return e <= SPLIT * (total + min(upper, lower)) or e * (upper + lower + e) <= (EPS * total / 8) ** 2


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, largest first."""
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if top == 0.0:
        return np.zeros(len(a))
    open_blocks = [([float(x) for x in (a / top) ** 2], [float(x) for x in (b / top) ** 2], 0.0)]
    found: list[float] = []
    while open_blocks:
        q, e, total = open_blocks.pop()
        turns, most = 0, 60 * len(q) + 600
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if _negligible(q[k], e[k], q[k + 1], total)), None)
            if cut is not None:
                if cut < len(e) - 1:  # the lower part goes on its own
                    open_blocks.append((q[cut + 1 :], e[cut + 1 :], total))
                else:
                    found.append(q[-1] + total)
                q, e = q[: cut + 1], e[:cut]
                continue
            if 1.5 * q[0] < q[-1]:  # graded upside down
                q, e = q[::-1], e[::-1]
            turns += 1
            if turns > most:
                raise ArithmeticError("no convergence")
            slack = 4 * EPS * total
            shift = _corner(q, e) * (1 - 4 * EPS)
            for _ in range(4):
                new_q, new_e, d = _dqds(q, e, shift, slack)
                if min(d) >= 0.0:
                    break
                # above the least square: a failure in the last place alone says by how much
                late = shift + d[-1] if min(d[:-1]) >= 0.0 else 0.0
                shift = max(late * (1 - 4 * EPS), _least_bound(q, e))
            else:
                shift = 0.0
                new_q, new_e, d = _dqds(q, e, shift, slack)
            q, e, total = new_q, new_e, total + shift
        found += [x + total for x in q]
    return np.sort(np.array(found))[::-1] * top**2


class Twisted:
    """Both factorisations of B'B - square and the vectors that they give."""

    def __init__(self, a: np.ndarray, b: np.ndarray, square: float):
        n = len(a)
        aa, bb, ab = a * a, b * b, a[:-1] * b
        s, p = np.empty(n), np.empty(n)
        self.down, self.up = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
        s[0], p[-1] = -square, aa[-1] - square
        for k in range(n - 1):
            pivot = s[k] + aa[k] or TINY
            self.down[k] = ab[k] / pivot
            s[k + 1] = bb[k] * (s[k] / pivot) - square
        for k in range(n - 2, -1, -1):
            pivot = bb[k] + p[k + 1] or TINY
            self.up[k] = ab[k] / pivot
            p[k] = aa[k] * (p[k + 1] / pivot) - square
        gamma = np.abs(s + p + square)
        self.rows = np.argsort(np.where(np.isnan(gamma), np.inf, gamma), kind="stable")

    def vector(self, row: int) -> np.ndarray:
        z = np.zeros(len(self.down) + 1)
        z[row] = 1.0
        for k in range(row - 1, -1, -1):
            z[k] = -self.down[k] * z[k + 1]
        for k in range(row, len(self.up)):
            z[k + 1] = -self.up[k] * z[k]
            if abs(z[k + 1]) > 1e150:  # far from the best row
                z /= abs(z[k + 1])
        return z / np.abs(z).max() / np.linalg.norm(z / np.abs(z).max())


def _cluster(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal vectors (rows) for squares that lie close together."""
    basis: list[np.ndarray] = []
    for value in values:
        twisted = Twisted(a, b, value)
        best, weight = None, -1.0
        for row in twisted.rows[: 4 * len(values) + 1]:
            z = twisted.vector(int(row))
            for _ in range(2):
                for other in basis:
                    z = z - (other @ z) * other
            size = float(np.linalg.norm(z))
            if size > weight:
                best, weight = z / (size or 1.0), size
            if size > 0.3:
                break
        basis.append(best)
    found = np.array(basis)
    if len(found) > 1:  # turn the basis to the vectors themselves
        image = found * a
        image[:, :-1] += found[:, 1:] * b
        _, turned = np.linalg.eigh(image @ image.T)
        found = turned[:, ::-1].T @ found
    return found


def parts(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the blocks between entries of b that are rounding beside both neighbours."""
    none = np.abs(b) <= 16 * EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))
    cuts = [0, *(np.flatnonzero(none) + 1).tolist(), len(a)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def singular(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares, right vectors as rows) of the ``most`` largest singular values above rounding."""
    n = len(matrix)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    a, b, right = bidiagonalised(matrix)
    blocks = [(lo, hi, squares(a[lo:hi], b[lo : hi - 1])) for lo, hi in parts(a, b)]
    every = np.sort(np.concatenate([v for *_, v in blocks]))[::-1]
    least = max(every[min(most, n) - 1], every[0] * (n * EPS) ** 2)
    found = []
    for lo, hi, values in blocks:
        k = 0
        while k < len(values) and values[k] >= least and values[k] > 0:
            end = k + 1
            while end < len(values) and values[end - 1] - values[end] <= NEAR * values[end - 1]:
                end += 1
            for value, own in zip(values[k:end], _cluster(a[lo:hi], b[lo : hi - 1], values[k:end]), strict=True):
                whole = np.zeros(n)
                whole[lo:hi] = own / np.linalg.norm(own)
                found.append((value, whole))
            k = end
    found = sorted(found, key=lambda pair: -pair[0])[:most]
    vectors = np.array([v for _, v in found]).reshape(-1, n)
    for k in range(len(right) - 1, -1, -1):  # back through the reflections
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ right[k], right[k])
    return np.array([v for v, _ in found]), vectors
