"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of A - s I (Sylvester's law, read off a pivoted L D L' factorisation) tells how many eigenvalues
lie above s. Bisection on these counts isolates each leading eigenvalue; inverse iteration at the
middle of its interval and then Rayleigh quotient iteration, which converges cubically, find the pair; two
more counts, just below and just above the value found, certify its number in the order.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + np.sqrt(17)) / 8
_EPS = float(np.finfo(float).eps)


class Factors:
    """P A P' = L D L' with 1x1 and 2x2 pivots chosen by Bunch and Kaufman's rule."""

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, float)
        n = len(a)
        self.order, self.lower, self.blocks = np.arange(n), np.eye(n), []
        self.tiny = _EPS * max(float(np.abs(a).max(initial=0)), np.finfo(float).tiny)
        k = 0
        while k < n:
            size, other = self._pivot(a, k)
            if other is not None:
                at = k + size - 1
                self._swap(a, at, other, k)
            block = a[k:k + size, k:k + size].copy()
            rest = a[k + size:, k:k + size]
            if len(rest) and np.abs(block).max() > 0:
                below = rest / block[0, 0] if size == 1 else rest @ np.linalg.inv(block)
                self.lower[k + size:, k:k + size] = below
                a[k + size:, k + size:] -= below @ rest.T
            self.blocks.append(block)
            k += size

    @staticmethod
    def _pivot(a: np.ndarray, k: int) -> tuple[int, int | None]:
        """Size of the pivot block at k, and the row to bring into its last place."""
        column = np.abs(a[k + 1:, k])
        if not len(column) or column.max() == 0:
            return 1, None
        r = k + 1 + int(column.argmax())
        most, own = column.max(), abs(a[k, k])
        if own >= _ALPHA * most:
            return 1, None
        row = np.abs(a[r, k:]).copy()
        row[r - k] = 0
        if own * row.max() >= _ALPHA * most * most:
            return 1, None
        return (1, r) if abs(a[r, r]) >= _ALPHA * row.max() else (2, r)

    def _swap(self, a: np.ndarray, i: int, j: int, done: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]
        self.lower[[i, j], :done] = self.lower[[j, i], :done]
        self.order[[i, j]] = self.order[[j, i]]

    def positive(self) -> int:
        """Number of positive eigenvalues: positive 1x1 pivots, and one for each 2x2 block (they are indefinite)."""
        return sum(1 if len(b) == 2 else int(b[0, 0] > 0) for b in self.blocks)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """A solution of A x = b; pivots of zero count as rounding errors."""
        y, k = np.linalg.solve(self.lower, b[self.order]), 0
        for block in self.blocks:
            size = len(block)
            if size == 1:
                pivot = block[0, 0]
                y[k] /= pivot if abs(pivot) > self.tiny else self.tiny
            else:
                y[k:k + 2] = np.linalg.solve(block, y[k:k + 2])
            k += size
        x = np.empty_like(y)
        x[self.order] = np.linalg.solve(self.lower.T, y)
        return x


class Slicer:
    """Counts of eigenvalues above a shift, each factorisation done once."""

    def __init__(self, matrix: np.ndarray, seed: int = 11):
        self.a = (matrix + matrix.T) / 2
        self.norm = float(np.abs(self.a).sum(1).max(initial=0))
        self.rounding = 16 * _EPS * self.norm * max(1.0, np.sqrt(len(self.a)))
        self.counts: dict[float, int] = {}
        self.rng = np.random.default_rng(seed)

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = Factors(self.a - shift * np.eye(len(self.a))).positive()
        return self.counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The narrowest known (low, high] with eigenvalue ``number`` (1 is the largest), by the counts so far."""
        bound = self.norm + self.rounding
        low = max((s for s, n in self.counts.items() if n >= number), default=-bound)
        high = min((s for s, n in self.counts.items() if n < number), default=bound)
        return low, high

    def isolate(self, number: int) -> tuple[float, float, int]:
        """(low, high, how many): bisected until the interval holds this eigenvalue alone, or values equal up to rounding."""
        self.above(-self.norm - self.rounding), self.above(self.norm + self.rounding)
        while True:
            low, high = self.interval(number)
            many = self.above(low) - self.above(high)
            if many == 1 or high - low <= 2 * self.rounding:
                return low, high, many
            self.above((low + high) / 2)

    def _inverse(self, shift: float, start: np.ndarray, against: np.ndarray, steps: int) -> np.ndarray:
        factors, v = Factors(self.a - shift * np.eye(len(self.a))), start
        for _ in range(steps):
            v = factors.solve(v)
            v -= against.T @ (against @ v)
            v /= np.linalg.norm(v)
        return v

    def pair(self, number: int, found: np.ndarray) -> tuple[float, np.ndarray]:
        """Eigenvalue ``number`` and its unit eigenvector; ``found``: the earlier vectors, in rows."""
        while True:
            low, high, many = self.isolate(number)
            start = self.rng.standard_normal(len(self.a))
            v = self._inverse((low + high) / 2, start, found if many > 1 else found[:0], 3)
            value, least = float(v @ self.a @ v), np.inf
            while many == 1 and low < value <= high:  # Rayleigh quotient iteration
                left = float(np.linalg.norm(self.a @ v - value * v))
                if left >= least / 2 and left <= 8 * self.rounding:
                    break
                least = min(least, left)
                if left <= _EPS * self.norm / 4:
                    break
                v = self._inverse(value, v, found[:0], 1)
                value = float(v @ self.a @ v)
            inside = low - self.rounding < value <= high + self.rounding
            if inside or high - low <= 2 * self.rounding:
                v = v - found.T @ (found @ v)
                v /= np.linalg.norm(v)
                value = float(v @ self.a @ v)
                return value, v if v[np.abs(v).argmax()] > 0 else -v
            self.above((low + high) / 2)  # the quotient left the interval: a narrower one

    def certified(self, number: int, value: float, vector: np.ndarray) -> bool:
        """Whether the counts below and above the value give it this number."""
        gap = max(2 * float(np.linalg.norm(self.a @ vector - value * vector)), 4 * self.rounding)
        return self.above(value - gap) >= number > self.above(value + gap)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and unit eigenvectors in rows, largest entry positive.

    Values that are zero up to rounding, against the trace of a covariance, end the list. A value
    whose number the counts do not confirm is an error.
    """
    slicer, n = Slicer(matrix), len(matrix)
    floor = n * _EPS * float(np.trace(matrix)) if n else 0.0
    values, vectors = [], np.zeros((0, n))
    for number in range(1, min(most, n) + 1) if slicer.norm > 0 else ():
        value, vector = slicer.pair(number, vectors)
        if value <= floor:
            break
        if not slicer.certified(number, value, vector):
            raise ArithmeticError(f"eigenvalue {number} is not certified by the inertia counts")
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values), vectors
