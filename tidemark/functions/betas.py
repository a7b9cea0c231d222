"""Difference of two Beta variables by quadrature on fixed nodes.

The work depends on the number of panels and nodes alone, not on the counts
behind the parameters: densities are taken on intervals around their means, cut
into panels with Gauss-Legendre nodes, and a distribution function comes from the
panels before plus an integration matrix inside the panel. The distribution of a
difference is that of one variable against the other, shifted; its quantiles are
found by bisection.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

NODES = 24
PANELS = 96
#: Half-width of a density's interval, in standard deviations.
REACH = 40.0
STEPS = 60


@lru_cache(maxsize=1)
def _rule() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and weights on [-1, 1], and the matrix that integrates the
    interpolating polynomial of values at the nodes from -1 up to each node."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    to_series = np.linalg.inv(np.polynomial.legendre.legvander(x, NODES - 1))
    up = np.array([np.polynomial.legendre.legval(x, np.polynomial.legendre.legint(row, lbnd=-1)) for row in np.eye(NODES)]).T
    return x, w, up @ to_series


class Beta:
    """Beta(a, b) with a, b >= 1."""

    def __init__(self, a: float, b: float):
        self.a, self.b = float(a), float(b)
        n = self.a + self.b
        self.mean, self.sd = self.a / n, math.sqrt(self.a * self.b / (n * n * (n + 1)))
        self.mode = min(max((self.a - 1) / (n - 2), 0.0), 1.0) if n > 2 else 0.5
        self.low, self.high = max(0.0, self.mean - REACH * self.sd), min(1.0, self.mean + REACH * self.sd)

    def edges(self) -> np.ndarray:
        """Panel ends: evenly over ten standard deviations either side, wider beyond."""
        inner = np.linspace(max(self.low, self.mean - 10 * self.sd), min(self.high, self.mean + 10 * self.sd), PANELS)
        return np.unique(np.concatenate([np.linspace(self.low, self.high, PANELS // 2), inner]))

    def density(self, x: np.ndarray) -> np.ndarray:
        """Up to a factor: relative to the mode, so large parameters keep their digits."""
        inside = (x > 0) & (x < 1)
        y = np.where(inside, x, 0.5)
        m = min(max(self.mode, 1e-300), 1 - 1e-16)
        left = (self.a - 1) * (np.log1p((y - m) / m) if self.mode > 0 else np.log(y)) if self.a > 1 else 0.0
        right = (self.b - 1) * (np.log1p((m - y) / (1 - m)) if self.mode < 1 else np.log1p(-y)) if self.b > 1 else 0.0
        return np.where(inside, np.exp(np.minimum(left + right, 700.0)), 0.0)


def probability_below(x: Beta, y: Beta, shift: float) -> float:
    """P(y - x <= shift) for independent x and y."""
    nodes, weights, up = _rule()
    edges = np.unique(np.concatenate([x.edges(), np.clip(y.edges() - shift, x.low, x.high)]))
    half, middle = np.diff(edges) / 2, (edges[1:] + edges[:-1]) / 2
    at = middle[:, None] + half[:, None] * nodes
    fx = x.density(at)
    # the distribution function of y at each node + shift: whole panels before, and the part of the panel
    own = np.unique(np.concatenate([y.edges(), np.clip(edges + shift, y.low, y.high)]))
    own_half, own_middle = np.diff(own) / 2, (own[1:] + own[:-1]) / 2
    total = (y.density(own_middle[:, None] + own_half[:, None] * nodes) @ weights * own_half)
    cumulative = np.concatenate([[0.0], np.cumsum(total)])
    before = np.interp(np.clip(edges[:-1] + shift, y.low, y.high), own, cumulative)  # edges are among ``own``
    fy = before[:, None] + (y.density(at + shift) @ up.T) * half[:, None]
    fy = np.where(at + shift >= y.high, cumulative[-1], np.where(at + shift <= y.low, 0.0, fy)) / cumulative[-1]
    mass = fx @ weights * half
    return float(min(1.0, max(0.0, ((fx * fy) @ weights * half).sum() / mass.sum())))


def difference_quantile(x: Beta, y: Beta, p: float) -> float:
    """The p-quantile of y - x, by bisection on its distribution function."""
    middle, spread = y.mean - x.mean, math.hypot(x.sd, y.sd)
    low, high = max(-1.0, middle - REACH * spread), min(1.0, middle + REACH * spread)
    for _ in range(STEPS):
        at = (low + high) / 2
        if probability_below(x, y, at) < p:
            low = at
        else:
            high = at
    return (low + high) / 2
